"""The driver's tables as a code graph, for Spark and, with the same rows, in DuckDB SQL.

Customers, suppliers and parts are symbols; who bought what from whom are
calls; events are external calls; documents are source files by their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.names import trimmed
from spanloom.session import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1)
    row = lambda df, kind, key, name, part: df.select(F.concat(F.lit(f"{kind}:"), key).alias("id"), name.alias("name"), F.concat(F.lit(f"{kind}/"), part.cast("string")).alias("file"), (F.col(key) + 1).cast("int").alias("line"), one.alias("column"))
    c = row(table(spark, sf_dir, "customer"), "customer", "c_custkey", F.col("c_name"), F.col("c_mktsegment"))
    s = row(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", F.col("s_name"), F.col("s_nationkey"))
    p = row(table(spark, sf_dir, "part"), "part", "p_partkey", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.col("p_brand"))
    return c.unionByName(s).unionByName(p)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customer -> part -> supplier, and supplier -> customer of the same number, which closes cycles."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pair = lambda df, a, ak, b, bk: df.select(F.concat(F.lit(f"{a}:"), ak).alias("src"), F.concat(F.lit(f"{b}:"), bk).alias("dst"))
    bought = pair(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct(), "customer", "o_custkey", "part", "l_partkey")
    made = pair(items.select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey")
    same = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    back = pair(same, "supplier", "s_suppkey", "customer", "c_custkey")
    rows = bought.unionByName(made).unionByName(back)
    return rows.select("src", "dst", F.lit("calls").alias("kind"), F.substring_index("src", ":", 1).alias("file"), F.lit(0).alias("line"))


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.concat(F.lit("supplier:"), "user_id").alias("src"), F.concat("event_type", F.lit("."), F.coalesce(k, F.lit(""))).alias("callee_name"), F.col("event_type").alias("pkg"), F.lit("events").alias("file"), F.col("event_id").cast("int").alias("line"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; their path takes a directory from the source and an extension from the id."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), folder, F.lit("/doc_"), "doc_id", ext)
    return d.select(path.alias("path"), "text", F.col("n_chars").alias("size"), "doc_id")


EXTENSIONS = (".py", ".go", ".java", ".rs", ".TS", "_test.go", ".md", "_test.py")
FOLDERS = ("core", "vendor", "lib", ".git", "app")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return rows.select("file", (F.col("pos") + 1).alias("line"), trimmed(F.col("raw")).alias("content"))


def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capitalised ASCII word that a line begins with, as a symbol on that line."""
    rows = lines(spark, sf_dir).select("file", "line", F.regexp_extract("content", WORD, 1).alias("name")).where("name <> ''")
    return rows.select(F.concat_ws(":", "file", "line", F.lit("1")).alias("id"), "name", "file", "line", F.lit(1).alias("column"))


WORD = "^([A-Z][a-z]+)"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, language, line, content): source lines made of suppliers and parts."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.replace("s_name", F.lit("#"), F.lit("_")).alias("n"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("n"))
    texts = lambda df, spec: df.select("k", F.explode(F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(i).alias("i"), F.expr(text).alias("content")) for i, (lang, text) in enumerate(spec)])).alias("x"))
    rows = texts(s, CODE_SUPPLIER).unionByName(texts(p, CODE_PART))
    return rows.select(F.concat(F.lit("src/"), F.col("x.language"), F.lit("/m"), F.col("k") % 50).alias("file"), F.col("x.language").alias("language"), (F.col("k") * 20 + F.col("x.i")).cast("int").alias("line"), F.col("x.content").alias("content"))


# k: a number, n: a name; the same text builds both engines' lines
CODE_SUPPLIER = (
    ("python", "'from seg.n_' || (k % 7) || ' import ' || n || ' as al_' || k || ', other_' || (k % 5)"),
    ("python", "'import pkg.mod_' || (k % 9) || ' as m' || k"),
    ("python", "'v' || (k % 40) || ' = ' || n || '(' || k || ')'"),
    ("java", "'import com.acme.' || n || ';'"),
    ("java", "'import static java.util.p' || (k % 3) || '.*;'"),
    ("java", "n || ' w' || (k % 40) || ' = new ' || n || '()'"),
    ("go", "'db' || (k % 6) || ' \"shop/x' || k || '/db\"'"),
    ("go", "'\"github.com/a/b' || (k % 11) || '\"'"),
    ("rust", "'use crate::store::' || n || ';'"),
    ("python", "'# from a import b'"),
)
CODE_PART = (
    ("python", "'from parts import *'"),
    ("python", "'import ' || n"),
    ("python", "'p' || (k % 30) || ': List[' || n || '] = None'"),
    ("java", "'List<' || n || '> q' || (k % 30)"),
    ("rust", "'use std::' || n || '}'"),
    ("go", "'// \"not/this\"'"),
)


_camel = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '')"


def _code_sql() -> str:
    supplier, part = "SELECT s_suppkey AS k, replace(s_name, '#', '_') AS n FROM supplier", f"SELECT p_partkey AS k, {_camel} AS n FROM part"
    row = "SELECT 'src/{lang}/m' || (k % 50) AS file, '{lang}' AS language, CAST(k * 20 + {i} AS INTEGER) AS line, {text} AS content FROM ({src})"
    return " UNION ALL ".join(row.format(lang=lang, i=i, text=text, src=src) for spec, src in ((CODE_SUPPLIER, supplier), (CODE_PART, part)) for i, (lang, text) in enumerate(spec))


SQL = {
    "nodes": f"""SELECT 'customer:' || c_custkey AS id, c_name AS name, 'customer/' || c_mktsegment AS file, CAST(c_custkey + 1 AS INTEGER) AS line, 1 AS "column" FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier/' || s_nationkey, CAST(s_suppkey + 1 AS INTEGER), 1 FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, {_camel}, 'part/' || p_brand, CAST(p_partkey + 1 AS INTEGER), 1 FROM part""",
    "edges": """SELECT src, dst, 'calls' AS kind, split_part(src, ':', 1) AS file, 0 AS line FROM (
 SELECT DISTINCT 'customer:' || o_custkey AS src, 'part:' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem
 UNION ALL SELECT 'supplier:' || s_suppkey, 'customer:' || c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey)""",
    "sinks": """SELECT 'supplier:' || user_id AS src, event_type || '.' || coalesce(json_extract_string(props, '$.k'), '') AS callee_name, event_type AS pkg, 'events' AS file, CAST(event_id AS INTEGER) AS line FROM events""",
    "files": f"""SELECT source || '/' || ({list(FOLDERS)})[CAST(doc_id % {len(FOLDERS)} + 1 AS INTEGER)] || '/doc_' || doc_id || ({list(EXTENSIONS)})[CAST(doc_id % {len(EXTENSIONS)} + 1 AS INTEGER)] AS path, text, n_chars AS size, doc_id FROM documents""",
    "lines": r"""SELECT 'doc/' || doc_id AS file, CAST(i AS INTEGER) AS line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "line_nodes": f"""SELECT file || ':' || line || ':1' AS id, regexp_extract(content, '{WORD}', 1) AS name, file, line, 1 AS "column" FROM lines WHERE regexp_extract(content, '{WORD}', 1) <> ''""",
    "code": _code_sql(),
}
NEEDS = {"line_nodes": ("lines",)}


def sql(query: str, *views: str) -> str:
    """A query over some of the views, for DuckDB."""
    wanted: list[str] = []
    for v in views:
        for x in (*NEEDS.get(v, ()), v):
            if x not in wanted:
                wanted.append(x)
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in wanted)
    recursive = "RECURSIVE " if "RECURSIVE" in query else ""
    body = query.replace("WITH RECURSIVE ", ", ", 1) if recursive else query
    if recursive:
        return f"WITH RECURSIVE {head}{body}"
    return f"WITH {head} {query}" if not query.lstrip().upper().startswith("WITH ") else f"WITH {head}, {query.lstrip()[5:]}"
