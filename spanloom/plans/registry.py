"""All queries of the code-graph engine and their DuckDB counterparts."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import tools
from spanloom.build import build
from spanloom.functions import names as fn
from spanloom.operators import aggregates, graph, grep, imports, resolve, search
from spanloom.plans import fixtures
from spanloom.plans import views as v
from spanloom.session import cut, shared_dir, table
from spanloom.sources import ast_xml, store
from spanloom.sources.langs import BY_EXTENSION, LANGUAGES, SKIP_DIRS
from spanloom.sources.scan import changed, in_skipped_dir, is_test, language_of, scan
from spanloom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


NODE = 'id, name, file, line, "column"'
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SYMBOL, PREFIX, GLOB, CAMEL, PART = "RedPlate", "Red*", "?e*Plate", "BP", "dpl"
START = "customer:42"
PATTERN = "err"

# files

_ext = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_lang = "CASE " + " ".join(f"WHEN {_ext} = '{e}' THEN '{x}'" for e, x in BY_EXTENSION.items()) + " END"
_base = "regexp_extract(path, '([^/]*)$', 1)"
_tests = " OR ".join(f"(language = '{x.name}' AND contains({_base}, '{m}'))" for x in LANGUAGES.values() for m in x.tests)
_skipped = "len(list_intersect(list_slice(string_split(path, '/'), 1, -2), [" + ", ".join(f"'{d}'" for d in SKIP_DIRS) + "])) > 0"
_files_sql = f"(SELECT *, {_lang} AS language FROM files)"


def _files(s: SparkSession, d: str) -> DataFrame:
    return v.files(s, d).withColumn("language", language_of(F.col("path")))


add("scan_files", lambda s, d: _files(s, d).where("language is not null").where(~in_skipped_dir(F.col("path"))).select("path", "language", "size", is_test(F.col("path"), F.col("language")).alias("is_test")),
    v.sql(f"SELECT path, language, size, ({_tests}) AS is_test FROM {_files_sql} WHERE language IS NOT NULL AND NOT ({_skipped})", "files"))
add("lang_join", lambda s, d: _files(s, d).groupBy("language").agg(F.count(F.lit(1)).alias("cnt"), F.sum("size").alias("bytes")),
    v.sql(f"SELECT language, count(*) AS cnt, CAST(sum(size) AS BIGINT) AS bytes FROM {_files_sql} GROUP BY language", "files"))
add("test_tag", lambda s, d: _files(s, d).where(is_test(F.col("path"), F.col("language"))).select("path", "language"), v.sql(f"SELECT path, language FROM {_files_sql} WHERE {_tests}", "files"))
add("skip_dirs", lambda s, d: _files(s, d).where(in_skipped_dir(F.col("path"))).select("path"), v.sql(f"SELECT path FROM files WHERE {_skipped}", "files"))
add("distinct_langs", lambda s, d: aggregates.languages(_files(s, d).where("language is not null")), v.sql(f"SELECT DISTINCT language FROM {_files_sql} WHERE language IS NOT NULL", "files"))
add("missing_grammars", lambda s, d: aggregates.missing_languages(_files(s, d).where("language is not null"), s.createDataFrame([("go",), ("python",)], "language string")),
    v.sql(f"SELECT DISTINCT language FROM {_files_sql} WHERE language NOT IN ('go', 'python')", "files"))
add("manifest_diff", lambda s, d: changed(v.files(s, d).where("doc_id % 11 <> 0").select("path", F.col("size").alias("mtime")), v.files(s, d).where("doc_id % 13 <> 0").select("path", (F.col("size") + (F.col("doc_id") % 3 == 0).cast("int")).alias("mtime"))),
    v.sql("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'create' WHEN b.path IS NULL THEN 'remove' ELSE 'write' END AS op
 FROM (SELECT path, size AS m FROM files WHERE doc_id % 11 <> 0) a FULL JOIN (SELECT path, size + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS m FROM files WHERE doc_id % 13 <> 0) b ON a.path = b.path
 WHERE a.path IS NULL OR b.path IS NULL OR a.m <> b.m""", "files"))  # fmt: skip

# lines

add("lines_explode", lambda s, d: v.lines(s, d), v.sql("SELECT file, line, content FROM lines", "lines"))
add("read_line", lambda s, d: v.lines(s, d).where("line = 3"), v.sql("SELECT file, line, content FROM lines WHERE line = 3", "lines"))
add("read_lines", lambda s, d: v.lines(s, d).where("line between 2 and 5").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("block")),
    v.sql("SELECT file, string_agg(content, chr(10) ORDER BY line) AS block FROM lines WHERE line BETWEEN 2 AND 5 GROUP BY file", "lines"))

# scalars

add("node_id", lambda s, d: v.nodes(s, d).select(fn.node_id(F.col("file"), F.col("line"), F.col("column")).alias("node_id"), "id"), v.sql("""SELECT file || ':' || line || ':' || "column" AS node_id, id FROM nodes""", "nodes"))
_pkg = "CASE WHEN instr(callee_name, '.') > 1 THEN split_part(callee_name, '.', 1) ELSE callee_name END"
add("extract_pkg", lambda s, d: v.sinks(s, d).select("line", fn.package(F.col("callee_name")).alias("pkg")), v.sql(f"SELECT line, {_pkg} AS pkg FROM sinks", "sinks"))
add("split_dotted", lambda s, d: v.sinks(s, d).select("line", fn.object_of(F.col("callee_name")).alias("obj"), fn.method_of(F.col("callee_name")).alias("method")),
    v.sql("SELECT line, CASE WHEN instr(callee_name, '.') > 0 THEN split_part(callee_name, '.', 1) ELSE '' END AS obj, substr(callee_name, instr(callee_name, '.') + 1) AS method FROM sinks", "sinks"))
add("module_path", lambda s, d: v.sinks(s, d).select("callee_name").distinct().select("callee_name", fn.module_path(F.col("callee_name"), ".py").alias("path")), v.sql("SELECT DISTINCT callee_name, replace(callee_name, '.', '/') || '.py' AS path FROM sinks", "sinks"))

# search

_find = lambda q, ci=False: lambda s, d: search.query(v.nodes(s, d), q, ci)
_where = lambda cond: v.sql(f"SELECT {NODE} FROM nodes WHERE {cond}", "nodes")
add("sym_exact", lambda s, d: search.exact(v.nodes(s, d), SYMBOL), _where(f"name = '{SYMBOL}'"))
add("sym_exact_ci", lambda s, d: search.exact(v.nodes(s, d), SYMBOL.lower(), True), _where(f"lower(name) = '{SYMBOL.lower()}'"))
add("sym_prefix", _find(PREFIX), _where("starts_with(name, 'Red')"))
add("sym_prefix_ci_retry", _find("red*", True), _where("starts_with(name, 'Red') AND NOT EXISTS (SELECT 1 FROM nodes WHERE starts_with(name, 'red'))"))
add("sym_glob", _find(GLOB), _where("regexp_matches(name, '^[^/]e[^/]*Plate$')"))
add("sym_camel", lambda s, d: search.camel(v.nodes(s, d), CAMEL), _where("regexp_matches(name, 'B.*P')"))
add("sym_substr", lambda s, d: search.substring(v.nodes(s, d), PART), _where(f"contains(lower(name), '{PART}')"))
_tier = "CASE WHEN name = '{q}' THEN 1 WHEN regexp_matches(name, '{r}') THEN 2 WHEN contains(lower(name), '{l}') THEN 3 END"
add("sym_tiered", _find("BP"), v.sql(f"WITH t AS (SELECT *, {_tier.format(q='BP', r='B.*P', l='bp')} AS tier FROM nodes) SELECT {NODE} FROM t WHERE tier = (SELECT min(tier) FROM t)", "nodes"))
add("sym_empty", _find(""), _where("false"))
add("sym_tiered_substr", _find("late"), v.sql(f"WITH t AS (SELECT *, CASE WHEN name = 'late' THEN 1 WHEN contains(lower(name), 'late') THEN 3 END AS tier FROM nodes) SELECT {NODE} FROM t WHERE tier = (SELECT min(tier) FROM t)", "nodes"))

# lookups

add("node_by_id", lambda s, d: graph.node_by_id(v.nodes(s, d), "part:7"), _where("id = 'part:7'"))
add("node_by_name", lambda s, d: graph.nodes_by_name(v.nodes(s, d), SYMBOL), _where(f"name = '{SYMBOL}'"))
_hits = f"(SELECT DISTINCT id FROM nodes WHERE name = '{SYMBOL}')"
_callers = f"SELECT e.dst, n.id AS caller_id, n.name AS caller_name, n.file AS caller_file, n.line AS caller_line, e.file, e.line FROM edges e JOIN {_hits} h ON e.dst = h.id JOIN nodes n ON e.src = n.id"
_callees = f"SELECT e.src, n.id AS callee_id, n.name AS callee_name, n.file AS callee_file, n.line AS callee_line, e.file, e.line FROM edges e JOIN {_hits} h ON e.src = h.id JOIN nodes n ON e.dst = n.id"
add("callers", lambda s, d: graph.callers(v.edges(s, d), v.nodes(s, d), graph.nodes_by_name(v.nodes(s, d), SYMBOL)), v.sql(_callers, "nodes", "edges"))
add("callees", lambda s, d: graph.callees(v.edges(s, d), v.nodes(s, d), graph.nodes_by_name(v.nodes(s, d), SYMBOL)), v.sql(_callees, "nodes", "edges"))
add("query_callers", lambda s, d: graph.callers(v.edges(s, d), v.nodes(s, d), search.query(v.nodes(s, d), SYMBOL.lower(), True)).groupBy("dst").agg(F.count(F.lit(1)).alias("callers")),
    v.sql(f"SELECT dst, count(*) AS callers FROM ({_callers.replace(_hits, _hits.replace('name =', 'lower(name) =').replace(SYMBOL, SYMBOL.lower()))}) GROUP BY dst", "nodes", "edges"))
add("sinks_of_node", lambda s, d: graph.sinks_of(v.sinks(s, d), "supplier:5"), v.sql("SELECT src, callee_name, pkg, file, line FROM sinks WHERE src = 'supplier:5'", "sinks"))
add("sinks_with_caller", lambda s, d: graph.sinks_with_caller(v.sinks(s, d), v.nodes(s, d)),
    v.sql("SELECT s.src, s.callee_name, s.pkg, s.file, s.line, n.name AS caller_name, n.file AS caller_file, n.line AS caller_line FROM sinks s LEFT JOIN nodes n ON s.src = n.id", "nodes", "sinks"))
add("annotations_join", lambda s, d: v.files(s, d).join(table(s, d, "labels"), "doc_id").select("path", "quality", "toxic"), v.sql("SELECT path, quality, toxic FROM files JOIN labels USING (doc_id)", "files"))

# groups

add("sinks_by_pkg", lambda s, d: aggregates.sinks_by_package(v.sinks(s, d)), v.sql("SELECT pkg, count(*) AS cnt FROM sinks GROUP BY pkg", "sinks"))
add("sinks_by_pkg_rows", lambda s, d: aggregates.sinks_by_package(v.sinks(s, d), True).select("pkg", "cnt", F.array_join(F.transform("sinks", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["callee_name"])), ",").alias("listed")),
    v.sql("SELECT pkg, count(*) AS cnt, string_agg(line || ':' || callee_name, ',' ORDER BY file, line, src, callee_name) AS listed FROM sinks GROUP BY pkg", "sinks"))
add("sinks_pkg_filter", lambda s, d: aggregates.package_listing(v.sinks(s, d), "CL"), v.sql("SELECT pkg, count(*) AS cnt FROM sinks WHERE contains(lower(pkg), 'cl') GROUP BY pkg", "sinks"))
add("sinks_symbol_filter", lambda s, d: aggregates.symbol_listing(search.query(v.nodes(s, d), "Supplier*", True), v.sinks(s, d), "click"),
    v.sql("SELECT n.id, n.name, count(*) AS cnt FROM nodes n JOIN sinks s ON s.src = n.id WHERE starts_with(n.name, 'Supplier') AND (lower(pkg) = 'click' OR contains(lower(callee_name), 'click')) GROUP BY n.id, n.name", "nodes", "sinks"))
add("index_summary", lambda s, d: aggregates.summary(v.files(s, d), v.nodes(s, d), v.edges(s, d)),
    v.sql("SELECT 'files' AS kind, count(*) AS cnt FROM files UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges", "files", "nodes", "edges"))
add("symbol_distribution", lambda s, d: aggregates.distribution(v.line_nodes(s, d)), v.sql("SELECT upper(name[1]) AS letter, count(*) AS cnt FROM line_nodes WHERE name <> '' GROUP BY 1", "line_nodes"))
add("outline", lambda s, d: aggregates.outline(v.nodes(s, d), "Brand#12"), v.sql("""SELECT file, name, line, "column", id FROM nodes WHERE suffix(file, 'Brand#12')""", "nodes"))

# reach

_levels = f"""WITH RECURSIVE walk(node, depth) AS (SELECT '{START}', 1 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 10),
 best AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""
_paths = f"""{_levels}, parent AS (SELECT b.node, b.depth, min(p.node) AS parent FROM best b JOIN edges e ON e.dst = b.node JOIN best p ON p.node = e.src AND p.depth = b.depth - 1 GROUP BY b.node, b.depth),
 path(node, depth, path) AS (SELECT '{START}', 1, '{START}' UNION ALL SELECT c.node, c.depth, p.path || '>' || c.node FROM path p JOIN parent c ON c.parent = p.node AND c.depth = p.depth + 1)"""
_hit_sinks = f"(SELECT src, callee_name FROM sinks WHERE contains(lower(pkg), '{PATTERN}'))"


def _start(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(START,)], "id string")


add("reach_depth", lambda s, d: graph.reach(v.edges(s, d), _start(s), paths=False).groupBy("depth").agg(F.count(F.lit(1)).alias("cnt")), v.sql(f"{_levels} SELECT depth, count(*) AS cnt FROM best GROUP BY depth", "edges"))
add("reach_pairs", lambda s, d: graph.reachable(v.edges(s, d), v.sinks(s, d), _start(s), PATTERN).select("node", "depth", "callee_name"),
    v.sql(f"{_levels} SELECT node, depth, callee_name FROM best JOIN {_hit_sinks} ON src = node", "edges", "sinks"))
add("reach_paths", lambda s, d: graph.reachable(v.edges(s, d), v.sinks(s, d), _start(s), PATTERN).select("node", F.array_join("path", ">").alias("path")),
    v.sql(f"{_paths} SELECT node, path || '>' || callee_name AS path FROM path JOIN {_hit_sinks} ON src = node", "edges", "sinks"))
add("reach_named", lambda s, d: graph.rendered(graph.reachable(v.edges(s, d), v.sinks(s, d), _start(s), PATTERN), v.nodes(s, d)).select("node", "callee_name", "shown"),
    v.sql(f"""{_paths}, p AS (SELECT node, callee_name, string_split(path, '>') AS ids FROM path JOIN {_hit_sinks} ON src = node), x AS (SELECT DISTINCT node, callee_name, unnest(ids) AS step, generate_subscripts(ids, 1) AS pos FROM p),
 n AS (SELECT id, max(name) AS name FROM nodes GROUP BY id), y AS (SELECT node, callee_name, string_agg(coalesce(name, step), ' -> ' ORDER BY pos) AS shown FROM x LEFT JOIN n ON id = step GROUP BY node, callee_name)
 SELECT p.node, p.callee_name, shown || ' -> ' || p.callee_name AS shown FROM p JOIN y ON y.node = p.node AND y.callee_name = p.callee_name""", "nodes", "edges", "sinks"))  # fmt: skip

# grep

WORD = "The"
_g = lambda **o: grep.GrepOptions(pattern=WORD, **o)
_at = """SELECT l.file, l.line, 1 AS "column", l.name, x.content FROM line_nodes l JOIN lines x ON x.file = l.file AND x.line = l.line WHERE l.name = 'The'"""
_isword = lambda c, w: f"regexp_matches({c}, '(?i)(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)')"


def _grep(**o) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: grep.hits(v.line_nodes(s, d), v.lines(s, d), _g(**o))


add("grep_hits", _grep(), v.sql(_at, "line_nodes"))
add("hit_distinct", lambda s, d: grep.distinct_places(v.line_nodes(s, d).unionByName(v.line_nodes(s, d))), v.sql('SELECT id, name, file, line, "column" FROM line_nodes', "line_nodes"))
_he = """SELECT l.file, l.line, 1 AS "column", l.name, x.content FROM line_nodes l JOIN lines x ON x.file = l.file AND x.line = l.line WHERE contains(lower(l.name), 'he')"""
add("grep_word", lambda s, d: grep.hits(v.line_nodes(s, d), v.lines(s, d), grep.GrepOptions(pattern="he", word=True)), v.sql(f"SELECT * FROM ({_he}) WHERE {_isword('content', 'he')} OR {_isword('name', 'he')}", "line_nodes"))
add("grep_without_symbols", lambda s, d: grep.grep(v.line_nodes(s, d), v.lines(s, d), grep.GrepOptions(pattern="e t")), v.sql("SELECT file || ':' || line || ':' || content AS printed FROM lines WHERE contains(content, 'e t')", "lines"))
add("grep_no_filename", lambda s, d: grep.grep(v.line_nodes(s, d), v.lines(s, d), _g(no_filename=True)), v.sql(f"SELECT line || ':' || CASE WHEN content = '' THEN name ELSE content END AS printed FROM ({_at})", "line_nodes"))
add("grep_include", lambda s, d: grep.text_hits(v.lines(s, d), grep.GrepOptions(pattern="the", include=("1*", "?7"), exclude=("*3",))),
    v.sql("SELECT file, line, content FROM (SELECT *, regexp_extract(file, '([^/]*)$', 1) AS base FROM lines) WHERE contains(content, 'the') AND (starts_with(base, '1') OR regexp_matches(base, '^.7$')) AND NOT suffix(base, '3')", "lines"))
add("grep_quiet", lambda s, d: s.createDataFrame([(p, grep.any_hit(v.line_nodes(s, d), v.lines(s, d), grep.GrepOptions(pattern=p, quiet=True))) for p in (WORD, "no such words")], "pattern string, found boolean"),
    v.sql(f"SELECT '{WORD}' AS pattern, count(*) > 0 AS found FROM line_nodes WHERE name = '{WORD}' UNION ALL SELECT 'no such words', count(*) > 0 FROM lines WHERE contains(content, 'no such words')", "line_nodes"))
add("grep_flags", lambda s, d: s.createDataFrame([(k, str(x)) for k, x in sorted(vars(grep.parse(["-inA3", "-e", "x", "--max-count=5", "-C2", "-ey", "a", "b"])).items()) if x], "flag string, value string"),
    "SELECT * FROM (VALUES ('after', '2'), ('before', '2'), ('ignore_case', 'True'), ('max_count', '5'), ('paths', '(''a'', ''b'')'), ('pattern', 'y')) t(flag, value)")
add("grep_paths", _grep(paths=("doc/1", "./doc/2", "77")), v.sql(f"SELECT * FROM ({_at}) WHERE starts_with(file, 'doc/1') OR starts_with(file, 'doc/2') OR file = 'doc/77'", "line_nodes"))
add("grep_invert", lambda s, d: grep.hits(v.line_nodes(s, d), v.lines(s, d), _g(paths=("doc/1",), invert=True)), v.sql(f"""SELECT file, line, "column", name, '' AS content FROM ({_at}) WHERE NOT starts_with(file, 'doc/1')""", "line_nodes"))
add("grep_count", lambda s, d: grep.grep(v.line_nodes(s, d), v.lines(s, d), _g(count=True)), v.sql(f"SELECT CAST(count(*) AS VARCHAR) AS printed FROM ({_at})", "line_nodes"))
add("grep_files", lambda s, d: grep.grep(v.line_nodes(s, d), v.lines(s, d), _g(files_only=True)), v.sql(f"SELECT file AS printed FROM ({_at})", "line_nodes"))
add("grep_only", lambda s, d: grep.grep(v.line_nodes(s, d), v.lines(s, d), _g(only_matching=True)), v.sql(f"SELECT '{WORD}' AS printed FROM ({_at})", "line_nodes"))
add("grep_printed", lambda s, d: grep.grep(v.line_nodes(s, d), v.lines(s, d), _g()), v.sql(f"SELECT file || ':' || line || ':' || CASE WHEN content = '' THEN name ELSE content END AS printed FROM ({_at})", "line_nodes"))
add("max_count", _grep(max_count=25), v.sql(f"SELECT * FROM ({_at}) ORDER BY file, line LIMIT 25", "line_nodes"))
add("grep_context", lambda s, d: grep.context(_grep()(s, d), v.lines(s, d), 1, 2),
    v.sql(f"""WITH h AS ({_at}), b AS (SELECT h.file, h.line, string_agg(x.content, chr(10) ORDER BY x.line) AS block FROM h JOIN lines x ON x.file = h.file AND x.line BETWEEN h.line - 1 AND h.line + 2 GROUP BY h.file, h.line)
 SELECT h.file, h.line, h.name, b.block, CASE WHEN lag(h.line) OVER w IS NULL THEN h.file <> (SELECT min(file) FROM h) ELSE lag(h.line) OVER w + 3 < h.line - 1 END AS separated FROM h JOIN b ON b.file = h.file AND b.line = h.line WINDOW w AS (PARTITION BY h.file ORDER BY h.line)""", "line_nodes"))  # fmt: skip
add("grep_text", lambda s, d: grep.text_hits(v.lines(s, d), grep.GrepOptions(pattern="th[aeiou]r", ignore_case=True)), v.sql("SELECT file, line, content FROM lines WHERE regexp_matches(content, '(?i)th[aeiou]r')", "lines"))

# text to relations

_FROM, _IMP = r"^from\s+([\w.]+)\s+import\s+(.+)", r"^import\s+([\w.]+)(?:\s+as\s+(\w+))?"
_code = "(SELECT * FROM code WHERE NOT regexp_matches(content, '^(#|//|$)'))"
_of = lambda lang: f"(SELECT * FROM {_code} WHERE language = '{lang}')"
_py_imports = f"""SELECT file, line, short_name, full_path, alias FROM (SELECT file, line, {TRIM.format("split_part(item, ' as ', 1)")} AS short_name, replace(module, '.', '/') || '.py' AS full_path,
 CASE WHEN contains(item, ' as ') THEN {TRIM.format("substr(item, instr(item, ' as ') + 4)")} ELSE '' END AS alias, item FROM (SELECT file, line, regexp_extract(content, '{_FROM}', 1) AS module, trim(unnest(string_split(regexp_extract(content, '{_FROM}', 2), ','))) AS item FROM {_of('python')} WHERE regexp_matches(content, '{_FROM}'))) WHERE item NOT IN ('', '*')
 UNION ALL SELECT file, line, regexp_extract(content, '{_IMP}', 2), replace(regexp_extract(content, '{_IMP}', 1), '.', '/') || '.py', regexp_extract(content, '{_IMP}', 1) FROM {_of('python')} WHERE NOT regexp_matches(content, '{_FROM}') AND regexp_extract(content, '{_IMP}', 2) <> ''"""
_py_modules = f"SELECT file, line, 0 AS pos, module, replace(module, '.', '/') || '.py' AS path FROM (SELECT file, line, CASE WHEN regexp_matches(content, '{_FROM}') THEN regexp_extract(content, '{_FROM}', 1) ELSE regexp_extract(content, '{_IMP}', 1) END AS module FROM {_of('python')}) WHERE module <> ''"
_dotted = f"(SELECT file, line, module, regexp_extract(module, '([^.]*)$', 1) AS last, regexp_replace(module, '\\.[^.]*$', '') AS pkg FROM (SELECT file, line, trim(regexp_replace(regexp_replace(regexp_replace(content, '^import ', ''), '^static ', ''), ';$', '')) AS module FROM {_of('java')}) WHERE contains(module, '.'))"
_java_imports = f"SELECT file, line, last AS short_name, replace(module, '.', '/') || '.java' AS full_path, '' AS alias FROM {_dotted} WHERE last <> '*'"
_java_modules = f"SELECT file, line, 0 AS pos, module, CASE WHEN last = '*' THEN replace(pkg, '.', '/') || '/' ELSE replace(module, '.', '/') || '.java' END AS path FROM {_dotted}"
_quotes = f"""(SELECT file, line, content, k, v, length(content) - length(v) - instr(reverse(content), reverse(v)) + 1 AS i FROM (SELECT file, line, content, unnest(q) AS v, generate_subscripts(q, 1) - 1 AS k FROM (SELECT *, regexp_extract_all(content, '"([^"]+)"', 1) AS q FROM {_of('go')})))"""
_go_modules = f"""SELECT file, line, 2 * k AS pos, regexp_extract(v, '([^/]*)$', 1) AS module, CASE WHEN contains(v, '.') THEN v ELSE v || '/' END AS path FROM {_quotes}
 UNION ALL SELECT file, line, 2 * k + 1, regexp_extract(b, '(\\S+)$', 1), v FROM (SELECT *, trim(substr(content, 1, i - 1)) AS b FROM {_quotes} WHERE i > 0) WHERE b <> '' AND NOT contains(b, '"')"""
_parts = f"(SELECT file, line, string_split(substr(content, 5), '::') AS p FROM {_of('rust')} WHERE starts_with(content, 'use '))"
_rust_imports = f"SELECT file, line, regexp_replace(regexp_replace(p[-1], ';$', ''), '}}$', '') AS short_name, array_to_string(p[:-2], '/') || '.rs' AS full_path, '' AS alias FROM {_parts}"
_rust_modules = f"SELECT file, line, 0 AS pos, short_name AS module, full_path AS path FROM ({_rust_imports})"


def _code_rows(s: SparkSession, d: str) -> DataFrame:
    return imports.code_only(v.code(s, d))


for _name, _f, _sql in (
    ("imports_py", imports.python_imports, _py_imports),
    ("imports_java", imports.java_imports, _java_imports),
    ("imports_rust", imports.rust_imports, _rust_imports),
):
    add(_name, lambda s, d, f=_f: f(_code_rows(s, d)).select("file", "line", "short_name", "full_path", "alias"), v.sql(_sql, "code"))
for _name, _f, _sql in (
    ("modules_py", imports.python_modules, _py_modules),
    ("modules_java", imports.java_modules, _java_modules),
    ("imports_go", imports.go_modules, _go_modules),
    ("modules_rust", imports.rust_modules, _rust_modules),
):
    add(_name, lambda s, d, f=_f: f(_code_rows(s, d)).select("file", "line", "module", "path"), v.sql(f"SELECT file, line, module, path FROM ({_sql})", "code"))
_file_modules = f"SELECT file, module, arg_max(path, line * 1000 + pos) AS path FROM ({_py_modules} UNION ALL {_java_modules} UNION ALL {_go_modules} UNION ALL {_rust_modules}) GROUP BY file, module"
add("modmap_files", lambda s, d: imports.file_modules(_code_rows(s, d)), v.sql(_file_modules, "code"))
_hit = lambda pats, lang: f"SELECT file, var, arg_max(type, line) AS type FROM (SELECT file, line, CASE " + " ".join(f"WHEN regexp_matches(content, '{r}') THEN regexp_extract(content, '{r}', {a})" for r, a, _ in pats) + " END AS var, CASE " + " ".join(f"WHEN regexp_matches(content, '{r}') THEN regexp_extract(content, '{r}', {b})" for r, _, b in pats) + f" END AS type FROM {_of(lang)}) WHERE var IS NOT NULL GROUP BY file, var"
add("varmap_py", lambda s, d: imports.python_vars(_code_rows(s, d)), v.sql(_hit([(imports.ASSIGN, 1, 2), (imports.PARAM, 1, 2), (imports.GENERIC, 1, 2)], "python"), "code"))
add("varmap_java", lambda s, d: imports.java_vars(_code_rows(s, d)), v.sql(_hit([(imports.JAVA_DECL, 2, 1), (imports.JAVA_GENERIC, 2, 1)], "java"), "code"))
_dirs = "regexp_replace(path, '/[^/]*$', '')"
_node_modules = f"""SELECT module, min(CAST(prio AS VARCHAR) || path)[2:] AS path FROM (
 SELECT regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '\\.__init__$', '') AS module, path, 0 AS prio FROM files WHERE suffix(path, '.py')
 UNION ALL SELECT replace(regexp_replace(path, '\\.java$', ''), '/', '.'), path, 0 FROM files WHERE suffix(path, '.java')
 UNION ALL SELECT DISTINCT regexp_extract({_dirs}, '([^/]*)$', 1), {_dirs} || '/', 1 FROM files WHERE contains(path, '/')) GROUP BY module"""
add("modmap_nodes", lambda s, d: imports.node_modules(v.files(s, d).select(F.col("path").alias("file"))), v.sql(_node_modules, "files"))
add("modmap_merge", lambda s, d: imports.merged_modules(imports.node_modules(v.files(s, d).select(F.col("path").alias("file"))), imports.file_modules(_code_rows(s, d))),
    v.sql(f"SELECT module, min(k || path)[len(min(k)) + 1:] AS path FROM (SELECT module, path, '0' AS k FROM ({_node_modules}) UNION ALL SELECT module, path, '1' || rpad(file, 40, ' ') FROM ({_file_modules})) GROUP BY module", "files", "code"))
add("page_quoted", lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(imports.quoted(F.col("html"))).alias("pos", "value")),
    """SELECT page_id, CAST(i AS INTEGER) - 1 AS pos, v AS value FROM (SELECT page_id, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '"([^"]+)"', 1) AS q FROM pages))""")  # fmt: skip

# resolution over the tables: parts call suppliers' first symbol of a name, through imports made of edges

_rnodes = """SELECT id, name, file, line, "column" FROM nodes"""


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Calls between symbols by name: every sink's caller calls a part's or supplier's name, plain or through a variable."""
    c = table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("n"), "p_brand")
    rows = c.join(p, F.col("l_partkey") == F.col("k"))
    callee = F.when(F.col("l_linenumber") % 3 == 0, F.col("n")).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Var"), F.col("l_suppkey") % 7, F.lit("."), "n")).otherwise(F.concat(F.lit("brand"), F.col("l_suppkey") % 5, F.lit("."), "n"))
    return rows.select(F.concat(F.lit("part:"), "l_partkey").alias("src"), callee.alias("callee_name"), F.lit("calls").alias("kind"), F.concat(F.lit("part/"), "p_brand").alias("file"), (F.col("l_suppkey") * 8 + F.col("l_linenumber")).cast("int").alias("line"))


_raw_sql = f"""(SELECT 'part:' || l_partkey AS src, CASE l_linenumber % 3 WHEN 0 THEN n WHEN 1 THEN 'Var' || (l_suppkey % 7) || '.' || n ELSE 'brand' || (l_suppkey % 5) || '.' || n END AS callee_name, 'calls' AS kind, 'part/' || p_brand AS file, CAST(l_suppkey * 8 + l_linenumber AS INTEGER) AS line
 FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem) JOIN (SELECT p_partkey, p_brand, {v._camel} AS n FROM part) ON l_partkey = p_partkey)"""


def _brands(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("part/"), "p_brand").alias("file")).distinct()


def _imports(s: SparkSession, d: str) -> DataFrame:
    """Every brand imports three others, by name and by alias."""
    b = _brands(s, d).select("file", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    n = F.substring_index("file", "#", -1).cast("int") + F.col("ord") * 7
    return b.select("file", "ord", F.concat(F.lit("Brand"), n % 5).alias("short_name"), F.concat(F.lit("part/Brand#"), 1 + n % 25).alias("full_path"), F.concat(F.lit("VAR"), n % 7).alias("alias"))


_imports_sql = "(SELECT file, ord, 'Brand' || (n % 5) AS short_name, 'part/Brand#' || (1 + n % 25) AS full_path, 'VAR' || (n % 7) AS alias FROM (SELECT file, ord, CAST(split_part(file, '#', 2) AS INTEGER) + ord * 7 AS n FROM (SELECT DISTINCT 'part/' || p_brand AS file FROM part), (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS ord)))"


def _modules(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("Brand4", "part/Brand#22"), ("typed", "part/Brand#33"), ("Typed", "part/Brand#44")], "module string, path string")


_modules_sql = "(SELECT * FROM (VALUES ('Brand4', 'part/Brand#22'), ('typed', 'part/Brand#33'), ('Typed', 'part/Brand#44')) m(module, path))"


def _vars(s: SparkSession, d: str) -> DataFrame:
    return _brands(s, d).select("file", F.explode(F.array(F.struct(F.lit("Var1").alias("var"), F.lit("Typed").alias("type")), F.struct(F.lit("brand3").alias("var"), F.lit("brand1").alias("type")))).alias("x")).select("file", "x.var", "x.type")


_vars_sql = "(SELECT DISTINCT 'part/' || p_brand AS file, t.var, t.type FROM part, (VALUES ('Var1', 'Typed'), ('brand3', 'brand1')) t(var, type))"
_first_sql = """(SELECT file, name, arg_min(id, lpad(CAST(line AS VARCHAR), 12, '0') || lpad(CAST("column" AS VARCHAR), 12, '0')) AS dst FROM nodes GROUP BY file, name)"""
_target = f"""targets AS (SELECT file, name, arg_min(path, k) AS path FROM (
 SELECT t.file, t.name, i.full_path AS path, '0' || lpad(CAST(i.ord AS VARCHAR), 9, '0') AS k FROM names t JOIN {_imports_sql} i ON i.file = t.file AND (lower(i.short_name) = lower(t.name) OR lower(i.alias) = lower(t.name))
 UNION ALL SELECT t.file, t.name, m.path, '1' || m.module FROM names t JOIN {_modules_sql} m ON lower(m.module) = lower(t.name)) GROUP BY file, name)"""
_cascade = f"""WITH raw AS (SELECT DISTINCT src, callee_name, kind, file, line, CASE WHEN instr(callee_name, '.') > 0 THEN split_part(callee_name, '.', 1) ELSE '' END AS obj, substr(callee_name, instr(callee_name, '.') + 1) AS method FROM {_raw_sql}),
 first AS {_first_sql}, vars AS {_vars_sql}, objs AS (SELECT DISTINCT file, obj FROM raw WHERE obj <> ''), names AS (SELECT file, obj AS name FROM objs UNION SELECT o.file, w.type FROM objs o JOIN vars w ON w.file = o.file AND w.var = o.obj), {_target},
 target AS (SELECT o.file, o.obj, coalesce(a.path, b.path) AS path FROM objs o LEFT JOIN vars w ON w.file = o.file AND w.var = o.obj LEFT JOIN targets a ON a.file = o.file AND a.name = o.obj LEFT JOIN targets b ON b.file = o.file AND b.name = w.type),
 cand AS (SELECT r.*, f.dst, f.file AS dst_file, 1 AS strategy, 0 AS ord FROM raw r JOIN first f ON f.file = r.file AND f.name = r.callee_name
 UNION ALL SELECT r.*, f.dst, f.file, 2, 0 FROM raw r JOIN target t ON t.file = r.file AND t.obj = r.obj JOIN first f ON f.file = t.path AND f.name = r.method WHERE r.obj <> ''
 UNION ALL SELECT r.*, f.dst, f.file, 3, i.ord FROM raw r JOIN {_imports_sql} i ON i.file = r.file JOIN first f ON f.file = i.full_path AND f.name = r.method WHERE r.obj = '')"""
_only = lambda n: v.sql(f"{_cascade} SELECT src, callee_name, line, dst FROM cand WHERE strategy = {n}", "nodes")
_all = lambda s, d: (_raw(s, d), v.nodes(s, d), _imports(s, d), _modules(s), _vars(s, d))
add("resolve_same_file", lambda s, d: resolve.same_file(_raw(s, d), v.nodes(s, d)).select("src", "callee_name", "line", "dst"), _only(1))
add("resolve_typed", lambda s, d: resolve.dotted(*_all(s, d)).select("src", "callee_name", "line", "dst"), _only(2))
add("resolve_import", lambda s, d: resolve.imported(_raw(s, d), v.nodes(s, d), _imports(s, d)).select("src", "callee_name", "line", "dst"), _only(3))
add("resolve_cascade", lambda s, d: resolve.resolve(*_all(s, d)).select("src", "dst", "file", "line", "call_file", "call_line", "callee_name", "strategy"),
    v.sql(f"{_cascade} SELECT src, dst, dst_file AS file, 0 AS line, file AS call_file, line AS call_line, callee_name, strategy FROM (SELECT *, row_number() OVER (PARTITION BY src, callee_name, kind, file, line ORDER BY strategy, ord) AS nth FROM cand) WHERE nth = 1", "nodes"))
_by_name_raw = lambda s, d: v.sinks(s, d).select("src", F.concat(F.lit("Supplier#"), F.lpad(F.substring_index("callee_name", ".", -1), 9, "0")).alias("callee_name"), F.lit("calls").alias("kind"), "file", "line")
_by_name_sql = "(SELECT src, 'Supplier#' || lpad(regexp_extract(callee_name, '([^.]*)$', 1), 9, '0') AS callee_name, file, line FROM sinks)"
add("resolve_by_name", lambda s, d: resolve.by_name(_by_name_raw(s, d), v.nodes(s, d)).select("src", "dst", "file", "line"), v.sql(f"SELECT r.src, n.id AS dst, r.file, r.line FROM {_by_name_sql} r JOIN nodes n ON n.name = r.callee_name", "nodes", "sinks"))
_dir = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
add("resolve_same_dir", lambda s, d: resolve.same_dir(_raw(s, d).where("instr(callee_name, '.') = 0"), v.nodes(s, d)).select("src", "callee_name", "line", "dst"),
    v.sql(f"""WITH raw AS (SELECT DISTINCT * FROM {_raw_sql} WHERE instr(callee_name, '.') = 0), cand AS (SELECT r.*, f.dst, 1 AS p FROM raw r JOIN {_first_sql} f ON f.file = r.file AND f.name = r.callee_name
 UNION ALL SELECT r.*, f.dst, 2 FROM raw r JOIN (SELECT {_dir.format('file')} AS d, name, arg_min(id, file || ' ' || lpad(CAST(line AS VARCHAR), 12, '0')) AS dst FROM nodes GROUP BY 1, 2) f ON f.d = {_dir.format('r.file')} AND f.name = r.callee_name)
 SELECT src, callee_name, line, arg_min(dst, p) AS dst FROM cand GROUP BY src, callee_name, kind, file, line""", "nodes"))  # fmt: skip

# replacing

_changed_files = lambda s, d: v.nodes(s, d).where("file like 'part/%3' or file like 'supplier/1%'").select(F.col("file").alias("path")).distinct()
add("upsert_by_file", lambda s, d: watch.replace_by_file(v.nodes(s, d), v.nodes(s, d).where("file like 'part/%3'").withColumn("line", F.col("line") + 1000), _changed_files(s, d)),
    v.sql(f"SELECT {NODE} FROM nodes WHERE NOT (file LIKE 'part/%3' OR file LIKE 'supplier/1%') UNION ALL SELECT id, name, file, line + 1000, \"column\" FROM nodes WHERE file LIKE 'part/%3'", "nodes"))
add("delete_by_file", lambda s, d: watch.without_files(v.nodes(s, d), _changed_files(s, d)), v.sql(f"SELECT {NODE} FROM nodes WHERE NOT (file LIKE 'part/%3' OR file LIKE 'supplier/1%')", "nodes"))
add("debounce", lambda s, d: watch.debounce(table(s, d, "events").select(F.col("user_id").alias("path"), "ts"), "30 minutes"),
    """SELECT path, count(*) AS events, min(ts) AS first, max(ts) AS last FROM (SELECT path, ts, sum(new) OVER (PARTITION BY path ORDER BY ts) AS burst FROM (SELECT user_id AS path, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY path, burst""")  # fmt: skip
_ev = lambda s, d: table(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "remove").otherwise("write").alias("op"), F.col("event_id").alias("mtime"))
add("last_events", lambda s, d: watch.last_events(_ev(s, d)), "SELECT CAST(user_id AS VARCHAR) AS path, arg_max(CASE WHEN event_type = 'error' THEN 'remove' ELSE 'write' END, event_id) AS op FROM events GROUP BY user_id")
add("rebuild_trigger", lambda s, d: watch.needs_rebuild(v.files(s, d), v.files(s, d).where("doc_id % 10 <> 0")),
    v.sql("SELECT a AS now, b AS indexed, abs(a - b) > 10 AS rebuild FROM (SELECT (SELECT count(*) FROM files) AS a, (SELECT count(*) FROM files WHERE doc_id % 10 <> 0) AS b)", "files"))

# trees and tools

_values = lambda rows, cols: "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") t({', '.join(cols)})"
add("ast_nodes", lambda s, d: ast_xml.nodes_of(ast_xml.walked(fixtures.trees(s))).select("id", "name", "line"), _values(fixtures.NODES, ("id", "name", "line")))
add("ast_edges", lambda s, d: ast_xml.calls_of(ast_xml.walked(fixtures.trees(s))).select("src", "callee_name", "line"), _values(fixtures.CALLS, ("src", "callee_name", "line")))
add("ast_sinks", lambda s, d: ast_xml.sinks_of(ast_xml.walked(fixtures.trees(s))).select("src", "callee_name", "pkg", "line"), _values(fixtures.SINKS, ("src", "callee_name", "pkg", "line")))
add("ast_errors", lambda s, d: ast_xml.errors_of(ast_xml.walked(fixtures.trees(s))).select("file", "language"), _values([("bad.py", "python")], ("file", "language")))


def _walk_in_sql(s: SparkSession, d: str) -> DataFrame:
    ast_xml.register_sql(s)
    fixtures.trees(s).createOrReplaceTempView("spanloom_trees")
    return s.sql("SELECT w.kind, w.id, w.name FROM spanloom_trees t, LATERAL ast_walk(t.file, t.language, t.xml) w WHERE w.kind = 'node'")


add("ast_walk_sql", _walk_in_sql, _values([("node", *r[:2]) for r in fixtures.NODES], ("kind", "id", "name")))
_built = lambda s: build(fixtures.files(s), fixtures.trees(s))
add("build_edges", lambda s, d: _built(s)["edges"], _values(fixtures.EDGES, ("src", "dst", "kind", "file", "line", "call_file", "call_line")))
add("build_modules", lambda s, d: _built(s)["mod_map"], _values(fixtures.MODULES, ("module", "path")))
add("scan_tree", lambda s, d: scan(s, fixtures.tree(s), texts=True).select("path", "language", "size", "is_test", "text"), "SELECT path, language, size, CAST(is_test AS BOOLEAN) AS is_test, text FROM (" + _values([(p, x, 5, t, "x = 1") for p, x, t in fixtures.TREE], ("path", "language", "size", "is_test", "text")) + ")")


def _stored(s: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    """The tables as an index, saved twice and loaded."""
    folder = f"{shared_dir(s).rstrip('/')}/index-{uuid.uuid4().hex}"
    edges = v.edges(s, d).withColumn("call_file", F.col("file")).withColumn("call_line", F.col("line"))
    store.save({"nodes": v.nodes(s, d), "edges": edges, "sinks": v.sinks(s, d)}, folder)
    store.save({"annotations": _annotations(s, d)}, folder)
    return store.load(s, folder, *names)


def _annotations(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").where("doc_id is not null")
    return rows.select(F.concat(F.lit("a"), "doc_id").alias("id"), F.concat(F.lit("part:"), F.col("doc_id") % 50).alias("node_id"), F.lit("quality").alias("key"), F.col("quality").cast("string").alias("value"), F.lit("labels").alias("source"), F.lit("").alias("evidence"))


_annotations_sql = "(SELECT 'a' || doc_id AS id, 'part:' || (doc_id % 50) AS node_id, 'quality' AS key, CAST(quality AS VARCHAR) AS value FROM labels WHERE doc_id IS NOT NULL)"
add("index_load", lambda s, d: _stored(s, d, "nodes")["nodes"], _where("true"))
add("index_by_src", lambda s, d: graph.callees_of((i := _stored(s, d))["edges_by_src"], i["nodes"], "part:7").select("src", "callee_id"), v.sql("SELECT DISTINCT src, dst AS callee_id FROM edges JOIN (SELECT DISTINCT id FROM nodes) ON id = dst WHERE src = 'part:7'", "nodes", "edges"))
add("annotations_of", lambda s, d: store.annotations_of(_stored(s, d), "part:7").select("id", "value"), f"SELECT id, value FROM {_annotations_sql} WHERE node_id = 'part:7'")
add("annotate", lambda s, d: store.annotate({"annotations": _annotations(s, d)}, _annotations(s, d).where("value = '1'").withColumn("value", F.lit("good"))).select("id", "value"), f"SELECT id, CASE WHEN value = '1' THEN 'good' ELSE value END AS value FROM {_annotations_sql}")


def _tool(tool: str, what: str, schema: str, **arguments) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of all pages of a reply, through the requests themselves; the driver holds one page at a time."""

    def run(s: SparkSession, d: str) -> DataFrame:
        asked = tools.Tools({"nodes": v.nodes(s, d), "edges": v.edges(s, d)})

        def page(offset: int) -> tuple[DataFrame, int | None]:
            reply = asked.handle({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": {**arguments, "offset": offset}}})
            found = json.loads(reply["result"]["content"][0]["text"])
            rows = [(found["count"], *(r[c.split()[0]] for c in schema.split(", "))) for r in found[what]]
            return s.createDataFrame(rows, "count long, " + schema.replace("column int", "`column` int")), found.get("next")

        first, following = page(0)
        pages = [first if following is None else cut(first)]
        while following is not None:
            rows, following = page(following)
            pages.append(cut(rows))
        return functools.reduce(DataFrame.union, pages)

    return run


_counted = lambda sql: f"SELECT count(*) OVER () AS count, * FROM ({sql})"
add("tool_find_symbol", _tool("find_symbol", "symbols", "name string, file string, line int, column int, id string", name=SYMBOL), v.sql(_counted(f"SELECT {NODE} FROM nodes WHERE name = '{SYMBOL}'"), "nodes"))
add("tool_outline", _tool("get_outline", "symbols", "name string, line int, column int", file="supplier/3"), v.sql(_counted("""SELECT name, line, "column" FROM nodes WHERE suffix(file, 'supplier/3')"""), "nodes"))
add("tool_find_callers", _tool("find_callers", "callers", "caller_name string, file string, line int", nodeId="part:7"), v.sql(_counted("SELECT n.name AS caller_name, e.file, e.line FROM edges e JOIN nodes n ON n.id = e.src WHERE e.dst = 'part:7'"), "nodes", "edges"))
add("tool_find_callees", _tool("find_callees", "callees", "callee_name string, file string, line int", nodeId="customer:42"), v.sql(_counted("SELECT n.name AS callee_name, e.file, e.line FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = 'customer:42'"), "nodes", "edges"))


def _tool_errors(s: SparkSession, d: str) -> DataFrame:
    asked = [{"id": 1, "method": "nothing"}, {"id": 2, "method": "tools/call"}, {"id": 3, "method": "tools/call", "params": {"name": "nothing"}}, {"id": 4, "method": "tools/call", "params": {"name": "find_symbol"}}, {"method": "notifications/initialized"}]
    lines = tools.Tools({"nodes": v.nodes(s, d), "edges": v.edges(s, d)}).serve(["", "no json", *map(json.dumps, asked)])
    return s.createDataFrame([(r["id"], r["error"]["code"]) for r in map(json.loads, lines)], "id long, code long")


add("tool_errors", _tool_errors, _values([(1, -32601), (2, -32602), (3, -32601), (4, -32000)], ("id", "code")))
add("tool_json", lambda s, d: tools.as_json(aggregates.outline(v.nodes(s, d), "supplier/3").select("line", "name"), "symbols"),
    v.sql("SELECT CAST(to_json({'count': count(*), 'symbols': list({'line': line, 'name': name} ORDER BY line, name)}) AS VARCHAR) AS json FROM nodes WHERE suffix(file, 'supplier/3')", "nodes"))
