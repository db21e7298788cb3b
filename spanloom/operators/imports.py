"""Imports, module maps and variable types out of source lines, by expressions alone.

``code`` is (file, language, line, content) with trimmed lines; blank ones and
comments are left out by ``code_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.names import base_name, dir_name, module_path, trimmed

# fixed values: what counts as an import, a quoted string, a variable with a type
FROM = r"^from\s+([\w.]+)\s+import\s+(.+)"
IMPORT = r"^import\s+([\w.]+)(?:\s+as\s+(\w+))?"
QUOTED = r'"([^"]+)"'
LINE_LIMIT = 65_536


def code_lines(files: DataFrame, intent: bool = False) -> DataFrame:
    """(file, language, line, content) of (file, language, text).

    A line of LINE_LIMIT bytes or more ends the file, as its reader gives up
    there; with ``intent`` nothing does.
    """
    cut = F.split("text", "\r?\n")
    if not intent:
        end = F.array_position(F.transform(cut, lambda x: F.octet_length(x) >= LINE_LIMIT), True)
        cut = F.when(end > 0, F.slice(cut, F.lit(1), (end - 1).cast("int"))).otherwise(cut)
    rows = files.select("file", "language", F.posexplode(cut).alias("pos", "raw"))
    rows = rows.select("file", "language", (F.col("pos") + 1).alias("line"), trimmed(F.col("raw")).alias("content"))
    return code_only(rows)


def code_only(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("content").rlike("^(#|//|$)"))


def _of(code: DataFrame, language: str) -> DataFrame:
    return code.where(F.col("language") == language)


def _items(code: DataFrame) -> DataFrame:
    """The lines ``from M import ...`` as (file, line, pos, module, item)."""
    found = _of(code, "python").where(F.col("content").rlike(FROM))
    rows = found.select("file", "line", F.regexp_extract("content", FROM, 1).alias("module"), F.posexplode(F.split(F.regexp_extract("content", FROM, 2), ",")).alias("pos", "raw"))
    return rows.select("file", "line", "pos", "module", trimmed(F.col("raw")).alias("item")).where("item not in ('', '*')")


def python_imports(code: DataFrame) -> DataFrame:
    """(file, line, pos, short_name, full_path, alias); alias "" if there is none.

    ``import M as x`` has its name and alias the other way round, as its users expect.
    """
    part = lambda k: trimmed(F.get(F.split("item", " as ", 2), F.lit(k)))
    items = _items(code).select("file", "line", "pos", part(0).alias("short_name"), module_path(F.col("module"), ".py").alias("full_path"), F.coalesce(part(1), F.lit("")).alias("alias"))
    plain = _of(code, "python").where(~F.col("content").rlike(FROM) & (F.regexp_extract("content", IMPORT, 2) != ""))
    module = F.regexp_extract("content", IMPORT, 1)
    plain = plain.select("file", "line", F.lit(0).alias("pos"), F.regexp_extract("content", IMPORT, 2).alias("short_name"), module_path(module, ".py").alias("full_path"), module.alias("alias"))
    return items.unionByName(plain)


def python_modules(code: DataFrame) -> DataFrame:
    """(file, line, pos, module, path)"""
    rows = _of(code, "python")
    module = F.when(F.col("content").rlike(FROM), F.regexp_extract("content", FROM, 1)).otherwise(F.regexp_extract("content", IMPORT, 1))
    rows = rows.select("file", "line", F.lit(0).alias("pos"), module.alias("module")).where("module <> ''")
    return rows.withColumn("path", module_path(F.col("module"), ".py"))


def _java(code: DataFrame, intent: bool) -> DataFrame:
    rows = _of(code, "java")
    if intent:
        rows = rows.where(F.col("content").rlike(r"^import\s"))
    dotted = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace("content", "^import ", ""), "^static ", ""), ";$", ""))
    rows = rows.select("file", "line", F.lit(0).alias("pos"), dotted.alias("module")).where(F.contains("module", F.lit(".")))
    return rows.withColumn("last", F.substring_index("module", ".", -1)).withColumn("pkg", F.regexp_replace("module", r"\.[^.]*$", ""))


def java_imports(code: DataFrame, intent: bool = False) -> DataFrame:
    """Every line with a dot counts, unless ``intent`` asks for import lines."""
    rows = _java(code, intent).where("last <> '*'")
    return rows.select("file", "line", "pos", F.col("last").alias("short_name"), module_path(F.col("module"), ".java").alias("full_path"), F.lit("").alias("alias"))


def java_modules(code: DataFrame, intent: bool = False) -> DataFrame:
    path = F.when(F.col("last") == "*", module_path(F.col("pkg"), "/")).otherwise(module_path(F.col("module"), ".java"))
    return _java(code, intent).select("file", "line", "pos", "module", path.alias("path"))


def quoted(text: Column) -> Column:
    """All strings in double quotes."""
    return F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))


def go_modules(code: DataFrame) -> DataFrame:
    """Every quoted string of a line, by its last part; the word before it names it too."""
    rows = _of(code, "go").select("file", "line", "content", F.posexplode(quoted(F.col("content"))).alias("k", "value"))
    own = rows.select("file", "line", (2 * F.col("k")).alias("pos"), F.substring_index("value", "/", -1).alias("module"), F.when(F.contains("value", F.lit(".")), F.col("value")).otherwise(F.concat("value", F.lit("/"))).alias("path"))
    # where the value stands last in the line; what comes before its quote
    last = F.expr("length(content) - length(value) - instr(reverse(content), reverse(value)) + 1")
    before = trimmed(F.expr("substring(content, 1, idx - 1)"))
    named = rows.withColumn("idx", last).where("idx > 0").withColumn("before", before).where("before <> '' and not contains(before, '\"')")
    named = named.select("file", "line", (2 * F.col("k") + 1).alias("pos"), F.element_at(F.split("before", r"\s+"), -1).alias("module"), F.col("value").alias("path"))
    return own.unionByName(named)


def rust_imports(code: DataFrame) -> DataFrame:
    """``use a::b::C;``: the last part is the name, the rest the path."""
    rows = _of(code, "rust").where(F.col("content").startswith("use ")).withColumn("parts", F.split(F.substring("content", 5, 2**31 - 1), "::"))
    name = F.regexp_replace(F.regexp_replace(F.element_at("parts", -1), ";$", ""), "}$", "")
    path = F.concat(F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/"), F.lit(".rs"))
    return rows.select("file", "line", F.lit(0).alias("pos"), name.alias("short_name"), path.alias("full_path"), F.lit("").alias("alias"))


def rust_modules(code: DataFrame) -> DataFrame:
    return rust_imports(code).select("file", "line", "pos", F.col("short_name").alias("module"), F.col("full_path").alias("path"))


def imports(code: DataFrame, intent: bool = False) -> DataFrame:
    """(file, ord, short_name, full_path, alias) of all languages; ord is the order in the file."""
    rows = python_imports(code).unionByName(java_imports(code, intent)).unionByName(rust_imports(code))
    order = F.row_number().over(W.partitionBy("file").orderBy("line", "pos")) - 1
    return rows.select("file", order.cast("int").alias("ord"), "short_name", "full_path", "alias")


def file_modules(code: DataFrame, intent: bool = False) -> DataFrame:
    """(file, module, path): within a file the last mention of a module holds."""
    rows = python_modules(code).unionByName(java_modules(code, intent)).unionByName(go_modules(code)).unionByName(rust_modules(code))
    return rows.groupBy("file", "module").agg(F.max_by("path", F.struct("line", "pos")).alias("path"))


def node_modules(nodes: DataFrame) -> DataFrame:
    """(module, path) from the files of nodes: dotted paths of Python and Java files, and each
    directory by its name.  A dotted path beats a directory; of two, the smaller file or directory."""
    files = nodes.select("file").distinct()
    stem = lambda ext: F.replace(F.regexp_replace("file", f"\\{ext}$", ""), F.lit("/"), F.lit("."))
    python = files.where(F.col("file").endswith(".py")).select(F.regexp_replace(stem(".py"), r"\.__init__$", "").alias("module"), F.col("file").alias("path"), F.lit(0).alias("prio"))
    java = files.where(F.col("file").endswith(".java")).select(stem(".java").alias("module"), F.col("file").alias("path"), F.lit(0).alias("prio"))
    dirs = files.select(dir_name(F.col("file")).alias("dir")).where("dir <> '.'").distinct()
    dirs = dirs.select(base_name(F.col("dir")).alias("module"), F.concat("dir", F.lit("/")).alias("path"), F.lit(1).alias("prio"))
    rows = python.unionByName(java).unionByName(dirs)
    return rows.groupBy("module").agg(F.min(F.struct("prio", "path")).alias("best")).select("module", "best.path")


def merged_modules(from_nodes: DataFrame, from_files: DataFrame) -> DataFrame:
    """(module, path): what nodes say first, then what files say, in the order of files."""
    rows = from_nodes.select("module", "path", F.lit("").alias("file"), F.lit(0).alias("prio")).unionByName(from_files.select("module", "path", "file", F.lit(1).alias("prio")))
    return rows.groupBy("module").agg(F.min(F.struct("prio", "file", "path")).alias("best")).select("module", "best.path")


# fixed values: variable = Type(, variable: Type, variable: List[Type; Type variable =, List<Type> variable
ASSIGN = r"(\w+)\s*=\s*(\w+)\("
PARAM = r"(\w+)\s*:\s*(\w+)"
GENERIC = r"(\w+)\s*:\s*(?:List|Optional|Dict)\[(\w+)"
JAVA_DECL = r"(\w+)\s+(\w+)\s*="
JAVA_GENERIC = r"(?:List|Optional|Map)<(\w+)>\s+(\w+)"


def _first_hit(rows: DataFrame, patterns: list[tuple[str, int, int]]) -> DataFrame:
    """(file, var, type): the first pattern that a line has, the last line of a variable."""
    hit = None
    for regex, var, kind in patterns:
        found = F.struct(F.regexp_extract("content", regex, var).alias("var"), F.regexp_extract("content", regex, kind).alias("type"))
        hit = F.when(F.col("content").rlike(regex), found) if hit is None else hit.when(F.col("content").rlike(regex), found)
    rows = rows.select("file", "line", hit.alias("hit")).where("hit is not null").select("file", "line", "hit.var", "hit.type")
    return rows.groupBy("file", "var").agg(F.max_by("type", "line").alias("type"))


def python_vars(code: DataFrame, intent: bool = False) -> DataFrame:
    """A plain annotation hides a container's; with ``intent`` the element type is seen first."""
    order = [(ASSIGN, 1, 2), (GENERIC, 1, 2), (PARAM, 1, 2)] if intent else [(ASSIGN, 1, 2), (PARAM, 1, 2), (GENERIC, 1, 2)]
    return _first_hit(_of(code, "python"), order)


def java_vars(code: DataFrame) -> DataFrame:
    return _first_hit(_of(code, "java"), [(JAVA_DECL, 2, 1), (JAVA_GENERIC, 2, 1)])


def var_map(code: DataFrame, intent: bool = False) -> DataFrame:
    return python_vars(code, intent).unionByName(java_vars(code))
