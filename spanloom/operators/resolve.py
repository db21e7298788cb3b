"""Calls by name to edges between nodes.

All candidates of a call are joined, ranked by (strategy, import order, node
order) and the best one is kept: one aggregate, no row-by-row cascade.
``nodes`` carry ``ord``, their order; ``raw`` calls are (src, callee_name,
kind, file, line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.names import dir_name, method_of, object_of

SAME_FILE, DOTTED, PLAIN = 1, 2, 3


def with_order(nodes: DataFrame) -> DataFrame:
    """Nodes with a total order, if they have none: file, line, column, name."""
    return nodes if "ord" in nodes.columns else nodes.withColumn("ord", F.struct("file", "line", "column", "name"))


def _calls(raw: DataFrame) -> DataFrame:
    """Distinct calls with a key of their own and their parts."""
    rows = raw.groupBy("src", "callee_name", "kind", "file", "line").agg(F.count(F.lit(1)).alias("times"))
    return rows.withColumn("obj", object_of(F.col("callee_name"))).withColumn("method", method_of(F.col("callee_name")))


KEY = ["src", "callee_name", "kind", "file", "line"]


def _in_file(nodes: DataFrame) -> DataFrame:
    """The first node of each name in each file."""
    return with_order(nodes).groupBy(F.col("file").alias("in_file"), F.col("name").alias("in_name")).agg(F.min_by("id", "ord").alias("dst"))


def same_file(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls with the node of that name in their own file."""
    met = _calls(raw).join(_in_file(nodes), (F.col("file") == F.col("in_file")) & (F.col("callee_name") == F.col("in_name")))
    return met.select(*KEY, "times", "dst", F.lit(SAME_FILE).alias("strategy"), F.lit(0).alias("import_ord"), F.col("in_file").alias("dst_file"))


def import_targets(names: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, name, path) of (file, name): the first import with that short name or alias in
    any case; else the module of that name, of several the smallest."""
    keys = names.select("file", "name").distinct().withColumn("key", F.lower("name"))
    by_name = imports.select("file", "ord", "full_path", F.explode(F.array_distinct(F.array(F.lower("short_name"), F.lower("alias")))).alias("key"))
    found = keys.join(by_name, ["file", "key"]).select("file", "name", F.struct(F.lit(0).alias("prio"), F.col("ord").alias("ord"), F.lit("").alias("module"), F.col("full_path").alias("path")).alias("hit"))
    mods = modules.select(F.lower("module").alias("key"), "module", "path")
    found = found.unionByName(keys.join(mods, "key").select("file", "name", F.struct(F.lit(1).alias("prio"), F.lit(0).alias("ord"), "module", "path").alias("hit")))
    return found.groupBy("file", "name").agg(F.min("hit")["path"].alias("path"))


def dotted(raw: DataFrame, nodes: DataFrame, imports: DataFrame, modules: DataFrame, vars_: DataFrame) -> DataFrame:
    """Calls obj.method with the node in the file that obj, or the type of the variable obj, is imported from."""
    calls = _calls(raw).where("obj <> '' and method <> ''")
    types = vars_.select(F.col("file").alias("f"), F.col("var").alias("v"), "type")
    typed = calls.select("file", "obj").distinct().join(types, (F.col("file") == F.col("f")) & (F.col("obj") == F.col("v")), "left").select("file", "obj", "type")
    names = typed.select("file", F.explode(F.array("obj", "type")).alias("name")).where("name is not null")
    targets = import_targets(names, imports, modules)
    t = lambda n: targets.select(F.col("file").alias(f"f{n}"), F.col("name").alias(f"n{n}"), F.col("path").alias(f"p{n}"))
    typed = typed.join(t(1), (F.col("file") == F.col("f1")) & (F.col("obj") == F.col("n1")), "left").join(t(2), (F.col("file") == F.col("f2")) & (F.col("type") == F.col("n2")), "left")
    typed = typed.select(F.col("file").alias("tf"), F.col("obj").alias("to"), F.coalesce("p1", "p2").alias("target")).where("target is not null")
    met = calls.join(typed, (F.col("file") == F.col("tf")) & (F.col("obj") == F.col("to"))).join(_in_file(nodes), (F.col("target") == F.col("in_file")) & (F.col("method") == F.col("in_name")))
    return met.select(*KEY, "times", "dst", F.lit(DOTTED).alias("strategy"), F.lit(0).alias("import_ord"), F.col("in_file").alias("dst_file"))


def imported(raw: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """Plain names with the node of that name in any imported file, imports in order."""
    calls = _calls(raw).where("obj = ''")
    files = imports.select(F.col("file").alias("imp_file"), F.col("ord").alias("import_ord"), "full_path")
    met = calls.join(files, F.col("file") == F.col("imp_file")).join(_in_file(nodes), (F.col("full_path") == F.col("in_file")) & (F.col("method") == F.col("in_name")))
    return met.select(*KEY, "times", "dst", F.lit(PLAIN).alias("strategy"), "import_ord", F.col("in_file").alias("dst_file"))


def resolve(raw: DataFrame, nodes: DataFrame, imports: DataFrame, modules: DataFrame, vars_: DataFrame) -> DataFrame:
    """(src, dst, kind, file, line, call_file, call_line, callee_name, strategy): the best candidate
    of each call; calls without one drop out.

    As in the index format, line is 0 and file the callee's file; where the call
    stands is in call_file and call_line.
    """
    found = same_file(raw, nodes).unionByName(dotted(raw, nodes, imports, modules, vars_)).unionByName(imported(raw, nodes, imports))
    best = found.groupBy(*KEY, "times").agg(F.min(F.struct("strategy", "import_ord", "dst", "dst_file")).alias("b"))
    best = best.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return best.select("src", "b.dst", "kind", F.col("b.dst_file").alias("file"), F.lit(0).alias("line"), F.col("file").alias("call_file"), F.col("line").alias("call_line"), "callee_name", "b.strategy")


def by_name(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node of the called name: the rule for a single changed file."""
    return raw.join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("callee_name")), "callee_name").select("src", "dst", "kind", "file", "line", "callee_name")


def same_dir(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first node of the name in the call's file, else in its directory."""
    calls = _calls(raw).withColumn("dir", dir_name(F.col("file")))
    own = same_file(raw, nodes).select(*KEY, "times", "dst", F.lit(1).alias("prio"), F.col("dst_file").alias("at"))
    near = with_order(nodes).withColumn("dir", dir_name(F.col("file"))).groupBy(F.col("dir").alias("d"), F.col("name").alias("n")).agg(F.min_by("id", "ord").alias("dst"))
    near = calls.join(near, (F.col("dir") == F.col("d")) & (F.col("callee_name") == F.col("n"))).select(*KEY, "times", "dst", F.lit(2).alias("prio"), F.col("dir").alias("at"))
    best = own.unionByName(near).groupBy(*KEY).agg(F.min(F.struct("prio", "dst")).alias("b"))
    return best.select("src", "b.dst", "kind", "file", "line", "callee_name")
