"""Lookups and traversals over nodes, edges and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.names import package_contains
from spanloom.session import cut

DEPTH = 10


def node_by_id(nodes: DataFrame, node_id: str, order: str | None = None) -> DataFrame:
    """The node of an id; of several the last in ``order``, a column of nodes."""
    found = nodes.where(F.col("id") == node_id)
    return found.orderBy(F.desc(order)).limit(1) if order else found


def nodes_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def _named(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"), F.col("file").alias(f"{prefix}_file"), F.col("line").alias(f"{prefix}_line"))


def _met(hit: DataFrame, nodes: DataFrame, end: str, role: str, own: str) -> DataFrame:
    """Edges with the node at one end."""
    return hit.join(_named(nodes, role), F.col(end) == F.col(f"{role}_id")).select(own, *(f"{role}_{x}" for x in ("id", "name", "file", "line")), "file", "line")


def callers(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each edge into a target (a column id); edges from unknown nodes drop out."""
    hit = edges.join(targets.select(F.col("id").alias("dst")).distinct(), "dst")
    return _met(hit, nodes, "src", "caller", "dst")


def callees(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each edge out of a source; edges to unknown nodes drop out."""
    hit = edges.join(sources.select(F.col("id").alias("src")).distinct(), "src")
    return _met(hit, nodes, "dst", "callee", "src")


def callers_of(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """The callers of one node; the filter reaches the scan of edges, sorted by dst."""
    return _met(edges.where(F.col("dst") == node_id), nodes, "src", "caller", "dst")


def callees_of(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """What one node calls; best over edges sorted by src."""
    return _met(edges.where(F.col("src") == node_id), nodes, "dst", "callee", "src")


def sinks_of(sinks: DataFrame, node_id: str) -> DataFrame:
    return sinks.where(F.col("src") == node_id)


def sinks_with_caller(sinks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every sink with its caller's name and place, null where the caller is unknown."""
    return sinks.join(_named(nodes, "caller"), F.col("src") == F.col("caller_id"), "left").select("src", "callee_name", "pkg", "file", "line", "caller_name", "caller_file", "caller_line")


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = DEPTH, paths: bool = True) -> DataFrame:
    """(start, node, depth[, path]): one shortest path to every node in reach of each start.

    Breadth first with one set of visited nodes a start; depth counts nodes, so
    the start has 1 and nothing beyond max_depth is visited.  Of several parents on the level before, the
    smallest id leads.  A round is one join with the edges, one aggregate and
    one anti join, cut off in the shared folder; hubs meet partial aggregates.
    """
    pairs = cut(edges.select("src", "dst").distinct())
    start = starts.select(F.col("id").alias("start")).distinct()
    visited = start.select("start", F.col("start").alias("node"), F.lit(1).alias("depth"))
    if paths:
        visited = visited.withColumn("path", F.array("start"))
    front = visited = cut(visited)
    for depth in range(2, max_depth + 1):
        met = front.join(pairs, F.col("node") == F.col("src"))
        if paths:
            new = met.groupBy("start", F.col("dst").alias("node")).agg(F.min_by("path", "src").alias("path")).withColumn("path", F.concat("path", F.array("node")))
        else:
            new = met.select("start", F.col("dst").alias("node")).distinct()
        new = new.join(visited.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        front = cut(new.select(*visited.columns))
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited


def reachable(edges: DataFrame, sinks: DataFrame, starts: DataFrame, pattern: str, max_depth: int = DEPTH) -> DataFrame:
    """(start, node, depth, callee_name, path): a path ending in each matching sink of each node in reach."""
    found = reach(edges, starts, max_depth)
    hits = sinks.where(package_contains(F.col("pkg"), pattern)).select("src", "callee_name")
    met = found.join(hits, F.col("node") == F.col("src"))
    return met.select("start", "node", "depth", "callee_name", F.concat("path", F.array("callee_name")).alias("path"))


def rendered(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths with ids replaced by names where known: adds ``shown``, joined by arrows."""
    key = ["start", "node", "callee_name"]
    steps = paths.select(*key, F.posexplode("path").alias("pos", "step")).distinct()
    named = steps.join(nodes.groupBy(F.col("id").alias("step")).agg(F.max("name").alias("name")), "step", "left")
    shown = named.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "step").alias("n")))), lambda x: x["n"]), " -> ").alias("shown"))
    return paths.join(shown, key)
