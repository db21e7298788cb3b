"""From parsed files to a whole code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import imports as imp
from spanloom.operators.resolve import resolve
from spanloom.session import cut
from spanloom.sources import ast_xml


def extract(files: DataFrame, trees: DataFrame, intent: bool = False) -> dict[str, DataFrame]:
    """What each file owns, from files (path, ..., text) and trees (file, language, xml).

    Trees are walked once and kept in the shared folder, as several relations
    come from that walk.  With ``intent`` dotted calls are resolved too.
    """
    rows = cut(ast_xml.walked(trees, intent))
    calls, sinks = ast_xml.calls_of(rows), ast_xml.sinks_of(rows)
    if intent:
        calls = calls.unionByName(sinks.where("src <> ''").select("src", "callee_name", F.lit("calls").alias("kind"), "file", "line"))
    code = imp.code_lines(files.select(F.col("path").alias("file"), "language", "text"), intent)
    return {
        "files": files.select("path", "abs_path", "language", "size", "mtime", "is_test"), "nodes": ast_xml.nodes_of(rows), "calls": calls, "sinks": sinks,
        "imports": imp.imports(code, intent), "modules": imp.file_modules(code, intent), "vars": imp.var_map(code, intent), "parse_errors": ast_xml.errors_of(rows),
    }


def derived(owned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What follows from all files together: the module map, resolved edges, the manifest."""
    modules = imp.merged_modules(imp.node_modules(owned["nodes"]), owned["modules"])
    edges = resolve(owned["calls"], owned["nodes"], owned["imports"], modules, owned["vars"])
    return {"mod_map": modules, "edges": edges.select("src", "dst", "kind", "file", "line", "call_file", "call_line"), "manifest": owned["files"].select("path", "mtime")}


def build(files: DataFrame, trees: DataFrame, intent: bool = False) -> dict[str, DataFrame]:
    """All relations of a code graph."""
    owned = extract(files, trees, intent)
    return owned | derived(owned)
