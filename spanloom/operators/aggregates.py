"""Counts, groups and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.names import package_listed, symbol_listed


def sinks_by_package(sinks: DataFrame, rows: bool = False) -> DataFrame:
    """(pkg, cnt[, sinks]).  The nested rows are for export: counts alone combine before the shuffle."""
    cols = [F.count(F.lit(1)).alias("cnt")]
    if rows:
        cols.append(F.array_sort(F.collect_list(F.struct("file", "line", "src", "callee_name"))).alias("sinks"))
    return sinks.groupBy("pkg").agg(*cols)


def package_listing(sinks: DataFrame, pattern: str = "") -> DataFrame:
    """(pkg, cnt) of the packages that match, filtered before they are counted."""
    return sinks_by_package(sinks.where(package_listed(F.col("pkg"), pattern)))


def symbol_listing(hits: DataFrame, sinks: DataFrame, pattern: str = "") -> DataFrame:
    """(id, name, cnt): matching sinks of each hit that has any."""
    met = hits.select("id", "name").join(sinks, F.col("id") == F.col("src"))
    if pattern:
        met = met.where(symbol_listed(F.col("pkg"), F.col("callee_name"), pattern))
    return met.groupBy("id", "name").agg(F.count(F.lit(1)).alias("cnt"))


def summary(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, cnt) for files, nodes and edges."""
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(kind).alias("kind"), "cnt")
    return count(files, "files").unionByName(count(nodes, "nodes")).unionByName(count(edges, "edges"))


def distribution(nodes: DataFrame) -> DataFrame:
    """(letter, cnt) by the first letter of a name in upper case; empty names are left out."""
    return nodes.where("name <> ''").groupBy(F.upper(F.substring("name", 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("cnt"))


def languages(files: DataFrame) -> DataFrame:
    return files.select("language").distinct()


def missing_languages(files: DataFrame, installed: DataFrame) -> DataFrame:
    return languages(files).join(installed.select("language"), "language", "left_anti")


def outline(nodes: DataFrame, file: str) -> DataFrame:
    """Symbols of the files whose path ends with ``file``, by line."""
    return nodes.where(F.col("file").endswith(file)).select("file", "name", "line", "column", "id").orderBy("line", "column", "name", "id")
