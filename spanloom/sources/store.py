"""The index: one Parquet table for each relation, by version, in a folder.

Tables are written to new places; then a file ``_versions/<number>`` names the
place of each, and the highest number holds.  So readers see a whole version,
and a writer that is lost leaves none.  Tables that an update doesn't give stay
where they are.  The last KEEP versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.schema import TABLES, VERSION

#: what a table is sorted by, so that lookups skip row groups by their bounds; edges lie there by either end
SORTED = {"nodes": ("name", "id"), "edges": ("dst", "src"), "edges_by_src": ("src", "dst"), "sinks": ("src",), "files": ("path",)}
COPIES = {"edges_by_src": "edges"}
KEEP = 2


def _fs(spark: SparkSession, path: str):
    """Spark's file system of a path, and its path class."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, make = _fs(spark, folder)
    at = make(f"{folder}/_versions")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []


def _entry(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/_versions/{number}", wholetext=True).first()[0])


def save(graph: dict[str, DataFrame], folder: str, version: str = VERSION) -> None:
    """Write the given relations, empty ones too, as a new version of the index."""
    spark = next(iter(graph.values())).sparkSession
    numbers = _versions(spark, folder)
    tables = _entry(spark, folder, numbers[-1])["tables"] if numbers else {}
    graph = graph | {copy: graph[name] for copy, name in COPIES.items() if name in graph}
    for name, df in graph.items():
        keys = SORTED.get(name)
        out = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        tables[name] = f"{name}-{uuid.uuid4().hex}"
        out.write.parquet(f"{folder}/{tables[name]}")
    number = numbers[-1] + 1 if numbers else 1
    fs, make = _fs(spark, folder)
    temporary, final = make(f"{folder}/_versions/.{uuid.uuid4().hex}"), make(f"{folder}/_versions/{number}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
    out.close()
    if not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise RuntimeError(f"version {number} of {folder} was written by another")
    for old in numbers[: 1 - KEEP or None]:
        kept = {t for n in [*numbers[1 - KEEP :], number] for t in _entry(spark, folder, n)["tables"].values()}
        for t in set(_entry(spark, folder, old)["tables"].values()) - kept:
            fs.delete(make(f"{folder}/{t}"), True)
        fs.delete(make(f"{folder}/_versions/{old}"), False)


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The named relations, or all; nothing is read before it is used, and those not written are empty."""
    numbers = _versions(spark, folder)
    if not numbers:
        raise FileNotFoundError(f"no index in {folder}")
    entry = _entry(spark, folder, numbers[-1])
    if entry["version"] != VERSION:
        raise ValueError(f"the index has version {entry['version']}, not {VERSION}: index again")
    found = {}
    for name in names or (*TABLES, *COPIES):
        kind = TABLES[COPIES.get(name, name)]
        place = entry["tables"].get(name)
        found[name] = spark.read.schema(kind).parquet(f"{folder}/{place}") if place else spark.createDataFrame([], kind)
    return found


def annotations_of(index: dict[str, DataFrame], node_id: str) -> DataFrame:
    """The annotations of a node."""
    return index["annotations"].where(index["annotations"]["node_id"] == node_id)


def annotate(index: dict[str, DataFrame], new: DataFrame) -> DataFrame:
    """All annotations with new ones; one with the id of an old one takes its place."""
    kept = index["annotations"].join(new.select("id").distinct(), "id", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def export_json(graph: dict[str, DataFrame], folder: str) -> None:
    for name, df in graph.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def import_json(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(kind).json(f"{folder}/{name}") for name, kind in TABLES.items()}
