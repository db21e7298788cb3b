"""Keeping an index live: events of changed files to replaced rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from spanloom.build import derived
from spanloom.schema import OWNED
from spanloom.session import cut
from spanloom.sources import store
from spanloom.sources.scan import TreeChanges


def without_files(table: DataFrame, files: DataFrame, owner: str = "file") -> DataFrame:
    """The rows that belong to none of the files (path)."""
    return table.join(files.select(F.col("path").alias(owner)).distinct(), owner, "left_anti").select(*table.columns)


def replace_by_file(table: DataFrame, new: DataFrame, files: DataFrame, owner: str = "file") -> DataFrame:
    """The rows of the files exchanged for new ones; files without new rows lose theirs."""
    return without_files(table, files, owner).unionByName(new)


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path: (path, op) by mtime, a removal last among equals."""
    return events.groupBy("path").agg(F.max_by("op", F.struct("mtime", (F.col("op") == "remove").cast("int"))).alias("op"))


def debounce(events: DataFrame, gap: str, key: str = "path", time: str = "ts") -> DataFrame:
    """Bursts: events of a key closer than the gap are one, with its count and its ends.  For streams too."""
    return events.groupBy(key, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("events"), F.min(time).alias("first"), F.max(time).alias("last")).drop("session_window")


def needs_rebuild(files: DataFrame, indexed: DataFrame, most: int = 10) -> DataFrame:
    """One row: whether the numbers of files differ by more than ``most``."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(files, "now").join(count(indexed, "indexed")).select("now", "indexed", (F.abs(F.col("now") - F.col("indexed")) > most).alias("rebuild"))


def apply_events(spark: SparkSession, folder: str, events: DataFrame, extract: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
    """Bring the index in a folder up to date with events (path, op, mtime).

    ``extract`` gives what written files (path) own, by relation.  Only those
    are parsed; module map and edges follow anew from the stored relations of
    all files, so the index is what a build of the whole tree would give.  The
    result is a new version of the index; readers of the old one go on with it.
    """
    last = cut(last_events(events))
    new = extract(last.where("op <> 'remove'").select("path"))
    index = store.load(spark, folder, *OWNED)
    owned = {}
    for name, owner in OWNED.items():
        rows = index[name]
        owned[name] = cut(replace_by_file(rows, new[name].select(*rows.columns), last, owner) if name in new else without_files(rows, last, owner))
    store.save(owned | derived(owned), folder)


class Errors(StreamingQueryListener):
    """Tells of a stream that ends by an error: ``told`` gets the name and the message."""

    def __init__(self, told: Callable[[str, str], None]):
        self.told = told
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.runId), str(event.id))
        if event.exception:
            self.told(name, event.exception)


def watch(spark: SparkSession, root: str, folder: str, checkpoint: str, extract: Callable[[DataFrame], dict[str, DataFrame]], interval: str = "200 milliseconds") -> StreamingQuery:
    """Follow a source tree; each micro-batch, the debounced changes of one interval, replaces its files' rows.

    Snapshots of the tree lie beside the checkpoint: a stream that starts again
    also sees what was written and removed meanwhile, and every file counts as
    new to one that starts first.
    """
    spark.dataSource.register(TreeChanges)
    events = spark.readStream.format("tree_changes").option("path", root).option("state", f"{checkpoint}-snapshots").load()
    return (
        events.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval)
        .foreachBatch(lambda batch, _: None if batch.isEmpty() else apply_events(spark, folder, batch, extract)).start()
    )
