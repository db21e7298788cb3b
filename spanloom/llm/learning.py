"""Labelled rows, all or bounded samples, and hashes that learners share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(id_col.cast("string")) % n


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of their id: a uniform sample
    that doesn't depend on order or partitions.  ``rows`` should be narrow."""
    return rows.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(most)


def all_labels(labels: DataFrame, target: str, held_out: tuple[int, int]) -> DataFrame:
    """(doc_id, y) outside a fold.  Null ids and null labels take no part; an id with
    several labels counts once, with its largest."""
    n, rest = held_out
    rows = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), n) != rest)
    return rows.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, most: int, held_out: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of a bounded sample of labelled documents outside a fold.

    The sample is drawn from the labels alone; its ids, at most ``most``, are
    broadcast to the documents.  Null ids and null labels take no part.  An id
    with several labels counts once, with its largest.
    """
    chosen = sampled(all_labels(labels, target, held_out), "doc_id", most).withColumnRenamed("doc_id", "chosen")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).select("id", "text", "y")
