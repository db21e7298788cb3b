"""Quality rules: fixed base rules, then boosted trees over document statistics.

The trees learn ``labels.quality``: those of the query from a bounded sample of
labelled documents (``SAMPLE`` rows, chosen by the hash of their id), those of
the pipeline from all of them, both outside the held-out fold.
Their score may only fall with the shares of symbols, repeated lines, repeated
words, upper case, exclamation marks and bars.  Statistics and verdicts cover
every document's whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.batches import give_back, parts, small_batches
from spanloom.llm.boosted_trees import Forest, train
from spanloom.llm.learning import all_labels, fold, labelled_texts
from spanloom.llm.text_stats import FEATURES, features
from spanloom.llm.whole_trees import train_whole

SAMPLE = 8000
HELD_OUT = (5, 0)
THRESHOLD = 0.5
FALLING = ("symbols_a_word", "dup_lines_share", "repeat_words_share", "upper_share", "bang_share", "pipe_share", "top_word_share")
MONOTONE = np.asarray([-1 if f in FALLING else 0 for f in FEATURES])


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Forest:
    """Trees from at most ``most`` labelled documents.  Features are made where
    the texts are; the driver gets one short row a sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py() or "")[1] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["id", "x", "y"])

    rows = labelled_texts(docs, labels, "quality", most, HELD_OUT)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, x array<double>, y int").toPandas().sort_values("id", kind="stable")
    if not len(found):
        return train(np.empty((0, len(FEATURES))), np.empty(0), MONOTONE)
    return train(np.stack(found["x"].to_list()), found["y"].to_numpy(float), MONOTONE)


def fit_whole(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Trees from every labelled document.  Features are made where the texts
    are, before the labels are joined to them, so that no text is moved.  The
    join is never a broadcast: the Python that follows it would run in the tasks
    that make the features, and an executor hold two workers a core from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                x = [np.asarray(features(t.as_py() or "")[1]).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], names=["id", "x"])
        give_back()

    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    own = own.where(fold(F.col("id"), HELD_OUT[0]) != HELD_OUT[1])
    kind = own.schema["id"].dataType.simpleString()
    rows = own.mapInArrow(run, f"id {kind}, x binary").join(all_labels(labels, "quality", HELD_OUT).hint("merge"), F.col("id") == F.col("doc_id"))
    return train_whole(rows.select("x", "y"), MONOTONE)


def verdicts(texts: list[str], forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base counts, base_failed, probability) of each text."""
    both = [features(t) for t in texts]
    counts = np.asarray([s for s, _ in both], np.int64).reshape(-1, 5)
    x = np.asarray([f for _, f in both]).reshape(-1, len(FEATURES))
    failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
    return counts, failed, forest.probability(x)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Null text has no words and fails the base rules, as do texts under ten
    words.  Rows are independent, so repeated rows repeat; an empty table gives
    no rows.  Without usable labels the trees keep what passes the base rules.
    Only id and text are read.
    """
    forest = fit(docs, labels, most)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                counts, failed, p = verdicts([t.as_py() or "" for t in part.column(1)], forest)
                kept = ~failed & (p >= THRESHOLD)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(p)], names=names)
        give_back()

    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, training: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    ``training`` has the texts that the labels speak of; the trees learn from all of them.
    """
    small_batches(docs.sparkSession)
    forest = fit_whole(training, labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, at):
                _, failed, p = verdicts([t.as_py() or "" for t in part.column(at)], forest)
                yield part.filter(pa.array(~failed & (p >= THRESHOLD)))
        give_back()

    return docs.mapInArrow(run, docs.schema)
