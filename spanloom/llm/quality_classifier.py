"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed into 2 ** BITS buckets: words alone
and in pairs, and the shapes of one to four words in a row, where a word's
shape has its letters, capitals and digits folded and a word equal to the one
before it is only that.  Each indicator is scaled by the log ratio of its
smoothed counts in the two classes, the vectors by their count of indicators;
a linear hinge-loss model is fitted by dual coordinate descent.

It learns from a bounded sample of labelled documents (``SAMPLE`` rows by the
hash of their id, outside the held-out fold); every document is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.batches import make_room
from spanloom.llm.learning import fold, labelled_texts

BITS = 18
SAMPLE = 6000
HELD_OUT = (5, 0)
THRESHOLD = 0.3
LEAST = 3
_FOLD = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_SAME = np.uint64(0x5EED)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_words: dict[bytes, int] = {}


def _of_word(w: bytes) -> int:
    """Two 32-bit hashes in one number: of the word in lower case, and of its shape."""
    make_room(_words)
    shape = _RUN.sub(rb"\1", w.translate(_FOLD))
    found = zlib.crc32(w.lower()) << 32 | zlib.crc32(shape)
    if len(w) <= 64:
        _words[w] = found
    return found


def indicators(text: str) -> np.ndarray:
    """The sorted buckets of the n-grams that a whole text has."""
    found = text.encode().split()
    if not found:
        return np.empty(0, np.int32)
    both = list(map(_words.get, found))
    if None in both:
        both = [_words[w] if w in _words else _of_word(w) for w in found]
    both = np.asarray(both, np.uint64)
    lex, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(both), bool)
    same[1:] = both[1:] == both[:-1]
    shape = np.where(same, _SAME, shape)
    out = []
    for kind, (ids, most) in enumerate(((lex, 2), (shape, 4))):
        h = np.zeros(len(ids), np.uint64)
        for n in range(1, most + 1):
            if len(ids) < n:
                break
            h = (h[: len(ids) - n + 1] * _M2) ^ ((ids[n - 1 :] + np.uint64(8 * kind + n)) * _M1)
            h ^= h >> np.uint64(31)
            out.append((h * _M1) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(out)).astype(np.int32)


@dataclass
class Linear:
    """weight: of each bucket's indicator, the log-count ratio in it."""

    weight: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        m = self.bias + (float(self.weight[buckets].sum()) / np.sqrt(len(buckets)) if len(buckets) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(2 * m, -30, 30))))


def train(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 12) -> Linear:
    """Log-count ratios, then dual coordinate descent over shuffled rows.

    Buckets in fewer than LEAST rows carry nothing.  With one class only, the
    model is a constant on that class's side.
    """
    size = 1 << BITS
    if not len(y) or len(np.unique(y)) < 2:
        return Linear(np.zeros(size), 1.0 if not len(y) or y[0] else -1.0)
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c] or [np.empty(0, np.int32)]), minlength=size) for c in (0, 1)]
    p, q = counts[1] + 1.0, counts[0] + 1.0
    ratio = np.where(counts[0] + counts[1] >= LEAST, np.log((p / p.sum()) / (q / q.sum())), 0.0)
    x = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    sign = np.where(y > 0, 1.0, -1.0)
    square = np.asarray([v @ v + 1.0 for v in x])
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    random = np.random.default_rng(5)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(y)):
            g = sign[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                worst = max(worst, abs(step))
                alpha[i] = new
                w[rows[i]] += step * x[i]
                bias += step
        if worst < 1e-4:
            break
    return Linear(w * ratio, bias)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """The model from at most ``most`` labelled documents; buckets are made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [indicators(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.int32())), b.column(2)], names=["id", "x", "y"])

    rows = labelled_texts(docs, labels, "quality", most, HELD_OUT, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, x array<int>, y int").toArrow().sort_by("id")
    return train([np.asarray(v.values) for v in found.column("x")], found.column("y").to_numpy())


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """Per document: id, held_out, score (higher: better), predicted (1 from THRESHOLD on).

    Null and empty texts have no indicators and get the score of the bias; a
    null id isn't held out.  Rows are independent, so repeated rows repeat; an
    empty table gives no rows.  Only id and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            s = [m.score(indicators(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[id_col, "score"])

    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    held = F.coalesce(fold(F.col(f"`{id_col}`"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    scored = own.mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(F.col(f"`{id_col}`"), held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
