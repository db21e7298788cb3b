"""Token counts by prefix dynamic programming.

For every prefix of a text the exact number of ids of its own encoding is known
from the counts of shorter prefixes (``PieceModel.last_pieces``).  A text is the
sum of its spans between safe cuts, and spans repeat, so each worker keeps the
prefix counts of the spans that it has met.  Truncation and budget questions
read these counts and encode nothing again.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.batches import make_room
from spanloom.llm.pieces import PieceModel, load

_last = itemgetter(-1)


class PrefixCounts:
    """Counts of ids at every prefix, for the texts of one vocabulary."""

    def __init__(self, model: PieceModel):
        if model.kind != "bpe":
            raise ValueError("prefix counts are defined for BPE models")
        self.model = model
        self._spans: dict[str, bytes | list[int]] = {}

    def of_span(self, span: str) -> bytes | list[int]:
        """Counts after 1, 2, ... characters of a span between safe cuts."""
        known = self._spans.get(span)
        if known is None:
            count = self.model.last_pieces(span)[1][1:]
            known = bytes(count) if count[-1] < 200 and max(count) < 256 else count
            if len(span) <= 64:  # longer spans hardly repeat
                make_room(self._spans)
                self._spans[span] = known
        return known

    def _of_spans(self, text: str) -> list:
        spans = self.model.spans(self.model.normalized(text))
        found = list(map(self._spans.get, spans))
        if None in found:
            of = self.of_span
            found = [of(s) if k is None else k for s, k in zip(spans, found, strict=True)]
        return found

    def total(self, text: str) -> int:
        """Ids of the whole text: the count at its last prefix."""
        return sum(map(_last, self._of_spans(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """Counts for the first 0, 1, 2, ... code points of the text."""
        if not self.model.plain:
            raise ValueError("the model's normalizer moves characters; ask for totals")
        out, base = [0], 0
        for c in self._of_spans(text):
            out.extend(base + x for x in c)
            base += c[-1]
        # the first mark stands before the text
        return np.asarray([0, *out[2:]] if text else [0], np.int64)

    def fit(self, text: str, budget: int) -> int:
        """Code points of the longest prefix that has at most ``budget`` ids."""
        found = self._of_spans(text)
        base = at = 0
        for c in found:
            if base + c[-1] > budget:
                best = max((k + 1 for k, x in enumerate(c) if base + x <= budget), default=0)
                return max(0, at + best - 1)
            base += c[-1]
            at += len(c)
        return len(text)


_counters: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    if path not in _counters:
        _counters[path] = PrefixCounts(load(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, and what a limit leaves of it.

    Returns id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and
    fit_chars (code points of the longest prefix within the limit).  Null text
    counts as empty: no bytes, no tokens.  Rows are independent: repeated ones
    repeat, an empty table gives none, other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(model_path)
        for b in batches:
            texts = b.column(1)
            size, n, fit = [], [], []
            for t in texts:
                t = t.as_py() or ""
                size.append(len(t.encode()))
                n.append(k := counts.total(t))
                fit.append(len(t) if k <= limit else counts.fit(t, limit))
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), n, pc.greater(n, limit), pa.array(fit, pa.int64())], names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
