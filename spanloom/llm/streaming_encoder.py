"""SentencePiece encoding and decoding by streaming Viterbi.

The encoder reads characters one by one and keeps, for the positions of a
window no longer than the longest piece, the best path's last piece (its
backpointer).  Any later piece starts in that window; as soon as the paths of
all its positions meet on one boundary, the ids up to it can't change any more
and are committed.  Memory is the window and the open part of the path.

A unigram model's best path has the largest sum of scores.  A BPE model has one
path whose adjacent pieces all hold as pairs (see ``pieces``): the same search
with that rule in place of the scores.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.batches import give_back, lasting, make_room, parts
from spanloom.llm.pieces import PieceModel, load


class Viterbi:
    """One stream: feed() takes characters and returns the ids that are final."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.start = 0  # text position of buffer[0]
        self.buffer = ""  # what is open, from the last committed boundary on
        self.back = [0]  # start of the last piece of the path to each open position
        self.last = [""]  # that piece; for the first position the one committed last
        self.score = [0.0]

    def _alone(self, i: int) -> None:
        """Position i where no piece ends: its character stands alone."""
        self.back.append(i - 1)
        self.last.append(self.buffer[i - 1])
        if self.model.kind != "bpe":
            self.score.append(self.score[i - 1] + self.model.floor)

    def _extend(self, text: str) -> None:
        """The best paths to the positions of more text: each piece that ends there is tried."""
        m, back, last, score = self.model, self.back, self.last, self.score
        at = len(self.buffer)
        self.buffer += text
        base = max(0, at - m.longest + 1)
        bpe, pairs, scores = m.kind == "bpe", m.pairs, m.scores
        for end, (size, t) in m.found(self.buffer[base:]):
            i = base + end + 1
            if i <= at:
                continue
            while len(back) < i:
                self._alone(len(back))
            j = i - size
            if bpe:
                if len(back) > i:
                    continue
                if a := last[j]:
                    try:
                        ok = pairs[a][t]
                    except KeyError:
                        ok = m._pair(a, t)
                    if not ok:
                        continue
                back.append(j)
                last.append(t)
                continue
            s = score[j] + scores[t]
            if len(back) == i:
                alone = self.buffer[i - 1] not in m.ids  # no piece of its own: it may stand alone too
                if alone and score[i - 1] + m.floor > s:
                    self._alone(i)
                    continue
                back.append(j)
                last.append(t)
                score.append(s)
            elif s > score[i]:
                back[i], last[i], score[i] = j, t, s
        while len(back) <= len(self.buffer):
            self._alone(len(back))

    def _boundary(self) -> int:
        """The last position that the paths of all positions of the window share."""
        n = len(self.back) - 1
        open_ = set(range(max(0, n - self.model.longest + 1), n + 1))
        while len(open_) > 1:
            top = max(open_)
            open_.discard(top)
            open_.add(self.back[top])
        return open_.pop()

    def _emit(self, end: int) -> list[int]:
        """Commit the path to a position and drop what lies before it."""
        pieces, at = [], end
        while at:
            pieces.append(self.last[at])
            at = self.back[at]
        keep = self.last[end]
        self.buffer = self.buffer[end:]
        self.back = [0, *(k - end for k in self.back[end + 1 :])]
        self.last = [keep, *self.last[end + 1 :]]
        if self.model.kind != "bpe":
            self.score = self.score[end:]
        self.start += end
        return [x for p in reversed(pieces) for x in ids_of(self.model, p)]

    def feed(self, text: str) -> list[int]:
        done, look = [], self.model.longest
        for k in range(0, len(text), look):
            self._extend(text[k : k + look])
            if len(self.buffer) >= 2 * look and (at := self._boundary()):
                done += self._emit(at)
        return done

    def end(self) -> list[int]:
        return self._emit(len(self.buffer))


def ids_of(model: PieceModel, piece: str) -> list[int]:
    known = model.ids.get(piece)
    if known is not None:
        return [known]
    return [model.byte_ids[b] for b in piece.encode()] if model.has_bytes else [model.unk]


class Encoder:
    """Whole texts to ids.  Streams end at safe cuts, where all paths meet; spans met before are remembered."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._spans: dict[str, bytes] = {}

    def _span(self, span: str) -> bytes:
        v = Viterbi(self.model)
        ids = v.feed(span)
        ids += v.end()
        known = struct.pack(f"<{len(ids)}I", *ids)
        if len(span) <= 64:
            make_room(self._spans)
            self._spans[span] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        spans = self.model.spans(self.model.normalized(text))
        found = list(map(self._spans.get, spans))
        if None in found:
            found = [self._span(s) if k is None else k for s, k in zip(spans, found, strict=True)]
        ids = np.frombuffer(b"".join(found), "<u4")
        if self.model.has_bytes or not len(ids):
            return ids
        same = np.zeros(len(ids), bool)  # a run of unknown characters is one id
        same[1:] = (ids[1:] == self.model.unk) & (ids[:-1] == self.model.unk)
        return ids[~same]


_encoders: dict[str, Encoder] = {}
lasting.append(_encoders)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(load(path))
    return _encoders[path]


def _end() -> None:
    """Of a task.  By its name: what a task's own code names is a copy, made on the driver."""
    give_back(_encoders)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every whole text: id, n_bytes, n_tokens, ids (array of int),
    round_trip (whether decoding the ids gives the text back).

    Null text counts as empty and has no ids.  Rows are independent: repeated
    rows repeat, an empty table gives none.  Only id and text are read.
    """
    return _encoded(docs, model_path, id_col, text_col, "ids array<int>", pa.list_(pa.int32()), lambda ids: ids.astype(np.int32))


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with ids_crc32, of the ids as little-endian unsigned 32-bit integers, in place of ids."""
    return _encoded(docs, model_path, id_col, text_col, "ids_crc32 long", pa.int64(), lambda ids: zlib.crc32(ids.tobytes()))


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, field: str, arrow: pa.DataType, of) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_tokens", field.split()[0], "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for b in batches:
            for part in parts(b):
                size, n, x, same = [], [], [], []
                for t in part.column(1):
                    t = t.as_py() or ""
                    ids = enc.encode(t)
                    size.append(len(t.encode()))
                    n.append(len(ids))
                    x.append(of(ids))
                    same.append(enc.model.decode(ids.tolist()) == t)
                cols = [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(x, arrow), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)
        _end()

    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, {field}, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from ids: id, text.  Null ids give a null text, no ids an empty one."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            texts = [None if x is None else model.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{id_col}` {kind}, text string")
