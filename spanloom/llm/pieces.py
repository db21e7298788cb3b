"""A SentencePiece vocabulary as plain tables, and the exact rules over it.

``PieceModel`` reads pieces, scores and flags through the sentencepiece
library.  Two structures answer for its segmentation without the library:

* ``last_pieces``: for every prefix of a span the last piece of that prefix's
  exact encoding.  Under BPE a sequence of pieces is the encoding of its text
  exactly if each adjacent pair is the encoding of the pair's text, so the last
  piece of a prefix is the one whose pair with the encoding before it holds.
* safe cuts: a boundary that no piece of the vocabulary spans splits a text
  into spans that encode on their own.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick

SPACE = "▁"
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


def _fields(data: bytes) -> list[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message; nested ones stay bytes."""
    at, found = 0, []

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + n]
            at += n
        found.append((tag >> 3, value))
    return found


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = _fields(sp.serialized_model_proto())
        trainer = dict(_fields(next((v for k, v in proto if k == 2), b"")))
        norm = dict(_fields(next((v for k, v in proto if k == 3), b"")))
        self.kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
        if self.kind is None:
            raise ValueError("only BPE and unigram models are segmented here")
        self.plain = not norm.get(2) and not norm.get(4, 1) and norm.get(5, 1) and norm.get(3, 1) and not trainer.get(24, 0)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.names = names
        self.unk = sp.unk_id()
        self.byte_ids = [0] * 256
        self.has_bytes = False
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        #: what each id adds to a decoded text
        self.out = [b""] * n
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.has_bytes = True
                self.byte_ids[int(p[3:5], 16)] = i
                self.out[i] = bytes([int(p[3:5], 16)])
            elif sp.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
            elif not sp.is_control(i) and not sp.is_unused(i):
                self.ids[p] = i
                self.scores[p] = sp.get_score(i)
                self.out[i] = p.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: whether no piece has a space mark after another character, and none spans a line feed
        self.cut_spaces = not any(x[1] == SPACE and x[0] != SPACE for x in inner)
        self.cut_lines = not any("\n" in x for x in inner)
        #: nor one with a Latin letter next to anything else, but for a space mark before it
        latin = re.compile(f"[{LATIN}]").match
        self.cut_letters = not any(x[0] != SPACE and bool(latin(x[0])) != bool(latin(x[1])) for x in inner)
        line = "\n" if self.cut_lines else ""
        spans = [f"{SPACE}*[{LATIN}]+", f"{SPACE}*[^{SPACE}{line}{LATIN}]+"] if self.cut_letters else [f"{SPACE}*[^{SPACE}{line}]+"]
        self.span = re.compile("|".join([*spans, f"{SPACE}+", *([line] if line else [])]))
        self.pairs: dict[str, dict[str, bool]] = {}
        self._reach: dict[str, bool] = {}
        self._splits: dict[str, tuple[str, str] | None] = {}
        #: the order of merges; texts with pieces of equal score are merged step by step
        counts = Counter(self.scores[p] for p in self.ids if len(p) > 1)
        merges = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[p])
        self.rank = {p: k for k, p in enumerate(merges)}
        tied = [p for p, n in zip(merges, (counts[self.scores[p]] for p in merges), strict=True) if n > 1]
        self.tied = re.compile("|".join(map(re.escape, tied)) or "(?!)")
        #: all pieces that can occur, with (length, piece), by where they end in a text
        automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.kind != "bpe" or self.reachable(p):
                automaton.add_word(p, (len(p), p))
        automaton.make_automaton()
        self.found = automaton.iter

    # text -> spans

    def normalized(self, text: str) -> str:
        """The text as the library segments it; ids of its spans follow."""
        if self.plain:
            return (SPACE + text.replace(" ", SPACE)) if text else ""
        return self.library.normalize(text)

    def spans(self, norm: str) -> list[str]:
        if not self.cut_spaces:
            return [norm] if norm else []
        return self.span.findall(norm)

    # BPE

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best-scored adjacent pair, leftmost first."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _holds(self, a: str, b: str, limit: float) -> bool:
        """Whether merges before ``limit`` leave the boundary between two pieces.

        Undo the later merge of the two sides, again and again: whenever the
        pieces that touch at that time could merge earlier than the merge just
        undone, BPE would have joined them.  On equal ranks the left one merged
        first.
        """
        rank, split = self.rank, self.split
        while True:
            joined = rank.get(a + b)
            if joined is not None and joined < limit:
                return False
            ra, rb = rank.get(a, -1) if len(a) > 1 else -1, rank.get(b, -1) if len(b) > 1 else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, split(a)[1]
            else:
                limit, b = rb + 1, split(b)[0]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes the piece of its own text; None if none does."""
        if piece in self._splits:
            return self._splits[piece]
        found, own = None, self.rank[piece]
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if all(len(x) == 1 or (self.rank.get(x, own) < own and self.split(x)) for x in (a, b)) and self._holds(a, b, own):
                found = (a, b)
                break
        self._splits[piece] = found
        return found

    def _pair(self, a: str, b: str) -> bool:
        held = self.pairs.setdefault(a, {})
        if len(held) > 20_000:
            held.clear()
        held[b] = ok = self.merged(a + b) == [a, b] if self.tied.search(a + b) else self._holds(a, b, float("inf"))
        return ok

    def reachable(self, piece: str) -> bool:
        """Whether BPE ever makes the piece of its own text."""
        known = self._reach.get(piece)
        if known is None:
            known = self._reach[piece] = len(piece) == 1 or (self.merged(piece) == [piece] if self.tied.search(piece) else bool(self.split(piece)))
        return known

    def cost(self, piece: str) -> int:
        """Ids of a piece: one, or one for each byte of a character without a piece."""
        return 1 if piece in self.ids or not self.has_bytes else len(piece.encode())

    def last_pieces(self, span: str) -> tuple[list[str], list[int]]:
        """For every prefix: the last piece of its encoding, and its count of ids."""
        n, pairs = len(span), self.pairs
        last, count = [""] * (n + 1), [0] * (n + 1)
        at = 0  # positions up to here are settled
        for end, (size, t) in self.found(span):
            i = end + 1
            if i <= at:
                continue
            while at < i - 1:
                at += 1
                last[at], count[at] = span[at - 1], count[at - 1] + self.cost(span[at - 1])
            j = i - size
            if j:
                a = last[j]
                try:
                    ok = pairs[a][t]
                except KeyError:
                    ok = self._pair(a, t)
                if not ok:
                    continue
            last[i], count[i] = t, count[j] + 1
            at = i
        while at < n:
            at += 1
            last[at], count[at] = span[at - 1], count[at - 1] + self.cost(span[at - 1])
        return last, count

    # decoding

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model of this process: a worker reads it once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]
