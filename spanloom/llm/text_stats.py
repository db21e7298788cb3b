"""Counts over whole texts that rules and trees look at."""

from __future__ import annotations

import re

import numpy as np

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BLANK = re.compile(r"[\x20\x09-\x0D]+")

#: features of the trees, in order
FEATURES = (
    "log_words", "chars_a_word", "symbols_a_word", "dup_lines_share", "repeat_words_share", "distinct_words_share", "upper_share", "digit_share",
    "punctuation_share", "bang_share", "pipe_share", "non_ascii_share", "words_a_line", "top_word_share", "sentence_end_share", "long_word_share",
)


def words(text: str) -> list[bytes]:
    """Maximal runs of characters other than space and \\x09-\\x0D."""
    return text.encode().split()


def word_ids(found: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))


def window_hashes(ids: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """A 64-bit hash of each window of n words."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ (x[k : len(x) - n + 1 + k] * _MIX[k % 5])) * _MIX[(k + 1) % 5]
        h ^= h >> np.uint64(29)
    return h


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of five words that stand twice or more in the text."""
    h = window_hashes(ids)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base(text: str) -> tuple[tuple[int, int, int, int, int], list[bytes], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the words and their numbers."""
    found = words(text)
    ids = word_ids(found)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x and not _BLANK.fullmatch(x)]
    stats = (len(found), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids))
    return stats, found, ids


def features(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base counts and the features of FEATURES; a text without words has zeros."""
    stats, found, ids = base(text)
    n, chars, symbols, dup, repeat = stats
    if not n:
        return stats, [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode(), np.uint8)
    c = np.bincount(data, minlength=256)
    upper, lower, digit = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    punct = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    lines = text.count("\n") + 1
    counts = np.bincount(ids)
    ends = sum(map(text.count, (". ", ".\n", "! ", "? "))) + text.endswith((".", "!", "?"))
    sizes = np.fromiter(map(len, found), np.int64, n)
    return stats, [
        float(np.log1p(n)), chars / n, symbols / n, dup / lines, repeat / n, len(counts) / n, upper / max(1, upper + lower), digit / chars,
        punct / chars, int(c[33]) / n, int(c[124]) / n, float((data > 127).sum()) / len(data), n / lines, float(counts.max()) / n, ends / n, float((sizes > 15).mean()),
    ]
