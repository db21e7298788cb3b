"""Rows that every operator must stand."""

import os

DATA = os.environ.get("TEST_DATA", "/root/testdata")
ENGLISH = "the quick brown fox jumps over the lazy dog and runs through the quiet forest near the old river bank every single morning before sunrise".split()


def document(seed: int, n: int = 60) -> str:
    """Words in an order of their own for each seed."""
    return " ".join(f"{ENGLISH[(seed * 7 + k * (seed % 5 + 3)) % len(ENGLISH)]}{(seed * k) % 13}" for k in range(n))


#: nulls in every column, empty, blank and long texts, repeated rows, equal texts
HARD = [
    (1, document(1), "en", "a"), (2, document(2), "fr", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "en", "b"), (6, document(1), "en", None),
    (6, document(1), "en", None), (None, document(3), "de", "a"), (None, None, None, None), (7, "word " * 30_000, "en", "c"), (8, "x" * 50_000, "en", "c"),
    (9, "été 日本語 🙂 <s> <|endoftext|> ▁ \x00 #*$ | a_b  don't", "fr", "b"), (10, "one two three", "en", "a"), (11, document(1) + " tail", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
