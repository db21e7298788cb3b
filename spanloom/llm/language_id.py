"""Language identification, words first.

A word of the learned vocabulary adds its log frequency in each language.  Any
other word backs off: at each of its characters the longest learned character
n-gram that ends there speaks, from ``LONGEST`` characters down to one.  The
tables come from documents with a language outside the held-out fold: for the
pipeline from all of them, for the query from a bounded sample (``SAMPLE`` rows
by the hash of their id), dealt evenly among the languages: one with few
documents gives all of them.  The vocabulary keeps
``WORDS`` words that occur twice and ``GRAMS`` n-grams, the most frequent of
each language in turn, so what is broadcast is bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.batches import give_back, parts, small_batches
from spanloom.llm.learning import fold
from spanloom.session import cut

SAMPLE = 8000
HELD_OUT = (4, 2)
WORDS = 50_000
GRAMS = 40_000
LONGEST = 4
LANGUAGES = 1000
#: entries that a task counts before it passes them on
HELD = 100_000
#: words whose scores a worker remembers
SCORED = 150_000
#: turns that are counted together to see which ones fill the vocabulary
TURNS = 64
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str) -> list[str]:
    """All n-grams of a word with its ends marked."""
    w = f"<{word}>"
    return [w[k : k + n] for n in range(1, LONGEST + 1) for k in range(len(w) - n + 1)]


class Tables:
    """Log frequencies by language: rows of ``logs``, one array for all, as every worker holds a copy;
    ``words`` and ``grams`` say which row."""

    def __init__(self, languages: list[str], counts: dict[tuple[str, str], np.ndarray]):
        self.languages = languages
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.logs = np.zeros((len(counts), len(languages)))
        groups: dict[object, list] = {}
        for (kind, text), c in counts.items():
            groups.setdefault("word" if kind == "w" else len(text), []).append((text, c))
        for group, rows in groups.items():
            total = np.sum([c for _, c in rows], axis=0)
            to = self.words if group == "word" else self.grams
            for text, c in rows:
                k = to[text] = len(self.words) + len(self.grams)
                self.logs[k] = np.log((c + 0.5) / (total + 0.5 * len(rows)))


class Scorer:
    def __init__(self, tables: Tables):
        self.tables = tables
        self._rows: dict[str, int] = {}
        self._logs = np.zeros((1024, len(tables.languages)), np.float32)

    def of_word(self, word: str) -> np.ndarray:
        t = self.tables
        known = t.words.get(word)
        if known is not None:
            return t.logs[known]
        w, out = f"<{word}>", np.zeros(len(t.languages))
        for end in range(2, len(w) + 1):
            for n in range(min(LONGEST, end), 0, -1):
                found = t.grams.get(w[end - n : end])
                if found is not None:
                    out += t.logs[found]
                    break
        return out

    def _row(self, word: str) -> int:
        if len(self._rows) >= SCORED:
            self._rows.clear()
        k = self._rows[word] = len(self._rows)
        if k >= len(self._logs):
            self._logs = np.concatenate([self._logs, np.zeros_like(self._logs)])
        self._logs[k] = self.of_word(word)
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.tables.languages:
            return "und", 0.0
        found = words(text)
        total = np.zeros(len(self.tables.languages))
        for at in range(0, len(found), 50_000):  # fewer than the cache holds
            part = found[at : at + 50_000]
            if len(self._rows) + len(part) > SCORED:
                self._rows.clear()
            rows = list(map(self._rows.get, part))
            if None in rows:
                rows = [self._rows[w] if w in self._rows else self._row(w) for w in part]
            total += self._logs[np.asarray(rows, np.int64)].sum(axis=0, dtype=float)
        p = np.exp(total - total.max())
        k = int(p.argmax())
        return self.tables.languages[k], float(p[k] / p.sum())


def _quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """At most ``most`` rows in all, as even among the languages as their counts allow."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(counts) - k))
        left -= out[lang]
    return out


def _chosen(own: DataFrame, most: int) -> DataFrame:
    """(chosen, lang): the sample, by language.  Only a few more rows than it
    holds reach the task that ranks a language."""
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    quotas = _quotas({r["lang"]: r["n"] for r in counts}, most)
    rows = [(r["lang"], quotas[r["lang"]], min(1.0, (1.5 * quotas[r["lang"]] + 100) / r["n"])) for r in counts]
    wanted = own.sparkSession.createDataFrame(rows, "wanted string, quota int, part double")
    own = own.withColumn("hash", F.xxhash64("id")).join(F.broadcast(wanted), F.col("lang") == F.col("wanted"))
    own = own.where(F.col("hash") / 2.0**64 + 0.5 <= F.col("part"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("hash", "id"))
    return own.withColumn("nth", nth).where(F.col("nth") <= F.col("quota")).select(F.col("id").alias("chosen"), "lang")


def _first(own: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` first entries in turn.  What is sorted are those of the turns that fill
    the vocabulary, so that each task doesn't send as many rows to the driver as it keeps."""
    block = F.least(F.floor(F.col("nth") / TURNS), F.lit(keep))  # later ones together
    held = 0
    for r in own.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect():
        held += r["n"]
        if held >= keep and r["block"] < keep:
            own = own.where(F.col("nth") < (r["block"] + 1) * TURNS)
            break
    return own.orderBy("nth", F.desc("all"), "text").limit(keep)


def fit(docs: DataFrame, most: int | None = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tables:
    """Tables from at most ``most`` documents, from all if it is None.  Words are
    counted where the texts are and summed, then n-grams are counted in the
    sums; the driver gets the bounded vocabulary.  Beyond the LANGUAGES most
    frequent languages none is learned."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    own = own.where(F.col("id").isNotNull() & F.col("lang").isNotNull()).where(fold(F.col("id"), HELD_OUT[0]) != HELD_OUT[1])
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    if most is None:
        texts = texts.where(F.col("lang").isNotNull() & F.coalesce(fold(F.col("id"), HELD_OUT[0]) != HELD_OUT[1], F.lit(False))).select("lang", "text")
    else:
        chosen = _chosen(own.groupBy("id").agg(F.min("lang").alias("lang")), most)
        texts = texts.drop("lang").join(F.broadcast(chosen), F.col("id") == F.col("chosen")).select("lang", "text")

    def counted(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "text": pa.array(c, pa.string()), "n": pa.array(c.values(), pa.int64())})
        held.clear()

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for part in parts(b, most=2_000_000):
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.setdefault(lang, Counter()).update(words(t or ""))
                if sum(map(len, held.values())) > HELD:
                    yield from counted(held)
        yield from counted(held)
        give_back()

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = held.setdefault(lang, Counter())
                for x in grams(w):
                    c[x] += n
            if sum(map(len, held.values())) > HELD:
                yield from counted(held)
        yield from counted(held)
        give_back()

    summed = lambda df, count: df.mapInArrow(count, "lang string, text string, n long").groupBy("text", "lang").agg(F.sum("n").alias("n"))
    by_word = cut(summed(texts, count_words).select("lang", "text", "n"))
    counts = by_word.withColumn("kind", F.lit("w")).unionByName(summed(by_word, count_grams).withColumn("kind", F.lit("g")))
    counts = counts.withColumn("nth", F.row_number().over(W.partitionBy("kind", "lang").orderBy(F.desc("n"), "text")))
    # at most one entry a language of the sample in each row
    by_text = cut(counts.groupBy("kind", "text").agg(F.sum("n").alias("all"), F.min("nth").alias("nth"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")))
    rows = []
    for kind, keep, least in (("w", WORDS, 2), ("g", GRAMS, 1)):
        rows += _first(by_text.where((F.col("kind") == kind) & (F.col("all") >= least)), keep).collect()
    totals: Counter = Counter()
    for r in rows:
        totals.update(r["by"])
    languages = sorted(x for x, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:LANGUAGES])
    at = {x: k for k, x in enumerate(languages)}
    table = {}
    for r in rows:
        c = np.zeros(len(languages))
        for lang, n in r["by"].items():
            if lang in at:
                c[at[lang]] = n
        table[r["kind"], r["text"]] = c
    return Tables(languages, table)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> DataFrame:
    """Per document: id, held_out, lang_pred, score (posterior of the language).

    Text that is null or has no letter gives ``und`` with score 0, as does
    every text if nothing could be learned.  Ties go to the first language by
    code point.  Rows are independent; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(fit(docs, most, id_col, text_col, lang_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(tables.value)
        for b in batches:
            found = [score.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=[id_col, "lang_pred", "score"])
        del score
        give_back()

    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    found = own.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
    held = F.coalesce(fold(F.col(f"`{id_col}`"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return found.select(F.col(f"`{id_col}`"), held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, training: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language with a score of at least ``least``,
    with all their columns; texts without letters go.  The tables learn from all of
    ``training``."""
    small_batches(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(fit(training, None))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(tables.value)
        for b in batches:
            for part in parts(b, at):
                found = [score.predict(t.as_py()) for t in part.column(at)]
                yield part.filter(pa.array([x != "und" and p >= least for x, p in found], pa.bool_()))
        del score
        give_back()

    return docs.mapInArrow(run, docs.schema)
