import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_data import DATA, ENGLISH, HARD, document
from spanloom.llm import boosted_trees, language_id, quality_classifier, quality_rules, whole_trees
from spanloom.llm.text_stats import base, features
from spanloom.session import table

SF = f"{DATA}/sf0.01"


def plain_stats(text):
    """The base counts, word by word."""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("seed", range(40))
def test_base_counts(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "b", "a", " ", " ", "\n", " ", "#", "|", "é", "a b c d e\n", "\x1c", "\r\n"]) for _ in range(r.randint(0, 200)))
    assert base(text)[0] == plain_stats(text) == features(text)[0]


def test_rules_on_hard_rows(hard, empty, labels):
    rows = quality_rules.judge(hard, labels).collect()
    want = Counter()
    for i, t, *_ in HARD:
        s = plain_stats(t or "")
        want[(i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(hard, labels.limit(0)).where("not base_failed and not kept").count() == 0
    kept = quality_rules.keep_good(hard, hard, labels)
    assert kept.columns == hard.columns and kept.count() == sum(r["kept"] for r in rows)


def test_rules_on_held_out_rows(spark):
    rows = quality_rules.judge(table(spark, SF, "documents"), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and not r["base_failed"]]
    assert np.mean([r["kept"] == bool(r["quality"]) for r in held]) > 0.95


def test_trees_keep_to_their_constraints():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + r.normal(size=2000) * 0.3 > 0).astype(float)
    m = boosted_trees.train(x, y, np.asarray([1, 0, -1]))
    assert ((m.probability(x) > 0.5) == y).mean() > 0.85
    line = np.repeat(x[:50], 40, axis=0)
    for f, sign in ((0, 1), (2, -1)):
        at = line.copy()
        at[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (np.diff(m.margin(at).reshape(50, 40), axis=1) * sign >= -1e-12).all()
    walk = []
    for row in x[:100]:  # node by node
        total = m.start
        for node in m.roots:
            while m.feature[node] >= 0:
                node = m.left[node] if row[m.feature[node]] <= m.threshold[node] else m.right[node]
            total += m.value[node]
        walk.append(total)
    assert np.allclose(walk, m.margin(x[:100]))
    assert boosted_trees.train(x[:0], y[:0], np.zeros(3)).probability(x[:2]).min() > 0.5
    assert boosted_trees.train(x, np.ones(2000), np.zeros(3)).probability(x[:2]).min() > 0.5


def test_classifier_on_hard_rows(hard, empty, labels):
    rows = quality_classifier.classify(hard, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in HARD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.classify(hard, labels.limit(0)).count() == len(HARD)


def test_classifier_on_held_out_rows(spark):
    rows = quality_classifier.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_coordinate_descent_solves_the_hinge_problem():
    r = np.random.default_rng(2)
    rows = [np.sort(r.choice(40, 8, replace=False)) + 40 * int(k % 2 and r.random() < 0.8) for k in range(200)]
    y = np.arange(200) % 2
    m = quality_classifier.train(rows, y, epochs=200)
    assert np.mean([(m.score(x) >= 0.5) == bool(k) for x, k in zip(rows, y, strict=True)]) > 0.85


def test_language_on_hard_rows(hard, empty):
    rows = language_id.identify(hard).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in HARD)
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5) or (r["doc_id"] is None and r["score"] == 0)) and 0 <= r["score"] <= 1
    assert language_id.identify(empty).count() == 0
    kept = language_id.keep_identified(hard, hard)
    assert kept.columns == hard.columns and kept.where("text is null").count() == 0
    assert language_id.keep_identified(hard, empty).count() == 0


def test_language_on_held_out_rows(spark):
    rows = language_id.identify(table(spark, SF, "documents")).join(table(spark, SF, "documents"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_with_a_small_share_is_learned(spark):
    rows = [(i, " ".join(f"{ENGLISH[(i * k) % len(ENGLISH)]}" for k in range(20)), "en") for i in range(3000)]
    rows += [(9000 + i, "ceci est une phrase bien écrite dans une langue assez rare", "fr") for i in range(8)]
    tables = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=20)
    assert tables.languages == ["en", "fr"]
    assert language_id.Scorer(tables).predict("une phrase bien écrite")[0] == "fr"


def test_language_backs_off_to_shorter_grams():
    counts = {("w", "haus"): np.array([9.0, 1.0]), ("g", "ung>"): np.array([8.0, 0.0]), ("g", "x"): np.array([0.0, 5.0]), ("g", "y"): np.array([5.0, 0.0])}
    s = language_id.Scorer(language_id.Tables(["de", "en"], counts))
    assert s.predict("Haus")[0] == "de" and s.predict("Meinung")[0] == "de" and s.predict("xx")[0] == "en"
    assert s.predict("12 34") == ("und", 0.0) and document(1)


def test_whole_trees_learn_from_every_row(spark):
    r = np.random.default_rng(4)
    x = r.gamma(2.0, size=(3000, 3))
    y = (x[:, 0] - x[:, 2] + r.normal(size=3000) * 0.3 > 0).astype(int)
    monotone = np.asarray([1, 0, -1])
    rows = spark.createDataFrame([(a.tobytes(), int(b)) for a, b in zip(x, y, strict=True)], "x binary, y int")
    fitted = [whole_trees.train_whole(rows.repartition(k), monotone, trees=8) for k in (2, 5)]
    plain = boosted_trees.train(x, y.astype(float), monotone, trees=8)
    for m in fitted:
        assert np.array_equal(m.probability(x), fitted[0].probability(x))  # whatever the partitions
        assert np.abs(m.probability(x) - plain.probability(x)).mean() < 0.02 and ((m.probability(x) > 0.5) == y).mean() > 0.9
    line = np.repeat(x[:50], 40, axis=0)
    for f, sign in ((0, 1), (2, -1)):
        at = line.copy()
        at[:, f] = np.tile(np.linspace(0, 9, 40), 50)
        assert (np.diff(fitted[0].margin(at).reshape(50, 40), axis=1) * sign >= -1e-12).all()


def test_the_pipeline_learns_from_every_document(spark, monkeypatch):
    """Beyond what a sample would hold."""
    monkeypatch.setattr(quality_rules, "SAMPLE", 5)
    monkeypatch.setattr(language_id, "SAMPLE", 5)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    seen = []
    monkeypatch.setattr(quality_rules, "train_whole", lambda rows, monotone: seen.append(rows.count()) or boosted_trees.constant(0.9))
    quality_rules.keep_good(docs, docs, labels)
    ids = {r["doc_id"] for r in docs.collect()}
    assert seen == [len({r["doc_id"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in ids})]
    counts = defaultdict(Counter)
    for r in docs.collect():
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(language_id.words(r["text"] or ""))
    monkeypatch.setattr(language_id, "Tables", lambda languages, table: seen.append(table))
    language_id.fit(docs, None)
    got = {w: c.tolist() for (kind, w), c in seen[-1].items() if kind == "w"}
    assert got == {w: [counts[x][w] for x in sorted(counts)] for w in got} and len(got) == sum(sum(c[w] for c in counts.values()) >= 2 for w in set().union(*counts.values()))


def test_batches_are_small_whatever_was_set(spark, hard, labels):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        spark.conf.set(key, "10000")
        language_id.keep_identified(hard, hard)
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, "7")
        quality_rules.keep_good(hard, hard, labels.limit(0))
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)


def test_features_and_trees_run_in_tasks_of_their_own(spark, monkeypatch):
    """A broadcast of few labels would put two workers a task into one stage."""
    plans = []
    monkeypatch.setattr(quality_rules, "train_whole", lambda rows, monotone: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or boosted_trees.constant(0.9))
    docs = spark.createDataFrame([(i, document(i), "en", "a") for i in range(20)], "doc_id long, text string, lang string, source string")
    quality_rules.keep_good(docs, docs, spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").coalesce(1).limit(15))
    quality_rules.keep_good(table(spark, SF, "documents"), table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert all("BroadcastHashJoin" not in p and "SortMergeJoin" in p for p in plans) and len(plans) == 2


def test_language_tables_are_one_array():
    """Every worker holds a copy of them."""
    counts = {("w", f"word{k}"): np.asarray([k, 1.0, 2.0]) for k in range(10_000)}
    tables = language_id.Tables(["de", "en", "fr"], counts)
    assert len(pickle.dumps(tables)) < 50 * len(counts)
    total = np.sum(list(counts.values()), axis=0)
    assert np.array_equal(language_id.Scorer(tables).of_word("word77"), np.log((counts["w", "word77"] + 0.5) / (total + 0.5 * len(counts))))


def test_vocabulary_is_sorted_from_the_turns_that_fill_it(spark):
    """Whatever the number of tasks; the same entries as from all of them."""
    r = np.random.default_rng(5)
    rows = [(int(n), int(r.integers(2, 9)), f"w{k}") for k, n in enumerate(r.integers(1, 4000, 3000))]
    own = spark.createDataFrame(rows, "nth int, all long, text string").repartition(7)
    for keep in (1, 50, 700, 2999, 5000):
        got = [tuple(x) for x in language_id._first(own, keep).collect()]
        assert got == sorted(rows, key=lambda x: (x[0], -x[1], x[2]))[:keep]
    bounds = [re.findall(r"nth#\d+ < (\d+)", language_id._first(own, keep)._jdf.queryExecution().optimizedPlan().toString()) for keep in (50, 5000)]
    assert bounds[1] == [] and sum(x < int(bounds[0][0]) for x, _, _ in rows) < 50 + 3 * language_id.TURNS
