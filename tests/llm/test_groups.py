from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_data import DATA, HARD, document
from spanloom.llm import batches, jaccard_join, mixing, prefix_forest, sharding, streaming_encoder
from spanloom.llm.components import components
from spanloom.session import table

SF = f"{DATA}/sf0.01"


def near_by_brute_force(rows, threshold=0.8):
    sets = [frozenset(jaccard_join.shingles(t or "").tolist()) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(rows))], links


def variants():
    """A chain of texts, each near to the next, copies, and others."""
    words = document(5, 200).split()
    rows, k = [], 100
    for step in range(12):
        w = list(words)
        for j in range(step):
            w[10 + 15 * j] = f"changed{j}"
        rows.append((k := k + 1, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "a b c"), (203, "a b c"), (204, "a b"), (205, ""), (206, None), (207, " ")]
    return rows + [(300 + s, document(s, 80)) for s in range(20)]


def test_near_duplicates_against_brute_force(spark):
    rows = variants()
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    roots, links = near_by_brute_force(rows)
    for (i, _), root, n in zip(rows, roots, links, strict=True):
        assert got[i]["class_id"] == rows[root][0] and got[i]["n_linked_docs"] == n
    assert got[201]["n_copies"] == 3 and got[203]["n_copies"] == 2 and got[205]["n_copies"] == 1


def test_blocks_give_the_same_links(spark, monkeypatch):
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = Counter(map(tuple, jaccard_join.near_duplicates(df).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    assert Counter(map(tuple, jaccard_join.near_duplicates(df).collect())) == whole


def test_links_by_counts_and_by_products(monkeypatch):
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    want = np.array([[a != b and len(np.intersect1d(x, y)) >= 0.5 * len(np.union1d(x, y)) for b, y in enumerate(sets)] for a, x in enumerate(sets)])
    for dense, counted in ((1, 1_000_000), (24, 1_000_000), (1000, 1_000_000), (24, 1), (1000, 5000)):
        monkeypatch.setattr(jaccard_join, "DENSE", dense)
        monkeypatch.setattr(jaccard_join, "COUNTED", counted)
        assert (jaccard_join._links(sets, None, 0.5) == want).all()
        cross = jaccard_join._links(sets[:20], sets[20:], 0.5)
        assert (cross[:20, 20:] == want[:20, 20:]).all() and not cross[:20, :20].any()


def test_prefix_reaches_its_recall():
    k = jaccard_join.prefix_length(0.8)
    assert 1 - (1 - 0.8**k) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** jaccard_join.TREES
    r = np.random.default_rng(5)
    hits = []
    for _ in range(60):
        base = r.integers(0, 1 << 63, 400).astype(np.uint64)
        (a, _), (b, _) = (jaccard_join.signature(np.unique(x)) for x in (base[:360], base[40:]))
        hits.append((a == b).any())
    assert all(hits)


def test_strings_share_prefixes_as_often_as_sets_are_similar():
    r, length = np.random.default_rng(7), []
    for _ in range(200):
        base = r.integers(0, 1 << 63, 400).astype(np.uint64)
        (a, c), (b, d) = (jaccard_join.signature(np.unique(x)) for x in (base[:360], base[40:]))  # 320 of 400
        length += [jaccard_join.shared_symbols(np.array([w, x]), np.array([y, z]))[1] for w, x, y, z in zip(a, b, c, d, strict=True)]
    length = np.asarray(length)
    for k in (1, 4, 8, 12):
        assert abs((length >= k).mean() - 0.8**k) < 0.03
    assert jaccard_join.shared_symbols(np.array([5, 5, 6, -1]), np.array([1, 1 << 24, 0, 0], np.int32)).tolist() == [-1, 8, 7, 0]


def nodes_by_hand(strings, lengths):
    """Which sets hang together by prefixes of each length, straight from the strings."""
    out = {}
    for k in lengths:
        groups = {}
        for tree, high, low, v in strings:
            text = (high % 2**64).to_bytes(8, "big") + (low % 2**32).to_bytes(4, "big")
            groups.setdefault((tree, text[:k]), set()).add(v)
        root = {v: v for *_, v in strings}
        for _ in range(60):
            for g in groups.values():
                least = min(root[v] for v in g)
                root.update((v, least) for v in g)
        out[k] = {v: c for v, c in root.items() if list(root.values()).count(c) > 1}
    return out


def test_nodes_of_the_tries_across_ranges(spark):
    r = np.random.default_rng(3)
    some = r.integers(-(2**63), 2**63, 4)
    strings = [(t, int(some[r.integers(4)] ^ (r.integers(4) << r.integers(0, 30))), int(r.integers(3) << r.integers(0, 29)), v) for t in range(3) for v in range(60)]
    df = spark.createDataFrame(strings, "tree int, high long, low int, v long")
    want = nodes_by_hand(strings, (12, 8))
    for n in (1, 7, 40):  # ranges of a few rows cut nodes
        nodes = jaccard_join._nodes(df.repartitionByRange(n, "tree", "high", "low", "v").sortWithinPartitions("tree", "high", "low", "v"), [12, 8])
        for k in (12, 8):
            assert dict(map(tuple, components(nodes.where(f"length >= {k}").select("a", "b")).collect())) == want[k]


def test_prefixes_are_shortened_until_the_recall_holds():
    strong, weak = np.zeros(101), np.zeros(101)
    strong[98], weak[81] = 10**7, 10**7
    need = lambda counts, k: jaccard_join.unseen(counts, 0.8, k) <= (1 - jaccard_join.RECALL) * counts.sum()
    assert need(strong, 12) and not need(weak, 12) and need(weak, 8)
    assert not need(np.zeros(101), 12)  # nothing found proves nothing


def test_join_against_brute_force_on_documents(spark):
    """All links of the small table's documents, by counting common shingles in Spark."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    sets = {r["doc_id"]: jaccard_join.shingles(r["text"] or "") for r in docs.collect()}
    owners = {}
    for i, s in sets.items():
        for x in s.tolist():
            owners.setdefault(x, []).append(i)
    common = Counter()
    for found in owners.values():
        common.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    links = Counter()
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links.update((a, b))
    got = {r["doc_id"]: r["n_linked_docs"] for r in jaccard_join.near_duplicates(docs).collect()}
    total, seen = sum(links.values()), sum(min(n, got[i]) for i, n in links.items())
    assert total > 100 and seen >= 0.999 * total and all(n <= links[i] for i, n in got.items())


def test_near_duplicates_on_hard_rows(hard, empty):
    rows = jaccard_join.near_duplicates(hard).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in HARD)
    assert {r["class_id"] for r in rows if r["doc_id"] in (1, 6, 11)} == {1}
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.keep_one(hard)
    assert kept.columns == hard.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9, 10, None, None])
    assert jaccard_join.keep_one(empty).count() == 0


def test_every_pair_decides_the_length(spark, monkeypatch):
    seen, n = [], 460
    monkeypatch.setattr(jaccard_join, "unseen", lambda similar, *_: seen.append(similar.sum()) or 0.0)
    one = np.arange(5, dtype=np.uint64).tobytes()
    pool = spark.createDataFrame([(v, one) for v in range(n)], "v long, sh binary")
    nodes = spark.range(n * n).select((F.col("id") % n).alias("a"), F.floor(F.col("id") / n).alias("b"), F.lit(12).alias("length"))
    assert jaccard_join._length(nodes, pool, [12, 8], 0.8) == 12 and seen == [n * n]


def test_keep_one_with_repeated_and_null_ids(spark):
    rows = [(1, document(1)), (1, document(2)), (2, document(2) + " tail"), (None, document(3)), (None, document(3)), (None, document(1)), (None, document(4)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = Counter(map(tuple, jaccard_join.keep_one(df).collect()))
    assert kept == Counter([(1, document(1)), (1, document(2)), (None, document(3)), (None, document(4)), (None, None)])


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(100, 140)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError, match="rounds"):
        components(spark.createDataFrame(edges, "a long, b long"), rounds=1)


def nearest_by_brute_force(rows, every, k):
    good = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted(((-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))).__round__(12), i) for i, y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in range(300)]
    same = rows[10][1]
    rows += [(k, same) for k in range(300, 340)] + [(340, None), (350, [0.0] * 8), (360, [float("nan")] + [1.0] * 7), (370, [None] + [1.0] * 7), (380, [1.0] * 3), (390, [float("inf")] * 8)]
    got = prefix_forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, k=5).collect()
    found = {}
    for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])):
        found.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    want = nearest_by_brute_force(rows, 10, 5)
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in found[q]], [s for _, s in want[q]], atol=1e-9)


def test_neighbours_of_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0], 1, "x"), (3, [0.0, 1.0], 2, "x"), (3, [2.0, 0.0], 3, "y"), (4, [1.0, 1.0], 4, None), (4, [1.0, 1.0], 4, None), (5, [-1.0, 0.0], None, "z"), (50, [0.0, 1.0], 1, "q"), (50, [1.0, 0.1], 1, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep long, code string")
    for parts in (1, 4):
        found = {}
        for q, rank, i, score in sorted(map(tuple, prefix_forest.neighbours(df.repartition(parts)).collect())):
            found.setdefault(q, []).append((i, round(score, 6)))
        near = 1 / 1.01**0.5
        assert found == {0: [(3, 1.0), (50, round(near, 6)), (4, round(0.5**0.5, 6)), (5, -1.0)], 50: [(3, 1.0), (0, round(near, 6)), (4, round(1.1 / (1.01 * 2) ** 0.5, 6)), (5, 0.0)]}


def test_neighbours_of_few_or_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert prefix_forest.neighbours(spark.createDataFrame([], schema)).count() == 0
    assert prefix_forest.neighbours(spark.createDataFrame([(0, None), (50, [0.0, 0.0])], schema)).count() == 0
    two = prefix_forest.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], schema)).collect()
    assert [tuple(x)[:3] for x in two] == [(0, 1, 1)]


def test_forest_recall(spark):
    rows = table(spark, f"{DATA}/sf0.1", "embeddings").select("vec_id", "embedding")
    x = {r["vec_id"]: np.asarray(r["embedding"], float) for r in rows.collect()}
    ids = np.asarray(sorted(x))
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    hit = total = 0
    got = Counter((r["query_id"], r["vec_id"]) for r in prefix_forest.neighbours(rows).collect())
    for at in np.flatnonzero(ids % 50 == 0):
        s = m @ m[at]
        s[at] = -2
        for k in np.argsort(-s)[:5]:
            hit += (ids[at], ids[k]) in got
            total += 1
    assert hit / total >= 0.95


def recall(spark, m, every=50, k=5):
    """Recall of the forest by query, against all scores, ties to the smaller row."""
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    got = Counter((r["query_id"], r["vec_id"]) for r in prefix_forest.neighbours(rows, every, k).collect())
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = {}
    for q in range(0, len(m), every):
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        hit[q] = np.mean([(q, i) in got for i in np.lexsort((np.arange(len(m)), -s))[:k].tolist()])
    return hit


@pytest.mark.parametrize("kind", ["near", "scaled"])
def test_forest_in_a_group_wider_than_the_window(spark, kind):
    r = np.random.default_rng(8)
    m = r.normal(size=(6000, 32))
    group = r.permutation(6000)[:2000]
    m[group] = m[0] + 0.001 * r.normal(size=(2000, 32)) if kind == "near" else m[0] * r.uniform(0.5, 2, (2000, 1))
    hit = recall(spark, m)
    assert np.mean([hit[q] for q in group.tolist() if q in hit]) == 1 and np.mean(list(hit.values())) >= 0.95


def test_strings_keep_the_order_of_their_symbols():
    r = np.random.default_rng(2)
    planes = prefix_forest._planes(6, 3)
    x = prefix_forest._unit(r.normal(size=(200, 6)))
    codes = prefix_forest._strings(x, planes)
    plain = [["".join("01"[int(s > 0)] for s in row[t * prefix_forest.BITS : (t + 1) * prefix_forest.BITS]) for t in range(3)] for row in x @ planes]
    assert [[f"{c:0{prefix_forest.BITS}b}" for c in row] for row in codes.tolist()] == plain
    a, b = codes[:100].ravel(), codes[100:].ravel()
    a[:3], b[3] = b[:3], a[3] ^ 1
    want = [next((k for k, (p, q) in enumerate(zip(f"{i:062b}", f"{j:062b}", strict=True)) if p != q), 62) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert prefix_forest._shared(a, b).tolist() == want and want[:4] == [62, 62, 62, 61]


def groups_of_near_vectors(n, dim, size, seed):
    """Groups of ``size`` vectors at a cosine of about 0.95 from each other, in mixed order."""
    r = np.random.default_rng(seed)
    m = np.repeat(r.normal(size=(n // size, dim)), size, axis=0) + 0.23 * r.normal(size=(n, dim))
    return m[r.permutation(n)]


@pytest.mark.parametrize("range_rows", [40_000, 4_000])
def test_forest_without_its_root(spark, monkeypatch, range_rows):
    """The trees alone find the neighbours, seeing a small part of the index, also where nodes cross ranges."""
    pairs, to_root, scored = [], [], prefix_forest._scored

    def watched(index, wanted, some, dim, k):
        (pairs if some is not None else to_root).append(some.distinct().count() if some is not None else wanted.count())
        return scored(index, wanted, some, dim, k)

    monkeypatch.setattr(prefix_forest, "_scored", watched)
    monkeypatch.setattr(prefix_forest, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(prefix_forest, "PAIRS", range_rows // 100)  # of a few pairs none may be near enough
    m = groups_of_near_vectors(16_000, 48, 8, 9)
    assert np.mean(list(recall(spark, m).values())) >= 0.95
    assert sum(pairs) <= 0.1 * 320 * 16_000 and to_root[0] <= 0.05 * 320


def test_forest_goes_to_its_root_for_far_neighbours(spark):
    m = np.random.default_rng(9).normal(size=(8000, 32))
    assert np.mean(list(recall(spark, m).values())) >= 0.95


def crc(t):
    import zlib

    return zlib.crc32((t or "").encode())


def test_shards(spark, hard, empty):
    rows = sharding.shard_rows(hard).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, crc(t)) for i, t, *_ in HARD)
    assert sharding.shard_rows(empty).count() == 0
    for n, shards in ((2000, 24), (5, 24), (100, 3)):
        rows = sharding.shard_rows(spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text"), n_shards=shards).collect()
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(slots.get(k, [])) for k in range(shards)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_move_little(spark):
    at = lambda n: {r["doc_id"]: r["shard"] for r in sharding.shard_rows(spark.range(3000).selectExpr("id as doc_id", "'x' as text"), n_shards=n).collect()}
    a, b = at(12), at(13)
    assert np.mean([a[k] != b[k] for k in a]) < 0.35


def targets_by_hand(sizes, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_, fixed, total = set(names), {}, share * sum(sizes.values())
    while open_:
        level = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        fixed |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return fixed


@pytest.mark.parametrize("data", ["hard", "table"])
def test_mix(spark, hard, data):
    docs = hard if data == "hard" else table(spark, SF, "documents")
    rows = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in docs.select("text", "source").collect():
        sizes[r["source"]] += size(r["text"])
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], size(r["text"])) for r in docs.select("doc_id", "text").collect())
    want = targets_by_hand(sizes, 1.5, 2.0)
    source = {(round(want[s], 6), sizes[s]) for s in sizes}
    assert {(round(r["target"], 6), r["source_size"]) for r in rows} == source
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    if data == "table":
        assert all(abs(n - t) <= 0.02 * t for (t, _), n in taken.items())
    again = Counter(map(tuple, mixing.mix(docs.repartition(7)).select("doc_id", "size", "taken").collect()))
    assert again == Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)


def test_mix_keeps_columns_and_copies(spark, hard, empty):
    copies = Counter()
    for r in mixing.mix(hard).collect():
        copies[r["doc_id"]] += r["copies"]
    kept = mixing.mix(hard, keep_columns=True)
    assert kept.columns == hard.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == +copies
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty, keep_columns=True).count() == 0


def test_workers_forget_hashes(spark):
    """At the end of each task."""
    docs = spark.createDataFrame([(i, document(i), "en", "a") for i in range(40)], "doc_id long, text string, lang string, source string").coalesce(1)

    def held(batches):
        from spanloom.llm import jaccard_join

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(jaccard_join._hashes)]})

    jaccard_join.near_duplicates(docs).collect()
    assert spark.range(0, 64, 1, 32).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_encoders_stay_for_their_own_tasks():
    path = public_tokenizers.path("piece_bpe_32k.model")
    held = streaming_encoder.encoder(path)
    streaming_encoder._end()
    assert streaming_encoder.encoder(path) is held
    batches.give_back()
    assert not streaming_encoder._encoders
