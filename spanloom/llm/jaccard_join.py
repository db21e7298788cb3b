"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts are sets of five-word shingles.  Texts with one set are copies and stand
for each other.  Each set has a string of DEPTH min-hash symbols for each of
TREES trees.  A tree is the trie of its strings, kept as their sorted order:
the prefix that two neighbours share is the deepest node above both, and a run
of neighbours that share at least k symbols is a node of depth k.

Which prefixes count is decided on the data: sets that share a node with its
first set are compared exactly, all of them, and the similarities of the links
among them say how many links, as similar as they, have no node of some depth in
common.  From the longest prefixes on, STEP
symbols go until what is found is RECALL of all links by that estimate, or until
a pair just at the threshold meets with that probability (``prefix_length``),
whichever comes first.  Sets that hang together by nodes of that depth are a
group.

Verification is exact: a group's sets are dealt into blocks, each pair of
blocks is one task's work, and there the sizes of all intersections come from
sparse counts and small matrix products.  Out come, for every set, its number
of links and one edge to the smallest set it hangs together with, so output
stays linear in the group.  Classes are the components of these edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.batches import give_back, lasting, make_room, parts
from spanloom.llm.components import components
from spanloom.llm.text_stats import window_hashes
from spanloom.session import cut

WORDS = 5
THRESHOLD = 0.8
TREES = 64
#: symbols of a string: eight of eight bits in a long, four in an int
DEPTH = 12
STEP = 2
RECALL = 0.99999
#: the share of unseen links is bounded with this confidence
CONFIDENCE = 0.95
BINS = 100
#: strings in one sorted range
RANGE_ROWS = 400_000
BLOCK_SHINGLES = 200_000
BLOCK_SETS = 512
DENSE = 24
#: pairs of a shingle's owners counted at a time
COUNTED = 1_000_000
_random = np.random.default_rng(17)
_MULTIPLY = _random.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32) | np.uint32(1)
_FLIP = _random.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)
_hashes: dict[bytes, int] = {}
lasting.append(_hashes)


def prefix_length(threshold: float, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> int:
    """The longest prefix by which pairs at the threshold still meet with the target recall."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def _word(w: bytes) -> int:
    found = xxhash.xxh64_intdigest(w)
    if len(w) <= 64:
        make_room(_hashes)
        _hashes[w] = found
    return found


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; of the whole text if it has fewer."""
    found = text.encode().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = list(map(_hashes.get, found))
    if None in ids:
        ids = [_word(w) if k is None else k for w, k in zip(found, ids, strict=True)]
    ids = np.asarray(ids, np.uint64)
    return np.unique(window_hashes(ids, n) if len(ids) >= n else window_hashes(ids, len(ids)) ^ np.uint64(len(ids)))


def signature(sh: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """The string of each tree: its first eight symbols as a long, the others as an int, in the order of the trie."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    low = np.full(trees * DEPTH, 0xFFFFFFFF, np.uint32)
    flip, multiply = _FLIP[: len(low)], _MULTIPLY[: len(low)]
    held = np.empty((min(64, len(x)), len(low)), np.uint32)  # small enough for the processor's cache
    for at in range(0, len(x), 64):
        part = x[at : at + 64, None]
        now = held[: len(part)]
        np.multiply(np.bitwise_xor(part, flip, out=now), multiply, out=now)
        np.minimum(low, now.min(axis=0), out=low)
    symbols = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).reshape(trees, DEPTH)
    return np.ascontiguousarray(symbols[:, :8]).view(">i8").ravel().astype(np.int64), np.ascontiguousarray(symbols[:, 8:]).view(">i4").ravel().astype(np.int32)


def shared_symbols(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The length of the prefix that each string shares with the one before; -1 for the first."""
    a, b = high[1:] ^ high[:-1], low[1:] ^ low[:-1]
    out = np.zeros(len(high), np.int64)
    for k in range(1, 9):
        out[1:] += (a >> (64 - 8 * k)) == 0
    for k in range(1, DEPTH - 7):
        out[1:] += (a == 0) & ((b >> (32 - 8 * k)) == 0)
    out[0] = -1
    return out


def unseen(similarities: np.ndarray, threshold: float, length: int) -> float:
    """How many links share no prefix of a length in any tree: those like the links found, and
    as many at the threshold as can be missed without one found."""
    chance = lambda s: 1 - (1 - s**length) ** TREES
    lowest = np.maximum(threshold, np.arange(len(similarities)) / (len(similarities) - 1))
    like = float((similarities * (1 - chance(lowest)) / chance(lowest)).sum())
    return like + math.log(1 - CONFIDENCE) / math.log(max(1 - chance(threshold), 1e-300))


def _digest() -> list:
    """Two hashes of the column text, which with the id tell rows apart."""
    return [F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _row() -> Column:
    """Orders rows by id, those without one last, and then by text."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "t", "t2")


def _signed(docs: DataFrame) -> DataFrame:
    """(id, v, n, high, low, t, t2) from (id, text, t, t2): v is the hash of the whole set; null for a text without words."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                v, n, high, low = [], [], [], []
                for t in part.column(1):
                    sh = shingles(t.as_py() or "")
                    n.append(len(sh))
                    v.append(np.uint64(xxhash.xxh64_intdigest(sh.tobytes())).astype(np.int64).item() if len(sh) else None)
                    strings = signature(sh) if len(sh) else (None, None)
                    high.append(strings[0])
                    low.append(strings[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int32())), part.column(2), part.column(3)], names=["id", "v", "n", "high", "low", "t", "t2"])
        give_back()

    return docs.mapInArrow(run, f"id {kind}, v long, n long, high array<long>, low array<int>, t long, t2 long")


def _nodes(strings: DataFrame, lengths: list[int]) -> DataFrame:
    """(a, b, length) from sorted (tree, high, low, v): sets that share a node, each with the
    first set of the node, by the longest of the lengths.

    A range of the order is a task; what two ranges share at their edge is found
    from their last and first strings, two rows a range, on the driver.
    """
    lengths = sorted(lengths, reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last string and the first sets of its nodes
        part, edge = TaskContext.get().partitionId(), []
        out = lambda a, b, n, ends=(): pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "length": pa.array(n, pa.int32()), "ends": pa.array(ends or [None] * len(a), pa.list_(pa.int64()))})
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, high, low, v = (c.to_numpy() for c in batch.columns)
            if before is None:
                edge.append([part, 0, int(tree[0]), int(high[0]), int(low[0]), int(v[0])])
                heads = {k: v[0] for k in lengths}
            else:
                tree, high, low, v = (np.concatenate([[x], y]) for x, y in zip(before, (tree, high, low, v), strict=True))
            shared = shared_symbols(high, low)
            shared[1:][tree[1:] != tree[:-1]] = -1
            at, known = np.arange(len(v)), v.copy()
            for k in lengths:
                first = np.maximum.accumulate(np.where(shared < k, at, 0))
                head = np.where(first == 0, heads[k], v[first])
                new = np.flatnonzero((head != known) & (head != v) & (at > 0))
                if len(new):
                    yield out(v[new], head[new], np.full(len(new), k))
                known = np.where(head != v, head, known)
                heads[k] = head[-1]
            before = (tree[-1], high[-1], low[-1], v[-1])
        if before is not None:
            edge.append([part, 1, *map(int, before)])
            yield out([None] * 2, [None] * 2, [None] * 2, edge)

    found = cut(strings.mapInArrow(run, "a long, b long, length int, ends array<long>"))
    ends = sorted(r["ends"] for r in found.where("ends is not null").select("ends").collect())
    more = []
    for (_, _, *x), (_, side, *y) in zip(ends, ends[1:], strict=False):
        if side == 0 and x[0] == y[0]:
            n = int(shared_symbols(np.asarray([x[1], y[1]]), np.asarray([x[2], y[2]], np.int32))[1])
            more += [(y[3], x[3], max(k for k in lengths if k <= n))] if n >= lengths[-1] else []
    found = found.where("a is not null").select("a", "b", "length")
    if more:
        columns = [pa.array(c, t) for c, t in zip(zip(*more, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)]
        # a list of rows would start workers of another kind, which stay in memory beside those of the tasks
        found = found.union(found.sparkSession.createDataFrame(pa.Table.from_arrays(columns, names=["a", "b", "length"])))
    return found.groupBy("a", "b").agg(F.max("length").alias("length"))


def _sets(rows: DataFrame) -> DataFrame:
    """(v, sh) from (text, v): the shingles where the text has the set v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for part in parts(b, 0):
                vs, found = [], []
                for t, v in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    if v in done:  # a row that repeats
                        continue
                    s = shingles(t.as_py() or "")
                    if len(s) and np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64) == v:
                        done.add(v)
                        vs.append(v)
                        found.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(found, pa.binary())], names=["v", "sh"])
        give_back()

    return rows.mapInArrow(run, "v long, sh binary")


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of left reach the threshold with which of right (of left itself if None)."""
    every = left if right is None else left + right
    sizes = np.asarray([len(s) for s in every])
    m, cut_at = len(every), len(left)
    owner = np.repeat(np.arange(m), sizes)
    values = np.concatenate(every)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    df = np.diff(np.append(first, len(values)))
    inter = np.zeros(m * m)
    for d in np.unique(df[(df > 1) & (df <= DENSE)]):
        starts, step = first[df == d], max(1, COUNTED // int(d * d))
        for at in range(0, len(starts), step):
            who = owner[starts[at : at + step, None] + np.arange(d)]
            inter += np.bincount((who[:, :, None] * m + who[:, None, :]).ravel(), minlength=m * m)
    inter = inter.reshape(m, m)
    common = np.flatnonzero(df > DENSE)
    for at in range(0, len(common), 2048):
        cols = common[at : at + 2048]
        x = np.zeros((m, len(cols)), np.float32)
        x[owner[np.concatenate([np.arange(first[c], first[c] + df[c]) for c in cols])], np.repeat(np.arange(len(cols)), df[cols])] = 1
        inter += x @ x.T
    total = sizes[:, None] + sizes[None, :]
    linked = inter * (1 + threshold) >= threshold * total - 1e-9
    np.fill_diagonal(linked, False)
    if right is not None:
        linked[:cut_at, :cut_at] = False
        linked[cut_at:, cut_at:] = False
    return linked


def _roots(linked: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest v that each set hangs together with."""
    label = v.copy()
    while True:
        low = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, low)
        if (new == label).all():
            return label
        label = new


def _verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """(v, links, docs, root) of each set and pair of blocks (c, lo, hi), from sorted rows."""

    def group(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({r[3]: r for r in rows}.values())
        lo, hi = rows[0][1], rows[0][2]
        sides = [rows] if lo == hi else [[r for r in rows if r[4] == lo], [r for r in rows if r[4] == hi]]
        if not all(sides) or len(rows) < 2:
            return None
        rows = [r for s in sides for r in s]
        sets = [[np.frombuffer(r[6], np.uint64) for r in s] for s in sides]
        linked = _links(sets[0], sets[1] if len(sets) > 1 else None, threshold)
        n = linked.sum(axis=1)
        keep = np.flatnonzero(n)
        if not len(keep):
            return None
        v = np.asarray([r[3] for r in rows], np.int64)
        docs = linked @ np.asarray([r[5] for r in rows], np.int64)
        return pa.RecordBatch.from_pydict({"v": v[keep], "links": n[keep].astype(np.int64), "docs": docs[keep], "root": _roots(linked, v)[keep]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for part in parts(b, 6):
                for r in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held and held[0][:3] != r[:3]:
                        if (out := group(held)) is not None:
                            yield out
                        held = []
                    held.append(r)
        if held and (out := group(held)) is not None:
            yield out
        held.clear()
        give_back()

    return blocks.mapInArrow(run, "v long, links long, docs long, root long")


def _length(nodes: DataFrame, pool: DataFrame, lengths: list[int], threshold: float) -> int:
    """The longest of the lengths by whose nodes the target recall is reached, as the links among
    all pairs (a, b) of the nodes say; the last if none is proved to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 1, np.int64)
        for part in (p for b in batches for half in parts(b, 0) for p in parts(half, 1)):
            for x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar = both / (len(x) + len(y) - both)
                if similar >= threshold - 1e-9:
                    counts[int(similar * BINS + 1e-9)] += 1
        give_back()
        yield pa.RecordBatch.from_pydict({"bin": np.arange(BINS + 1), "n": counts})

    side = lambda v, sh: pool.select(F.col("v").alias(v), F.col("sh").alias(sh))
    pairs = nodes.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    similar = np.zeros(BINS + 1)
    for r in pairs.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        similar[r["bin"]] = r["n"]
    return next((k for k in lengths if unseen(similar, threshold, k) <= (1 - RECALL) * similar.sum()), lengths[-1])


def _dealt(groups: DataFrame, pool: DataFrame) -> DataFrame:
    """Sets (v, sh, ...) of the groups (v, c), sorted by pair of blocks."""
    grouped = groups.select(F.col("v").alias("w"), "c").join(pool.select("v", "n"), F.col("v") == F.col("w"))
    loads = grouped.groupBy(F.col("c").alias("k")).agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("nb"))
    grouped = groups.select(F.col("v").alias("w"), "c").join(loads, F.col("c") == F.col("k")).drop("k").join(pool, F.col("v") == F.col("w")).drop("w")
    block = F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")
    dealt = grouped.select("c", "v", "copies", "sh", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("c", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "v", "block", "copies", "sh")
    return dealt.repartition(F.col("c"), F.col("lo"), F.col("hi")).sortWithinPartitions("c", "lo", "hi", "v")


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows (id, v, t, t2), and of each set w its class: root, class_id and the counts."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    own = own.select("id", "text", *_digest())
    signed = cut(_signed(own))
    # the strings depend on the set alone
    sets = signed.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.min(_row()).alias("at"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("high").alias("high"), F.first("low").alias("low"))
    sets = cut(sets)
    small = sets.drop("high", "low")
    shortest = prefix_length(threshold)
    lengths = sorted({*range(DEPTH, shortest, -STEP), shortest}, reverse=True)
    strings = sets.select("v", F.posexplode(F.arrays_zip("high", "low")).alias("tree", "s")).select("tree", "s.high", "s.low", "v")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() * TREES // RANGE_ROWS))
    nodes = cut(_nodes(strings.repartitionByRange(ranges, "tree", "high", "low", "v").sortWithinPartitions("tree", "high", "low", "v"), lengths))

    met = nodes.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    met = met.join(small, "v").select(F.col("at.id").alias("at_id"), F.col("at.t").alias("at_t"), F.col("at.t2").alias("at_t2"), "v")
    # a row of the set itself: an id, also a null, may stand at other texts
    same = F.col("id").eqNullSafe(F.col("at_id")) & (F.col("t") == F.col("at_t")) & (F.col("t2") == F.col("at_t2"))
    texts = own.join(met.hint("shuffle_hash"), same).select("text", "v")
    pool = _sets(texts).groupBy("v").agg(F.first("sh").alias("sh")).join(small.select(F.col("v").alias("w"), "n", "copies"), F.col("v") == F.col("w")).drop("w")
    pool = cut(pool)

    length = _length(nodes, pool, lengths, threshold)
    groups = cut(components(nodes.where(F.col("length") >= length).select("a", "b")))
    found = cut(_verified(_dealt(groups, pool), threshold))

    links = found.groupBy("v").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    classes = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    classed = links.join(classes.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).drop("w")
    classed = cut(classed.join(small.select(F.col("v").alias("w"), "rep"), F.col("v") == F.col("w")).select("v", "links", "docs", "c", "rep"))
    least = classed.groupBy("c").agg(F.min("rep").alias("least"))
    classed = classed.join(least, "c").select(F.col("v").alias("w"), "links", "docs", "least", "c")
    whole = small.join(classed, F.col("v") == F.col("w"), "left").select(
        F.col("v").alias("w"), F.coalesce("c", "v").alias("root"), "at", F.coalesce("least", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_linked_docs"), F.col("copies").alias("n_copies")
    )
    return signed, cut(whole)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_links, n_linked_docs, n_copies.

    Two texts are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``threshold``.  class_id is the smallest id of the
    documents that hang together by links; n_links counts the other distinct
    sets linked to the document's, n_linked_docs the other documents, copies
    included; n_copies the documents with the same set, itself included.

    A text of one to four words is one shingle and links to its copies alone.
    Very long texts are sets as any other; a block holds at least one of them.
    Null, empty and blank texts have no shingle: each is a class of its own.
    Rows that repeat are copies of each other.  An empty table gives no rows;
    other columns are not read.  A document without an id gets the class of its
    links, null if none of them has an id.
    """
    signed, whole = _classes(docs, threshold, id_col, text_col)
    # from a table of its own, so that a set with very many copies can be split among tasks
    out = signed.select("id", "v").join(whole, F.col("v") == F.col("w"), "left")
    lone = F.col("w").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(lone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id.

    Rows are told apart by id and text; of rows that share both one stays, by
    its content.  A row without an id stays if its class has none with one, as
    the only row of the class.  Texts without words are classes of their own:
    of those with an id, rows that share id and text count once.
    """
    names = docs.columns
    _, whole = _classes(docs, threshold, id_col, text_col)
    first = whole.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.id").alias("i"), F.col("at.t").alias("it"), F.col("at.t2").alias("it2"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("row", "id", *_digest(), F.coalesce(F.col("text").rlike(r"[^ \t\n\r\x0B\f]"), F.lit(False)).alias("words"), F.col("text").isNull().alias("none"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("it")) & (F.col("t2") == F.col("it2"))
    found = rows.where("words").join(first.hint("shuffle_hash"), same).drop("i", "it", "it2")
    lone = rows.where(~F.col("words"))
    found = found.union(lone.where("id is not null"))
    found = found.groupBy("id", "t", "t2", "none").agg(F.min_by("row", F.xxhash64("row")).alias("row"))  # combines before the shuffle
    found = found.select("row").union(lone.where("id is null").select("row"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in names])
