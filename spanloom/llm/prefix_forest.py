"""Approximate nearest neighbours by a hash-prefix forest.

A tree hashes a vector to a string of BITS symbols: on which side of as many
random planes it lies.  A tree is the trie of its strings, kept as their sorted
order: a node is a run of entries that share a prefix.  The trees lie in one
range-sorted table of (tree, string, number of the vector); vectors stay out.

A query *descends* each tree to its own place and takes the deepest node above
it with k other entries, of those at most NEAR places away.  They are scored
exactly, and the last of the best k + 1 says how near a neighbour must be to count.

Then all trees *ascend* together, from the longest prefixes on, a symbol at a
time: at length L a query's candidates are the entries that share L symbols with
it in some tree.  The ascent ends where that is enough, as measured for each
query: TRIALS random vectors as near to it as the last of its neighbours are
hashed, and FOUND of them must share L symbols with it in some tree.  The nodes
of that length are whole: a query goes to every range that holds a part of one.

Where a node of that length holds too many entries (more than ``most_of``), or
trees * 2^-L is 1 / SHARE or more, the query goes on to the root: it is scored against the
whole index, in blocks of ASKED_ROWS queries, which then costs less than the
nodes and misses nothing.  Equal vectors enter as one, with the smallest ids
that can matter.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.session import cut

TREES = 24
BITS = 62
#: places on either side of its own that a query's descent looks at
NEAR = 12
SALTS = 64
RANGE_ROWS = 40_000
#: at most so many ranges, whose ends are broadcast
MOST_RANGES = 20_000
TRIALS = 32
FOUND = 0.95
SHARE = 16
ASKED_ROWS = 8192
PAIRS = 200_000
DIGITS = 12


def most_of(n: int) -> int:
    """Entries of a node, in one range, that a query still takes from an index of n vectors."""
    return max(256, n // 64)


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(11).normal(size=(dim, trees * BITS))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square leaves the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, trees) hash strings as integers whose order is that of the strings."""
    sides = np.zeros((len(unit), planes.shape[1] // BITS, 64), bool)
    sides[:, :, 64 - BITS :] = (unit @ planes > 0).reshape(len(unit), -1, BITS)
    return np.packbits(sides, axis=2).view(">i8")[:, :, 0].astype(np.int64)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols two strings share from their start."""
    high, low = np.divmod(a ^ b, 1 << 31)
    return BITS - np.where(high > 0, 31 + np.frexp(high.astype(float))[1], np.frexp(low.astype(float))[1])


def _enough(x: np.ndarray, score: float, planes: np.ndarray, random: np.random.Generator) -> int:
    """The longest prefix that FOUND of random vectors at cosine ``score`` from the unit
    vector x share with it in some tree."""
    u = random.normal(size=(TRIALS, len(x)))
    u -= np.outer(u @ x, x)
    size = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, size, out=np.zeros_like(u), where=size > 1e-9)
    score = min(1.0, max(-1.0, score))
    y = score * x + math.sqrt(1 - score * score) * u
    length = _shared(_strings(y, planes), _strings(x[None], planes)).max(axis=1)
    return int(np.sort(length)[int((1 - FOUND) * TRIALS)])


def _scored(index: DataFrame, wanted: DataFrame, pairs: DataFrame | None, dim: int, k: int) -> DataFrame:
    """(q, ids, score): in each task the k + 1 nearest of the queries wanted (q, v, least), if not below
    ``least``; among the pairs (q, rep), or in the whole index (rep, ids, v)."""
    spark = index.sparkSession
    n = wanted.count()
    blocks = max(1, math.ceil(n / ASKED_ROWS))
    block_of = F.pmod(F.xxhash64("q"), F.lit(blocks))
    out = spark.createDataFrame([], "q long, ids array<long>, score double")
    for block in range(blocks if n else 0):
        rows = wanted.where(block_of == block).select("q", "v", "least").orderBy("q").collect()
        if not rows:
            continue
        asked = spark.sparkContext.broadcast((np.asarray([r["q"] for r in rows]), np.asarray([r["least"] for r in rows]), _unit(np.asarray([r["v"] for r in rows]))))
        if pairs is None:
            looked = index.select("ids", "v", F.lit(None).cast("array<long>").alias("by")).coalesce(4 * spark.sparkContext.defaultParallelism)
        else:
            by = pairs.where(block_of == block).groupBy(F.col("rep").alias("near")).agg(F.collect_set("q").alias("by"))
            looked = index.join(by, F.col("rep") == F.col("near")).select("ids", "v", "by")

        def run(batches: Iterator[pa.RecordBatch], asked=asked, whole=pairs is None) -> Iterator[pa.RecordBatch]:
            q, least, x = asked.value
            least = least.copy()
            best: list = [None] * len(q)

            def scores(y: np.ndarray, by: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                """(query, row of y, score), by query."""
                if whole:
                    for first in range(0, len(q), 1024):
                        s = x[first : first + 1024] @ y.T
                        j, row = np.nonzero(s >= least[first : first + 1024, None] - 10.0**-DIGITS)
                        yield j + first, row, s[j, row]
                    return
                j = np.searchsorted(q, by.flatten().to_numpy())
                row = np.repeat(np.arange(len(by)), np.diff(by.offsets.to_numpy()))
                order = np.argsort(j, kind="stable")
                for at in range(0, len(j), PAIRS):
                    some, to = j[order[at : at + PAIRS]], row[order[at : at + PAIRS]]
                    s = np.einsum("ij,ij->i", x[some], y[to])
                    good = s >= least[some] - 10.0**-DIGITS
                    yield some[good], to[good], s[good]

            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    b = batch.slice(at, 1000)
                    ids = pa.concat_arrays([b.column(0)])  # offsets from 0
                    first_id = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1]]
                    y = _unit(b.column(1).flatten().to_numpy().reshape(-1, dim))
                    for some, to, s in scores(y, pa.concat_arrays([b.column(2)])):
                        if not len(some):
                            continue
                        s = np.round(s, DIGITS)
                        for start, end in zip(cuts := np.flatnonzero(np.diff(some, prepend=-1)), np.append(cuts[1:], len(some)), strict=True):
                            one, here, score = some[start], to[start:end], s[start:end]
                            order = np.lexsort((first_id[here], -score))[: k + 1]
                            new = [(-float(score[o]), int(first_id[here[o]]), ids[int(here[o])].as_py()) for o in order]
                            best[one] = sorted((best[one] or []) + new)[: k + 1]
                            if len(best[one]) == k + 1:
                                least[one] = max(least[one], -best[one][-1][0])
            got = [(int(q[j]), i, -s) for j, found in enumerate(best) for s, _, i in found or []]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.float64())], names=["q", "ids", "score"])

        out = out.union(cut(looked.mapInArrow(run, "q long, ids array<long>, score double")))
        asked.unpersist()
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): not null, every component finite, not all zero, of the most frequent dimension."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    dims = v.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    return v.where(F.size("v") == (dims[0]["dim"] if dims else 0))


def _distinct(v: DataFrame, k: int) -> DataFrame:
    """(a, b, rep, ids): for every distinct vector a number of its own and its k smallest ids.

    The ids of a vector are ranked within salts first, so a vector that many
    rows share is never sorted in one task.
    """
    keys = v.select("id", "a", "b").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("nth") <= k)
    few = first(first(keys, "a", "b", "salt"), "a", "b")
    return few.groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("a", "b", F.col("a").alias("rep"), "ids")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES) -> DataFrame:
    """The k nearest of each query by cosine: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``, candidates all
    other rows.  Vectors that are null, zero, of another dimension than most or
    that hold null or non-finite components take no part.  Ties go to the
    smaller id; scores are rounded to DIGITS digits, so that rounding errors
    don't part them.  Fewer than k candidates give fewer rows.  Rows that repeat
    id and vector count once; of an id with several vectors the best score of
    any of them counts, as query and as candidate.  Other columns are not read.
    An empty table, or one without usable vectors, gives no rows.
    """
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vector_col).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})
    v = cut(v.dropDuplicates(["id", "a", "b"]))
    reps = cut(_distinct(v, k + 1))
    n = reps.count()
    first = v.limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n or not first:
        return spark.createDataFrame([], schema)
    dim = len(first[0]["v"])
    asked = v.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "a", "b")
    asked = cut(asked.join(reps.select("a", "b", "rep"), ["a", "b"]).select("query_id", "rep"))
    wanted = asked.select(F.col("rep").alias("q")).distinct()
    index = reps.withColumn("id", F.col("ids")[0]).join(v, ["a", "b", "id"]).join(wanted, F.col("rep") == F.col("q"), "left").select("rep", "ids", "v", F.col("q").isNotNull().alias("asked"))
    index = cut(index)
    asked_ = index.where("asked").select(F.col("rep").alias("q"), "v")
    ranges = min(MOST_RANGES, math.ceil(n * trees / RANGE_ROWS))
    most = most_of(n)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, trees)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                code = _strings(_unit(b.column(1).flatten().to_numpy().reshape(-1, dim)), planes)
                row = pa.array(np.repeat(np.arange(b.num_rows), trees))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), b.num_rows)), pa.array(code.ravel()), b.column(0).take(row), b.column(2).take(row)], names=["tree", "code", "rep", "asked"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            yield b.append_column("part", pa.array(np.full(b.num_rows, part, np.int32)))

    def descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        b = pa.Table.from_batches(held)
        tree, code, rep = (b[c].to_numpy() for c in ("tree", "code", "rep"))
        asks = np.flatnonzero(b["asked"].to_numpy())
        for at in range(0, len(asks), 10_000):
            own = asks[at : at + 10_000, None]
            there = own + np.arange(-NEAR, NEAR + 1)
            inside = (there >= 0) & (there < len(code))
            there = np.where(inside, there, own)
            length = np.where(inside & (tree[there] == tree[own]), _shared(code[there], code[own]), -1)
            # its own place and the k places with the longest prefixes, and all that share as much
            deep = np.sort(length, axis=1)[:, -min(k + 1, length.shape[1])]
            one, place = np.nonzero((length >= deep[:, None]) & (length >= 0))
            yield pa.RecordBatch.from_pydict({"q": rep[own[one, 0]], "rep": rep[there[one, place]]})

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, trees)
        parts, firsts, lasts, rows = ends.value
        for b in batches:
            out = []
            for q, v, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = _unit(np.asarray([v]))
                level = 0 if least <= -2 else _enough(x[0], least, planes, np.random.default_rng(abs(q)))
                nodes = []
                if trees * SHARE < 1 << level:
                    shift = BITS - level
                    for t, code in enumerate(_strings(x, planes)[0].tolist()):
                        low = code >> shift << shift
                        high = low + (1 << shift) - 1
                        i, j = bisect_left(lasts, (t, low)), bisect_right(firsts, (t, high))
                        if sum(rows[i + 1 : j - 1]) > most:
                            nodes = []
                            break
                        nodes += [(q, parts[p], t, low, high) for p in range(i, j)]
                out += nodes or [(q, -1, 0, 0, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate([pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])], names=["q", "part", "tree", "low", "high"])

    def ascended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        b = pa.Table.from_batches(held)
        part, tree, code, rep, q, high, node = (b[c].to_numpy() for c in ("part", "tree", "code", "rep", "q", "high", "node"))
        at, asks = np.flatnonzero(~node), np.flatnonzero(node)
        part_, tree_, code_, rep_ = part[at], tree[at], code[at], rep[at]
        # runs of one tree in one range
        key = part_.astype(np.int64) * trees + tree_
        found, size = [], 0
        for r in asks:
            start, end = np.searchsorted(key, [k_ := int(part[r]) * trees + int(tree[r]), k_ + 1])
            i, j = start + np.searchsorted(code_[start:end], code[r]), start + np.searchsorted(code_[start:end], high[r], "right")
            too_many = j - i > most
            reps = rep_[i:j] if not too_many else rep_[i : i + 1]
            found.append((np.full(len(reps), q[r]), reps, np.full(len(reps), too_many)))
            size += len(reps)
            if size > 500_000 or r == asks[-1]:
                yield pa.RecordBatch.from_pydict({c: np.concatenate(x) for c, x in zip(("q", "rep", "root"), zip(*found, strict=True), strict=True)})
                found, size = [], 0

    order = [F.desc("score"), "vec_id"]

    def best(rows: DataFrame) -> DataFrame:
        rows = rows.select("q", F.explode("ids").alias("vec_id"), "score").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
        return rows.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("nth") <= k + 1).select("q", "vec_id", "score", "nth")

    forest = index.select("rep", "v", "asked").mapInArrow(entries, "tree int, code long, rep long, asked boolean")
    forest = forest.repartitionByRange(ranges, "tree", "code", "rep").sortWithinPartitions("tree", "code", "rep")
    forest = cut(forest.mapInArrow(placed, "tree int, code long, rep long, asked boolean, part int"))
    place = F.struct("tree", "code")
    found = forest.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    ends = spark.sparkContext.broadcast(([r["part"] for r in found], [tuple(r["first"]) for r in found], [tuple(r["last"]) for r in found], [r["n"] for r in found]))

    deepest = forest.mapInArrow(descended, "q long, rep long").distinct()
    near = _scored(index, asked_.withColumn("least", F.lit(-2.0)), deepest, dim, k)
    least = best(near).where(F.col("nth") == k + 1).select(F.col("q").alias("of"), "score")
    wanted = cut(asked_.join(least, F.col("q") == F.col("of"), "left").select("q", "v", F.coalesce("score", F.lit(-2.0)).alias("least")))
    nodes = cut(wanted.mapInArrow(planned, "q long, part int, tree int, low long, high long"))
    roots = nodes.where("part = -1").select("q")
    if not nodes.where("part <> -1").isEmpty():
        none = F.lit(0).cast("long")
        both = forest.select("part", "tree", "code", "rep", none.alias("q"), none.alias("high"), F.lit(False).alias("node"))
        both = both.union(nodes.where("part <> -1").select("part", "tree", "low", none, "q", "high", F.lit(True)))
        seen = cut(both.repartition(ranges, "part").sortWithinPartitions("part", "tree", "code").mapInArrow(ascended, "q long, rep long, root boolean"))
        roots = roots.union(seen.where("root").select("q")).distinct()
        near = near.union(_scored(index, wanted.join(roots, "q", "left_anti"), seen.join(roots, "q", "left_anti"), dim, k))
    near = near.union(_scored(index, wanted.join(roots, "q", "left_semi"), None, dim, k))
    near = best(near).groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))
    out = asked.join(near, F.col("rep") == F.col("q"))
    # the k + 1 best of each of its vectors, without the query itself
    out = out.select("query_id", F.explode("near").alias("x")).select("query_id", "x.vec_id", "x.score").where("vec_id <> query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
