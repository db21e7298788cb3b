"""The boosted trees of ``boosted_trees``, learned from every row of a table.

Rows stay where they are, as blocks of binned features.  Trees grow level by
level: a pass over the blocks sums gradients by open node, feature and bin, and
the driver, which sees these sums alone, chooses the splits.  Gradients are
whole multiples of 1 / SCALE, so sums, and with them the trees, depend neither
on the order of the rows nor on partitions.  Bins come from exact counts on a
fixed grid with 256 steps from one power of two to the next; features are not
negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.batches import give_back
from spanloom.llm.boosted_trees import Forest, constant
from spanloom.session import cut

SCALE = 1 << 24
#: rows of one task of a pass
TASK_ROWS = 50_000
_GRID = 44  # bits of a double below the grid


def _edges(keys: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The largest doubles of the grid's cells that hold the quantiles."""
    at = np.searchsorted(np.cumsum(counts), np.arange(1, bins) / bins * counts.sum(), "left")
    cells = np.unique(keys[np.minimum(at, len(keys) - 1)])
    return (((cells + 1) << _GRID) - 1).view(float)


def _margin(x: np.ndarray, trees: list[tuple], start: float, depth: int) -> np.ndarray:
    """Of binned rows; a tree is (feature, bin, value) of a full tree's nodes in breadth-first order."""
    out, rows = np.full(len(x), start), np.arange(len(x))
    for feature, split, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > split[at])
        out += value[at]
    return out


def train_whole(rows: DataFrame, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Fit to all rows (x, y): the features as the bytes of doubles, and labels 0 and 1.
    With one class only, or no rows, the forest is constant."""
    width = len(monotone)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(b.column(0).to_pylist())], pa.binary()), pa.array([b.column(1).to_numpy().astype(np.uint8).tobytes()], pa.binary())], names=["x", "y"])

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cells = np.frombuffer(x, np.int64).reshape(-1, width) >> _GRID
                for f, column in enumerate([*cells.T, np.frombuffer(y, np.uint8).astype(np.int64)]):
                    keys, n = np.unique(column, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), f, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))], names=["f", "key", "n"])

    packed = cut(rows.mapInArrow(pack, "x binary, y binary"))
    found = packed.mapInArrow(grid, "f int, key long, n long").groupBy("f", "key").agg(F.sum("n").alias("n")).toArrow().sort_by([("f", "ascending"), ("key", "ascending")])
    fs, keys, n = (found.column(c).to_numpy() for c in ("f", "key", "n"))
    classes = dict(zip(keys[fs == width].tolist(), n[fs == width].tolist(), strict=True))
    total = sum(classes.values())
    if not total:
        return constant(0.999)
    p = float(np.clip(classes.get(1, 0) / total, 1e-3, 1 - 1e-3))
    if len(classes) < 2:
        return constant(p)
    edges = [_edges(keys[fs == f], n[fs == f], bins) for f in range(width)]
    start = float(np.log(p / (1 - p)))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = []
            for x in b.column(0).to_pylist():
                x = np.frombuffer(x).reshape(-1, width)
                xs.append(np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), b.column(1)], names=["x", "y"])

    blocks = cut(packed.mapInArrow(binned, "x binary, y binary").repartition(-(-total // TASK_ROWS)))

    def sums(done: list[tuple], now: tuple, level: int) -> np.ndarray:
        """Of gradients, second derivatives and rows, by feature, node of the level and bin."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(x, y) for b in batches for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if held:
                x = np.frombuffer(b"".join(x for x, _ in held), np.uint8).reshape(-1, width)
                y = np.frombuffer(b"".join(y for _, y in held), np.uint8)
                prob = 1 / (1 + np.exp(-_margin(x, done, start, depth)))
                weights = [np.rint((prob - y) * SCALE), np.rint(prob * (1 - prob) * SCALE), None]
                at, every = np.zeros(len(x), np.int64), np.arange(len(x))
                for _ in range(level):
                    at = 2 * at + 1 + (x[every, now[0][at]] > now[1][at])
                cell = (at - (2**level - 1)) * bins
                out = np.stack([[np.bincount(cell + x[:, f], w, bins << level) for f in range(width)] for w in weights]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])
            give_back()

        parts = blocks.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r["sums"], np.int64) for r in parts).reshape(3, width, 1 << level, bins)

    def best(g: np.ndarray, h: np.ndarray, n: np.ndarray, low: float, high: float) -> tuple | None:
        """(gain, feature, bin, left, right) from one node's sums by feature and bin; a side is (value, g, h, rows)."""
        all_g, all_h, all_n = g[0].sum(), h[0].sum(), n[0].sum()
        out = (1e-6,)
        if all_n < 2 * least:
            return None
        for f, e in enumerate(edges):
            gs, hs, ns = (np.cumsum(c[f])[: len(e)] for c in (g, h, n))
            gr, hr = all_g - gs, all_h - hs
            lv, rv = np.clip(-gs / (hs + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - all_g**2 / (all_h + l2)
            ok = (ns >= least) & (all_n - ns >= least)
            if monotone[f]:
                ok &= (rv - lv) * monotone[f] >= 0
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax()) if len(e) else -1
            if k >= 0 and gain[k] > out[0]:
                out = (float(gain[k]), f, k, (float(gs[k]), float(hs[k])), (float(gr[k]), float(hr[k])), float(lv[k]), float(rv[k]))
        return out if len(out) > 1 else None

    size, done = 2 ** (depth + 1) - 1, []
    for _ in range(trees):
        feature, split, value = np.zeros(size, np.int64), np.full(size, 255, np.int64), np.zeros(size)
        bounds = {0: (-np.inf, np.inf)}  # of the nodes that may be split
        for level in range(depth):
            if not bounds:
                break
            g, h, n = sums(done, (feature, split), level)
            following = {}
            for node, (low, high) in bounds.items():
                k = node - (2**level - 1)
                ng, nh = g[:, k] / SCALE, h[:, k] / SCALE
                if not node:
                    value[:] = rate * np.clip(-ng[0].sum() / (nh[0].sum() + l2), low, high)
                if (chosen := best(ng, nh, n[:, k], low, high)) is None:
                    continue
                _, f, at, *sides, lv, rv = chosen
                feature[node], split[node] = f, at
                middle = (lv + rv) / 2
                limits = [(low, high), (low, high)]
                if monotone[f] > 0:
                    limits = [(low, middle), (middle, high)]
                elif monotone[f] < 0:
                    limits = [(middle, high), (low, middle)]
                for child, (sg, sh), (a, b) in zip((2 * node + 1, 2 * node + 2), sides, limits, strict=True):
                    inside = [child]
                    while inside:  # what is not split further gives its value to all below
                        value[inside] = rate * np.clip(-sg / (sh + l2), a, b)
                        inside = [c for i in inside for c in (2 * i + 1, 2 * i + 2) if c < size]
                    following[child] = (a, b)
            bounds = following
        done.append((feature, split, value))

    flat: list[list] = []
    roots = []
    for feature, split, value in done:
        base = len(flat)
        roots.append(base)
        for i in range(size):
            leaf = split[i] == 255
            flat.append([-1, 0.0, -1, -1, value[i]] if leaf else [feature[i], float(edges[feature[i]][split[i]]), base + 2 * i + 1, base + 2 * i + 2, value[i]])
    cols = zip(*flat, strict=True)
    return Forest(*(np.asarray(c, t) for c, t in zip(cols, (np.int64, float, np.int64, np.int64, float), strict=True)), np.asarray(roots), depth, start)
