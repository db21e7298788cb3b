"""Mixing sources to target weights by entropy balancing.

Each document d of source s gets the rate r_d = min(cap, exp(lambda_s * x_d))
where x_d is its size against the mean size: the rates nearest to 1 in relative
entropy whose words sum to the source's target.  Newton's method on the convex
dual finds lambda_s; as sources share no document, the Hessian is diagonal and
every source takes its own safeguarded step in one distributed pass.  Passes
run over counts by (source, size), far fewer rows than documents.  The rates
are then rounded into copies, so that the words taken stay next to the target.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.session import cut

WEIGHTS = (3.0, 1.0, 2.0)
TOLERANCE = 1e-7
MAX_STEPS = 60
SALTS = 64


def targets(sources: DataFrame, share: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """The words wanted of each source: (source, source_size) -> also target.

    The share of all words is dealt by weight; a target stops at cap times its
    source's size and the excess goes to the others by weight, until none is
    above.  That is min(cap * size, level * weight) for one level: ordered by
    the ratio of cap to weight, a source is stopped as long as the level that
    the rest would get lies above its own ratio.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.orderBy("ratio", "place")
    placed = sources.select("source", "source_size", F.row_number().over(order).alias("place"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    dealt = placed.select("*", weight.alias("weight"))
    dealt = dealt.select("*", (cap * F.col("source_size")).alias("most"), (cap * F.col("source_size") / F.col("weight")).alias("ratio"))
    whole = W.partitionBy()
    rest = dealt.select(
        "*",
        (share * F.sum("source_size").over(whole)).alias("all"),
        F.coalesce(F.sum("most").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("stopped"),
        F.sum("weight").over(every.rowsBetween(0, W.unboundedFollowing)).alias("open"),
    )
    level = (F.col("all") - F.col("stopped")) / F.col("open")
    fits = F.struct(F.col("ratio"), F.col("place"), level.alias("level"))
    rest = rest.select("*", F.min(F.when(level <= F.col("ratio"), fits)).over(whole)["level"].alias("level"))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return rest.select("source", "source_size", target.cast("double").alias("target"))


def tilts(cells: DataFrame, wanted: DataFrame, cap: float) -> DataFrame:
    """lambda of each source by Newton's method on the dual.

    cells: (source, size, n).  Each pass sums gradient and curvature by source
    and steps; a step out of the bracket halves it.  A source at its cap, or
    without words, needs no tilt: its rates are cap.
    """
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    state = (
        wanted.join(mean.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .select(
            "source", "target", "mean",
            (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("capped"),
            F.lit(0.0).alias("tilt"),
            F.lit(None).cast("double").alias("low"),
            (F.log(F.lit(cap)) * F.col("mean") / F.col("least") + 1).alias("high"),
            F.lit(None).cast("double").alias("off"),
        )
    )
    state = cut(state)
    cells = cells.select(F.col("source").alias("cell_source"), F.col("size").cast("double").alias("size"), "n")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(cap), F.exp(F.least(F.col("tilt") * x, F.lit(700.0))))
        words = F.col("n") * F.col("size")
        sums = (
            cells.join(state.where("not capped").select("source", "mean", "tilt"), F.col("cell_source").eqNullSafe(F.col("source")))
            .groupBy("source").agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < cap, words * rate * x).otherwise(0.0)).alias("slope"))
        )
        state = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        middle = F.when(low.isNull(), 2 * F.least(F.col("tilt"), F.lit(-0.5))).otherwise((low + high) / 2)
        step = F.when(step.isNull() | (step >= high) | (step <= low), middle).otherwise(step)
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        moved = F.col("capped") | F.col("got").isNull() | (off < TOLERANCE)
        state = state.select("source", "target", "mean", "capped", F.when(moved, F.col("tilt")).otherwise(step).alias("tilt"), low.alias("low"), high.alias("high"), F.when(moved, 0.0).otherwise(off).alias("off"))
        state = cut(state)
        if not state.where(F.col("off") > 0).limit(1).count():
            break
    return state.select("source", "target", "mean", "capped", "tilt")


def _copies(cap: float):
    def rounded(cells: pd.DataFrame) -> pd.DataFrame:
        """Copies of a source's cells: n documents of a size get base copies, extra of them one more.

        From the largest size on, what rounding left over or took too much is
        made up by the next smaller size, so the source ends within half of its
        smallest document of its target.
        """
        cells = cells.sort_values("size", ascending=False)
        due, extra = 0.0, []
        for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
            base = int(rate)
            room = n if base + 1 <= cap else 0
            due += (rate - base) * n * size
            k = min(room, max(0, round(due / size))) if size else 0
            due -= k * size
            extra.append(k)
        return pd.DataFrame({"source": cells["source"], "size": cells["size"], "base": cells["rate"].astype(int), "extra": extra})

    return rounded


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_columns: bool = False) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns id, size (words), source_size, target, rate, copies, taken; with
    ``keep_columns`` instead all columns of ``docs``, each row as often as the
    mix takes it.

    Null text has no words; a document without words has size 0, adds nothing
    to any target and is taken once.  A null source is a source, last in order.
    Equal rows are rows of their own; among rows of one source and size the
    hash of id and text decides who gets the extra copy, ties are
    interchangeable, so reruns agree.  An empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    pick = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.crc32(F.coalesce(text, F.lit(""))))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), pick.alias("pick"))
    rows = cut(rows)
    salt = F.pmod(F.col("pick"), F.lit(SALTS)).cast("int")
    salted = cut(rows.groupBy("source", "size", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n")))
    cells = salted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = cut(targets(sources, share, cap))
    tilt = tilts(cells, wanted, cap)

    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("capped"), cap).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))))
    rated = cells.join(tilt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", rate.cast("double").alias("rate"))
    copies = rated.groupBy("source").applyInPandas(_copies(cap), "source string, size long, base int, extra long")
    # the first documents of the cell in the order of salt and hash get the extra copies
    before = W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    salted = salted.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    to = lambda df, *cols: df.select(F.col("source").alias("s"), F.col("size").alias("z"), *cols)
    cell = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("size") == F.col("z"))
    dealt = (
        salted.join(to(copies, "base", "extra"), cell).drop("s", "z")
        .join(rated.select(F.col("source").alias("s"), F.col("size").alias("z"), "rate"), cell).drop("s", "z")
        .join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    )
    ranked = rows.select("*", salt.alias("salt"), F.row_number().over(W.partitionBy("source", "size", salt).orderBy("pick", "id")).alias("nth"))
    dealt = dealt.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t"), "source_size", "target", "rate", "base", "extra", "ahead")
    out = ranked.join(dealt, cell & (F.col("salt") == F.col("t")))
    n = (F.col("base") + F.when(F.col("ahead") + F.col("nth") <= F.col("extra"), 1).otherwise(0)).cast("long")
    out = out.select("id", "pick", "size", "source_size", "target", "rate", n.alias("copies"))
    if keep_columns:
        return _repeat(docs, out.select("id", "pick", "copies"), pick, id_col)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def _repeat(docs: DataFrame, copies: DataFrame, pick, id_col: str) -> DataFrame:
    """Every row of docs as often as the mix takes it, with its own columns.

    Rows of equal id and text are numbered on both sides, so each meets one count.
    """
    names = docs.columns
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), pick.alias("pick"))
    own = own.select("*", F.row_number().over(W.partitionBy("id", "pick").orderBy(F.xxhash64("row"))).alias("nth"))
    copies = copies.select(F.col("id").alias("i"), F.col("pick").alias("p"), "copies", F.row_number().over(W.partitionBy("id", "pick").orderBy(F.desc("copies"))).alias("n"))
    met = own.join(copies, F.col("id").eqNullSafe(F.col("i")) & (F.col("pick") == F.col("p")) & (F.col("nth") == F.col("n")))
    again = met.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return again.select(*[F.col("row").getField(c).alias(c) for c in names])
