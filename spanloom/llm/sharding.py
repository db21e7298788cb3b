"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``SLOTS`` positions.  Every shard owns ``virtual`` of them, its
virtual nodes; a key hashed to a position belongs to the first node clockwise.
The load bound is tight: a shard takes floor(n / shards) rows, and the n mod
shards shards with most keys of their own take one more, so the counts are at
most one apart.  Keys beyond their shard's bound queue up and go on clockwise
to the first node whose shard has room; all others stay where the hash put
them, so a change of n or of the shard count moves little.

Everything is DataFrame work.  Ranks come from a window over ring positions,
not over shards, so no task sees more than about 1 / SLOTS of the rows; the
walk along the ring is one fold over the nodes' counts, whose number is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLOTS = 8192


def _slot(*cols) -> Column:
    """A position on the ring from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 51).cast("int")


def ring(spark, n_shards: int, virtual: int) -> DataFrame:
    """Every position with the shard of the first virtual node at or after it.

    Nodes that meet on one position yield to the smaller hash.  The table has
    SLOTS rows whatever the input.
    """
    nodes = (
        spark.range(n_shards * virtual)
        .select(F.floor(F.col("id") / virtual).cast("int").alias("home"), F.xxhash64(F.lit("node"), "id").alias("h"), _slot(F.lit("node"), "id").alias("pos"))
        .groupBy("pos").agg(F.min_by("home", "h").alias("home"))
    )
    ahead = W.orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    first = W.orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        spark.range(SLOTS).select(F.col("id").cast("int").alias("pos")).join(nodes, "pos", "left")
        .select("pos", F.coalesce(F.first("home", True).over(ahead), F.first("home", True).over(first)).alias("home"), F.col("home").isNotNull().alias("node"))
    )


def _walk(positions: str, room: Column) -> Column:
    """Serve the queue of overflowing keys along the ring, two laps at most.

    positions: array of (pos, home, over, node, ...), in ring order; room: free rows by
    shard.  Returns the moves (shard, start, take, at): keys with overflow
    ranks from start on go to the shard, where they get the places from at on.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("carry"), F.lit(0).cast("long").alias("served"), room.alias("room"),
        F.expr("cast(array() as array<struct<shard:int,start:bigint,take:bigint,left:bigint>>)").alias("moves"),
    )

    def step(s: Column, x: Column) -> Column:
        waiting, free = s["carry"] + x["over"], F.get(s["room"], x["home"])
        take = F.least(waiting, free)
        move = F.struct(x["home"].alias("shard"), s["served"].alias("start"), take.alias("take"), free.alias("left"))
        left = F.transform(s["room"], lambda r, i: F.when(i == x["home"], r - take).otherwise(r))
        return F.when(take == 0, F.struct(waiting.alias("carry"), s["served"].alias("served"), s["room"].alias("room"), s["moves"].alias("moves"))).otherwise(
            F.struct((waiting - take).alias("carry"), (s["served"] + take).alias("served"), left.alias("room"), F.concat(s["moves"], F.array(move)).alias("moves"))
        )

    stops = F.filter(positions, lambda x: x["node"] | (x["over"] > 0))
    lap = lambda over: F.transform(stops, lambda x: F.struct(x["home"].alias("home"), over(x).alias("over")))
    return F.aggregate(F.concat(lap(lambda x: x["over"]), lap(lambda x: F.lit(0).cast("long"))), start, step)["moves"]


def shard_rows(docs: DataFrame, n_shards: int = 24, virtual: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard, counts at most one apart.

    Returns id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot (from 0,
    without gaps, in each shard) and grown_shard (null under this law).

    Null text counts as empty: size 8, checksum 0.  Null ids hash by their
    text's checksum, so that many of them don't meet on one position.  Equal
    rows are kept and may land in different shards.  An empty table gives no
    rows.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"))
    by = [F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.col("crc").cast("string")))]
    keys = keys.select("*", _slot(*by).alias("pos"), F.xxhash64(*by).alias("h"))
    counts = keys.groupBy("pos").agg(F.count(F.lit(1)).alias("n"))

    at = ring(spark, n_shards, virtual).join(F.broadcast(counts), "pos", "left").na.fill(0, ["n"])
    shards = spark.range(n_shards).select(F.col("id").cast("int").alias("home"))
    loads = shards.join(at.groupBy("home").agg(F.sum("n").alias("own")), "home", "left").na.fill(0, ["own"])
    every = W.partitionBy()  # over n_shards rows
    loads = loads.select("*", F.sum("own").over(every).alias("total"), F.row_number().over(W.orderBy(F.desc("own"), "home")).alias("nth"))
    loads = loads.select("home", "own", (F.floor(F.col("total") / n_shards) + F.when(F.col("nth") <= F.col("total") % n_shards, 1).otherwise(0)).cast("long").alias("cap"))

    before = W.partitionBy("home").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    at = at.join(F.broadcast(loads), "home").select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    over = F.greatest(F.lit(0), F.least("n", F.col("offset") + F.col("n") - F.col("cap"))).cast("long")
    at = at.select("pos", "home", "node", "n", "offset", over.alias("over"))
    at = at.select("*", F.coalesce(F.sum("over").over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begun"))
    # fixed in size: SLOTS positions and n_shards loads, in one row
    at = at.groupBy().agg(F.sort_array(F.collect_list(F.struct("pos", "home", "over", "n", "offset", "begun", "node"))).alias("at"))
    caps = loads.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("home", "own", "cap"))), lambda x: F.struct(x["cap"].alias("cap"), F.greatest(F.lit(0).cast("long"), x["cap"] - x["own"]).alias("room"))).alias("caps"))
    whole = at.withColumn("one", F.lit(1)).join(caps.withColumn("one", F.lit(1)), "one")
    whole = whole.select("at", "caps", _walk("at", F.transform("caps", lambda x: x["room"])).alias("moves"))
    parts = F.transform(
        "at",
        lambda p: F.struct(
            p["pos"].alias("pos"), p["home"].alias("home"), p["offset"].alias("offset"), (p["n"] - p["over"]).alias("stay"), p["begun"].alias("begun"),
            F.when(p["over"] == 0, F.expr("cast(array() as array<struct<shard:int,start:bigint,take:bigint,at:bigint>>)")).otherwise(
                F.transform(
                    F.filter("moves", lambda m: (m["start"] < p["begun"] + p["over"]) & (m["start"] + m["take"] > p["begun"])),
                    lambda m: F.struct(m["shard"].alias("shard"), m["start"].alias("start"), m["take"].alias("take"), (F.get("caps", m["shard"])["cap"] - m["left"]).alias("at")),
                )
            ).alias("moves"),
        ),
    )
    plan = whole.select(F.explode(parts).alias("p")).select("p.*")

    ranked = keys.select("*", (F.row_number().over(W.partitionBy("pos").orderBy("h", "id", "crc", "size")) - 1).cast("long").alias("nth"))
    queue = F.col("begun") + F.col("nth") - F.col("stay")
    move = F.get(F.filter("moves", lambda m: (m["start"] <= queue) & (queue < m["start"] + m["take"])), F.lit(0))
    stays = F.col("nth") < F.col("stay")
    return ranked.join(F.broadcast(plan), "pos").select(  # the plan has SLOTS rows
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.when(stays, F.col("home")).otherwise(move["shard"]).alias("shard"),
        F.when(stays, F.col("offset") + F.col("nth")).otherwise(move["at"] + queue - move["start"]).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
