"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns ``vnodes`` points of a 64-bit ring; a key belongs to the first point clockwise of its hash.  A shard
holds at most its capacity; what a shard cannot hold continues clockwise, past full shards, to the next point of a
shard with room.  The keys of a shard fill it in ring order before movers are taken in, so the keys that move on are the
last ones, and the keys that a shard can hold never move, which keeps movement to the least the bound allows.

The walk clockwise is a queue on a circle: movers join it at their point, in order, and each point takes from its
front what its shard still has room for.  Two laps place all of them: after the first no point adds any, and a whole lap
passes every shard.  The walk folds over the points of the ring in one expression; their number is a parameter and not a
property of the data.  A fold step costs a copy of the ``shards`` rooms only where keys are taken in.  Rows are ranked
inside (point, salt) cells, where the salt is a hash of the id, so that one hot key is ranked by as many tasks as there
are salts.

Edge cases: a null key or text hashes as the empty text with size 1 (its null-ness stays in the row); repeated rows
are separate keys that share a ring position; an empty table gives an empty result; ties in (hash, id) are rows
that are equal in everything the ring reads, so that their order does not show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Shelf, packed, sums_before

SALTS = 4096
CHUNK_SHIFT = 52


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(v, shard, pos): the points in ring order.  A point's place depends on (shard, copy) only."""
    points = (
        spark.range(shards * vnodes, numPartitions=1)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("copy"))
        .withColumn("pos", F.xxhash64(F.lit("ring"), "shard", "copy"))
    )
    order = Window.orderBy("pos", "shard", "copy")
    return points.select((F.row_number().over(order) - 1).alias("v"), "shard", "pos")


def _arcs(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(chunk, lo, hi, v): the arc that each point takes, cut at multiples of 2**CHUNK_SHIFT for an equi-join."""
    points = ring(spark, shards, vnodes)
    before = F.lag("pos").over(Window.orderBy("v"))
    least, most = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    arcs = points.select("v", F.coalesce(before + 1, least).alias("lo"), F.col("pos").alias("hi"))
    wrap = points.agg(F.max("pos").alias("p")).select(F.lit(0).alias("v"), (F.col("p") + 1).alias("lo"), most.alias("hi"))
    return (
        arcs.unionByName(wrap)
        .where("lo <= hi")
        .select("v", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CHUNK_SHIFT), F.shiftright("hi", CHUNK_SHIFT))).alias("chunk"))
    )


def shard(
    docs: DataFrame,
    shards: int = 16,
    vnodes: int = 256,
    slack: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Put every row into one of ``shards`` shards.

    The key is the text, so that equal texts lie together wherever the bound lets them.  ``slack`` is the part by
    which a capacity may exceed the mean; at 0 the counts of two shards differ by one at most (law ``rows``).

    Returns ``id, size, text_crc32, shard, slot`` (slots are gapless from 0 in each shard); with ``carry`` the
    input row comes first, as struct ``row``.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "shard")
    n_points = shards * vnodes

    rows = docs.select(
        *([packed(docs)] if carry else []),
        F.col(id_col).alias("id"),
        text_size(F.col(text_col)).alias("size"),
        text_crc32(F.col(text_col)).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"),
    ).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    if not carry:
        rows = shelf.put(rows, "keys")  # narrow: the texts are read once
    # at most 2 * n_points + 2**(64 - CHUNK_SHIFT) rows, by the parameters alone
    arcs = F.broadcast(_arcs(spark, shards, vnodes))

    def placed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("chunk", F.shiftright("hash", CHUNK_SHIFT)).join(arcs, "chunk").where("hash >= lo AND hash <= hi").drop("lo", "hi", "chunk")

    cells = shelf.put(placed(rows.select("hash", "salt")).groupBy("v", "salt").agg(F.count("*").alias("n")), "cells")
    plan = _plan(ring(spark, shards, vnodes), cells, shards, slack)

    offsets = sums_before(cells, "v", "salt", "n", "offset").select("v", "salt", "offset")
    ranked = (
        placed(rows)
        .join(offsets, ["v", "salt"])
        .withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("v", "salt").orderBy("hash", F.col("id").asc_nulls_last())) - 1)
        .drop("offset", "salt", "hash")
    )

    home = F.broadcast(plan.select("v", F.col("shard").alias("home"), "first", "keep", "movers_before", "movers"))
    width = F.greatest(F.lit(1), F.ceil(2 * F.col("movers") / n_points))
    moved = (
        ranked.join(home, "v")
        .withColumn("u", F.when(F.col("rank") >= F.col("keep"), F.col("movers_before") + F.col("rank") - F.col("keep")))
        .withColumn("stretch", F.floor(F.col("u") / width))
    )
    # what each point takes in, cut at multiples of the width: at most 3 * n_points rows
    served = F.broadcast(
        _walk(plan, n_points).select(
            F.col("shard").alias("to"),
            "served_from",
            "served",
            "slot_from",
            F.explode(F.sequence(F.floor(F.col("served_from") / width), F.floor((F.col("served") - 1) / width))).alias("stretch_to"),
        )
    )
    near = (F.col("stretch") == F.col("stretch_to")) & (F.col("u") >= F.col("served_from")) & (F.col("u") < F.col("served"))
    return moved.join(served, near, "left").select(
        *(["row"] if carry else []),
        "id",
        "size",
        "text_crc32",
        F.coalesce(F.col("to"), F.col("home")).cast("int").alias("shard"),
        F.when(F.col("u").isNull(), F.col("first") + F.col("rank")).otherwise(F.col("slot_from") + F.col("u") - F.col("served_from")).cast("long").alias("slot"),
    )


def _plan(points: DataFrame, cells: DataFrame, shards: int, slack: float) -> DataFrame:
    """The points of the ring: what each keeps, what moves on, and the room of its shard."""
    loads = points.join(F.broadcast(cells.groupBy("v").agg(F.sum("n").alias("n"))), "v", "left").select("v", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    whole = Window.partitionBy("shard")
    to_here = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    ring_order = everything.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    total = F.greatest(F.sum("n").over(everything), F.floor(F.sum("n").over(everything) * (1 + slack))).cast("long")
    return (
        loads.withColumn("first", F.sum("n").over(to_here) - F.col("n"))
        .withColumn("load", F.sum("n").over(whole))
        .withColumn("capacity", _idiv(total * (F.col("shard") + 1), shards) - _idiv(total * F.col("shard"), shards))
        .withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("capacity") - F.col("first"))))
        .withColumn("out", F.col("n") - F.col("keep"))
        .withColumn("held", F.least("load", "capacity"))
        .withColumn("room", F.col("capacity") - F.col("held"))
        .withColumn("movers_before", F.sum("out").over(ring_order) - F.col("out"))
        .withColumn("movers", F.sum("out").over(everything))
    )


def _walk(plan: DataFrame, n_points: int) -> DataFrame:
    """(shard, served_from, served, slot_from, movers): the movers, numbered in ring order, that a point takes in."""
    point = F.struct("v", "shard", "out", "held")
    laid = plan.agg(
        F.array_sort(F.collect_list(point)).alias("ring"),
        F.transform(F.array_sort(F.collect_set(F.struct("shard", "room"))), lambda x: x["room"]).alias("rooms"),
        F.max("movers").alias("movers"),
    )
    laps = F.concat("ring", F.transform("ring", lambda p: p.withField("out", F.lit(0).cast("long"))))
    size = max(1, int((2 * n_points) ** 0.5))  # a fold within a fold, so that no step copies all that was taken before
    runs = F.transform(F.sequence(F.lit(1), F.lit(2 * n_points), F.lit(size)), lambda at: F.slice("laps", at, F.lit(size)))

    def start(queue: Column, rooms: Column, kind: str) -> Column:
        return F.struct(queue.alias("queue"), rooms.alias("rooms"), F.array().cast(kind).alias("taken"))

    def step(state: Column, p: Column) -> Column:
        waiting = state["queue"] + p["out"]
        taken = F.least(waiting, F.get(state["rooms"], p["shard"]))
        rooms = F.when(taken > 0, F.transform(state["rooms"], lambda r, s: F.when(s == p["shard"], r - taken).otherwise(r))).otherwise(state["rooms"])
        return F.struct((waiting - taken).alias("queue"), rooms.alias("rooms"), F.concat(state["taken"], F.array(taken)).alias("taken"))

    def run(state: Column, points: Column) -> Column:
        done = F.aggregate(points, start(state["queue"], state["rooms"], "array<bigint>"), step)
        return F.transform(F.array(done), lambda d: F.struct(d["queue"].alias("queue"), d["rooms"].alias("rooms"), F.concat(state["taken"], F.array(d["taken"])).alias("taken")))[0]

    walked = laid.withColumn("laps", laps).select("laps", "movers", F.flatten(F.aggregate(runs, start(F.lit(0).cast("long"), F.col("rooms"), "array<array<bigint>>"), run)["taken"]).alias("taken"))
    steps = walked.select("movers", F.posexplode(F.arrays_zip("laps", "taken")).alias("at", "s")).select("movers", "at", "s.laps.shard", "s.laps.held", "s.taken")
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    in_shard = Window.partitionBy("shard").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        steps.withColumn("served", F.sum("taken").over(before))
        .withColumn("served_from", F.col("served") - F.col("taken"))
        .withColumn("slot_from", F.col("held") + F.sum("taken").over(in_shard) - F.col("taken"))
        .where("taken > 0")
    )


def _idiv(amount: Column, parts: int) -> Column:
    return F.floor((amount - F.pmod(amount, F.lit(parts))) / parts).cast("long")
