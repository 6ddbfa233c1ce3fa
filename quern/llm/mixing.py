"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each document gets an expected number of copies e = min(most, c * weight), where c is solved per source so that the
expected words meet the source's target.  floor(e) copies are certain.  For the rest, p = e - floor(e) is the
inclusion probability, and documents are ranked by the Pareto ranking variable: the random odds u / (1 - u) over the
inclusion odds p / (1 - p).  The documents of least rank are taken until the words that the source still lacks are
met; the sample's size is fixed in words, to within half of the one document at the edge.

Nothing is ranked globally.  The ranking variable is cut in BUCKETS; sums per (source, bucket) show which buckets are
taken whole, and only the documents of the one bucket at the edge, about one in BUCKETS, are ordered.

Edge cases: a null or empty text has size 0 and counts as a document of its source; a null source is a source of its
own, after all others; an empty table gives an empty result; repeated rows are documents of their own, and rows alike
in id, size and text are interchangeable; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Shelf, join_small, packed, sums_before

BUCKETS = 4096
#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the given columns alone."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(key, source_size) to (key, source_size, target): ``share`` of all words, dealt out by weight; a target stops
    at ``most`` times its source, and the excess goes to the others by weight (found by filling sources in the order
    of room per weight)."""
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("key").asc_nulls_last())) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")).cast("double")
    )
    cap = F.col("source_size") * F.lit(float(most))
    fill = Window.orderBy("per_weight", "nth")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("cap", cap).withColumn("per_weight", F.col("cap") / F.col("weight")).withColumn("level", level)
    # the level to which the open sources fill: that of the first source it doesn't reach
    open_level = F.min(F.when(F.col("level") < F.col("per_weight"), F.struct("per_weight", "nth", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    return filled.select("key", "source_size", F.coalesce(F.least(F.col("cap"), open_level * F.col("weight")), F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: int = 2,
    short_words: int = 32,
    short_weight: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """Decide how many copies of each document the mix takes.

    Texts of fewer than ``short_words`` words weigh ``short_weight`` against 1 for the others, which makes the
    inclusion probabilities unequal within a source.  Returns ``id, size, source_size, target, copies, taken``;
    with ``carry`` the input row comes first, as struct ``row``.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "mix")
    rows = docs.select(
        *([packed(docs)] if carry else []),
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"),
        *([F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie")] if carry else []),
    )
    rows = rows.withColumn("weight", F.when(F.col("size") < short_words, F.lit(float(short_weight))).otherwise(F.lit(1.0)))
    rows = rows.withColumn("u", unit(F.col("id"), F.col("size"))).withColumn("key", _key(F.col("source")))
    if not carry:
        rows = shelf.put(rows.drop("source"), "sizes")  # narrow: the texts are read once

    classes = shelf.put(rows.groupBy("key", "weight").agg(F.sum("size").alias("words")), "classes")
    aims = targets(classes.groupBy("key").agg(F.sum("words").alias("source_size")), share, most)
    plan = shelf.put(_rates(classes, aims, most), "rates")

    with_plan = join_small(rows, plan, "key")
    e = F.least(F.lit(float(most)), F.col("rate") * F.col("weight"))
    p = F.col("e") - F.col("certain")
    scored = (
        with_plan.withColumn("e", e)
        .withColumn("certain", F.floor("e"))
        .withColumn("q", F.when(p > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - p) / p)))
        .withColumn("bucket", F.floor(F.lit(float(BUCKETS)) * (F.col("q") / (1 + F.col("q")))))
    )
    sums = shelf.put(scored.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("given"), F.max("target").alias("target")), "buckets")
    lacks = sums.groupBy("key").agg((F.max("target") - F.sum("given")).alias("lack"))
    ends = sums_before(sums.where("bucket IS NOT NULL"), "key", "bucket", "words", "start").withColumn("end", F.col("start") + F.col("words"))
    edges = (
        ends.join(lacks, "key")
        .groupBy("key")
        .agg(
            F.max("lack").alias("lack"),
            F.coalesce(F.max(F.when(F.col("end") <= F.col("lack"), F.col("bucket"))), F.lit(-1)).alias("whole"),
            F.coalesce(F.max(F.when(F.col("end") <= F.col("lack"), F.col("end"))), F.lit(0)).alias("so_far"),
            F.min(F.when(F.col("end") > F.col("lack"), F.col("bucket"))).alias("edge"),
        )
    )
    edges = shelf.put(edges, "edges")
    judged = join_small(scored, edges, "key", "left")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    clear = judged.where(~at_edge).withColumn("more", F.coalesce(F.col("bucket") <= F.col("whole"), F.lit(False)))
    ties = ["tie"] if carry else []
    order = Window.partitionBy("key").orderBy("q", F.col("id").asc_nulls_last(), "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("so_far") + F.sum("size").over(order) - F.col("size")
    edge = judged.where(at_edge).withColumn("more", before + F.col("size") / 2 <= F.col("lack"))
    copies = (F.col("certain") + F.col("more").cast("int")).cast("int")
    return clear.unionByName(edge).select(
        *(["row"] if carry else []), "id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def _key(source: Column) -> Column:
    """A join key without nulls that sorts like the source, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _rates(classes: DataFrame, aims: DataFrame, most: int) -> DataFrame:
    """(key, source_size, target, rate): rate * weight copies are expected of a document, ``most`` at most.  The
    classes of largest weight reach the bound first; the rest share what they leave."""
    by_weight = Window.partitionBy("key").orderBy(F.col("weight").desc())
    bound = F.coalesce(F.sum("words").over(by_weight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(most)
    free = F.sum(F.col("weight") * F.col("words")).over(by_weight.rowsBetween(0, Window.unboundedFollowing))
    tried = classes.join(aims, "key").withColumn("rate", F.when(free > 0, (F.col("target") - bound) / free).otherwise(F.lit(0.0)))
    fits = F.col("rate") * F.col("weight") <= float(most)
    return tried.groupBy("key").agg(
        F.max("source_size").alias("source_size"),
        F.max("target").alias("target"),
        F.coalesce(F.max_by("rate", F.when(fits, F.col("weight"))), F.max(F.lit(float(most)) / F.col("weight"))).alias("rate"),
    )
