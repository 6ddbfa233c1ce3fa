"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, fuzzy, lines, mixing, ngram_lm, pii, sharding, simhash, substrings, toxicity
from quern.llm.common import spread, table
from quern.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharding.shard(docs, shards=16).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.mix(docs, share=1.5, most=2).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.score(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_seen", F.round("log2_score", 4).alias("log2_score"))


def op6_shape_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("row.doc_id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.with_next(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumnRenamed("id", "doc_id")


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = simhash.near_duplicates(docs, words=3, bits=64, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return substrings.dedup(docs, width=20).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_edit_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), most=2, chars_per_edit=6)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ring_shards, op2_weak_toxicity, op3_decontaminate, op4_pareto_mix, op5_stupid_backoff, op6_shape_field_pii, op7_piecewise_fingerprints, op8_simhash_tiles, op9_substring_dedup, op10_edit_join_lines)}
