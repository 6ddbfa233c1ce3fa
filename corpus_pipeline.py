"""A corpus pipeline of five operators, each stage working on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``docs``; the last adds ``shard`` and ``slot`` (in
place of input columns of these names).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, mixing, sharding, simhash, toxicity
from quern.llm.common import spread, table
from quern.sources.paths import shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of least id."""
    return simhash.one_of_each(docs).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as came in, dealt out to the sources by weight; a document comes up to twice."""
    return mixing.mix(docs, share=1.0, carry=True).select("row", F.explode(F.sequence(F.lit(0), F.col("copies"))).alias("n")).where("n > 0").select("row.*")


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard of 16 and their place in it."""
    kept = [f"row.`{c}`" for c in docs.columns if c not in ("shard", "slot")]
    return sharding.shard(docs, shards=16, carry=True).select(*kept, "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]
#: The classifier and the fingerprints have no SQL form; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written as Parquet and read again."""
    docs = spread(table(spark, sf_dir, "documents"))
    folder = shared_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
