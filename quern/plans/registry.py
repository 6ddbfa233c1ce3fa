"""A registry of named indexes, and query variants that can be added to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import catalogue as files

Builder = Callable[[DataFrame], DataFrame]


@dataclass
class Indexes:
    """Indexes by name: each is built from its source when it is missing or stale, and read otherwise."""

    spark: SparkSession
    folder: str
    builders: dict[str, Builder] = field(default_factory=dict)

    def register(self, name: str, build: Builder) -> None:
        if name in self.builders:
            raise ValueError(f"there is an index {name}")
        self.builders[name] = build

    def open(self, name: str, source: DataFrame, readonly: bool = False) -> DataFrame:
        return files.open_or_build(self.spark, f"{self.folder}/{name}", source, self.builders[name], readonly)


@dataclass
class Waterfall:
    """Query variants in order: each gives (doc_id, score) for an index and a query.  The documents of the first variant
    that has any are the answer; all variants are one job.  A subclass or a caller adds variants of its own."""

    variants: list[Callable[[DataFrame, object], DataFrame]] = field(default_factory=list)

    def added(self, variant: Callable[[DataFrame, object], DataFrame], at: int | None = None) -> Waterfall:
        rest = list(self.variants)
        rest.insert(len(rest) if at is None else at, variant)
        return type(self)(rest)

    def find(self, index: DataFrame, query: object) -> DataFrame:
        """(doc_id, score, variant)."""
        each = [v(index, query).select("doc_id", F.col("score").cast("double").alias("score"), F.lit(k).alias("variant")) for k, v in enumerate(self.variants)]
        every = reduce(DataFrame.unionByName, each)
        best = every.agg(F.min("variant").alias("_best"))  # one row
        return every.join(F.broadcast(best), F.col("variant") == F.col("_best")).drop("_best")
