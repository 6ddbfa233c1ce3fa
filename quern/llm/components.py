"""Connected components of a link table, by alternating large-star and small-star steps on written tables.

Both steps only ever take a minimum per node, which Spark combines on the map side, and join it back to the links; a
node with very many links is a skewed join key, which adaptive execution splits.  No neighbour list is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Shelf

MAX_ROUNDS = 60
ROWS_A_FILE = 100_000


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(a, b) links of any one orderable type to (node, root): root is the least node of the component.  Nodes
    without links do not appear.  Repeated links and links to itself do no harm; an empty table gives an empty one."""
    edges = shelf.put(_ordered(links.select("a", "b")), "links")
    seen = _checksum(edges)

    def put(df: DataFrame, label: str) -> DataFrame:
        return shelf.put(df.coalesce(1 + seen[0] // ROWS_A_FILE), label)  # a few links make no swarm of small files

    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = put(_ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))), "large")
        lower = put(large.groupBy("b").agg(F.min("a").alias("m")), "lower")
        met = large.join(lower, "b")
        small = put(_ordered(met.select("a", F.col("m").alias("b")).unionByName(lower.select(F.col("b").alias("a"), F.col("m").alias("b")))), "small")
        shelf.drop(edges, least, large, lower)
        edges, now = small, _checksum(small)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("root")))
    return put(roots.groupBy("node").agg(F.min("root").alias("root")), "roots")


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
