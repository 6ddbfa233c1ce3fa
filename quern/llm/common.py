"""Helpers that the training-data operators share.

Conventions that hold for every operator of this subpackage:

* A null text counts as an empty text, a null id as an id of its own that sorts last.
* Operators read only the columns they are told of.  An operator that hands input rows on packs each row in one
  struct column first, so that extra columns, whatever their names, never meet the operator's own columns.
* Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir`` and are Parquet: a lost
  executor costs a re-read, never a re-run of the steps before.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.paths import shared_path, ship

#: Rows of a table that may be broadcast; beyond it, callers take a salted join.
BROADCAST_ROWS = 100_000
#: Rows of an Arrow batch: bounds what a Python worker holds when texts are long.
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A stored table's rows over all cores, where its files give fewer splits than there are cores (one small file)."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def prepare(spark: SparkSession) -> None:
    """What the Python stages rely on: the package at the workers, and small Arrow batches."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def _dropping_shuffles(spark: SparkSession):
    """Shuffle files of a query that ends in a written table are of no use after it: have Spark remove them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Shelf:
    """Written intermediate tables of one operator call, under one folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_path(spark, name)
        self._n = 0

    def put(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and return the table read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        with _dropping_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing lazy reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._quern_path)
            path.getFileSystem(conf).delete(path, True)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of a row as one struct, by position, so that even repeated column names survive."""
    return F.struct("*").alias(name)


def join_small(left: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join a hot side with a written table: broadcast after counting it, or salted on both sides beyond the bound."""
    if small.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), on, how)
    salts = 64
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int")).join(many, [on, "_salt"], how).drop("_salt")


def sums_before(df: DataFrame, key: str, at: str, value: str, name: str, span: int = 64) -> DataFrame:
    """Adds the sum of ``value`` over a key's rows of smaller ``at`` (whole numbers, one row each), in two levels: within
    stretches of ``span``, and over the stretches.  So no task needs all rows of a key."""
    cut = df.withColumn("_stretch", F.floor(F.col(at) / span))
    whole = cut.groupBy(key, "_stretch").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = whole.select(key, "_stretch", F.coalesce(earlier, F.lit(0)).alias("_start"))
    inner = F.sum(value).over(Window.partitionBy(key, "_stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(starts, [key, "_stretch"]).withColumn(name, F.col("_start") + F.col("_inner")).drop("_stretch", "_start", "_inner")


def bits_of_power(n: int) -> int:
    """The least k with 2**k >= n."""
    return max(0, (max(1, int(n)) - 1).bit_length())
