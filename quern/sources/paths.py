"""Where intermediate files go, and how workers find the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset, a folder of our own if all runs on this machine, as in
    tests; on a cluster, whose machines have no folder in common that we know of, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors and the driver share."""
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: what cuts the lineage of loops."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A stored table's rows over all cores, where its files give fewer splits than there are cores (one small file)."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Adds row numbers from 1 in the given order, without a task that sees all rows: ranges are numbered apart, and
    only their sizes meet in one place."""
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(starts, "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless they find it where the driver does."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in (os.path.realpath(os.getcwd()), *map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))):
        return
    context = spark.sparkContext
    if not getattr(context, "_quern_shipped", False):
        target = Path(tempfile.mkdtemp()) / "quern.zip"  # on the driver; Spark hands it out
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted((root / "quern").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(target))
        context._quern_shipped = True
