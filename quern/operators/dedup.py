"""Batch dedup, upserts and layered overrides: the windows the catalogue needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.paths import numbered


def first_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a blank key, which would be one hot group, all pass beside the window."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    w = Window.partitionBy(key).orderBy(*order)
    first = df.where(~blank).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.unionByName(df.where(blank))


def last_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Upsert: the last row of each key."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def request_fingerprint(method: Column, url: Column, body: Column | None = None) -> Column:
    """SHA-1 of the method, the canonical URL with its fragment, and the body."""
    return F.sha1(F.concat_ws("\n", F.upper(method), canonical_url(url), F.coalesce(body, F.lit("")) if body is not None else F.lit("")))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, sorted query arguments, fragment kept."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(head, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), ordered)).otherwise(""), fragment)


def changes(before: Column, after: Column) -> Column:
    """(added, removed) of two sets."""
    return F.struct(F.array_sort(F.array_except(after, before)).alias("added"), F.array_sort(F.array_except(before, after)).alias("removed"))


def not_returned(rows: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    return rows.join(returned.select(key), key, "left_anti")


def group_limit(df: DataFrame, n: int, score: str, group: Column | None = None, alphabetical: str | None = None) -> DataFrame:
    """Rows of the first n distinct scores, with all ties.  With ``alphabetical`` groups are the values of that column
    in the order of the alphabet, and ties are by score."""
    by = F.col(alphabetical) if alphabetical else F.col(score).desc()
    if group is None:  # the n-th best of all is a bound that every task can look up
        kept = df.select(F.col(alphabetical or score).alias("_by")).distinct().orderBy(F.col("_by") if alphabetical else F.col("_by").desc()).limit(n)
        ranks = kept.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_by") if alphabetical else F.col("_by").desc())))
        return df.join(F.broadcast(ranks), F.col(alphabetical or score) == F.col("_by")).drop("_by")  # n rows
    w = Window.partitionBy(group).orderBy(by)
    return df.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= n)


def in_chunks(df: DataFrame, order: list[Column], size: int = 10, group: Column | None = None) -> DataFrame:
    """Rows numbered into pages of ``size``, within each group or over all."""
    if group is None:
        return numbered(df, "_n", *order).withColumn("page", F.floor((F.col("_n") - 1) / size)).drop("_n")
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("page", F.floor((F.row_number().over(w) - 1) / size))
