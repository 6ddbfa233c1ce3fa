"""Category trees: closure, roots, membership, tagging, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import checked
from quern.sources.paths import stored

ROOT_ID = "-1"


def closure(tree: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, ancestor, depth) with depth 0 for the category itself.

    The paths to ancestors double in length a round, so a tree of depth d takes log2(d) joins.  Trees may be of any
    depth; paths longer than there are categories are a cycle, which raises."""
    links = tree.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    paths = links.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(
        links.join(links.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    )
    reach, most = 1, None
    while True:
        onward = paths.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        longer = paths.where(F.col("depth") == reach).join(onward.where("more > 0"), "ancestor").select("id", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        if longer.isEmpty():
            break
        paths = paths.unionByName(longer)
        reach *= 2
        if reach > 2:  # a deep tree: each round on what was written
            most = links.count() if most is None else most
            if reach > 2 * most:
                raise ValueError("category cycle")
            paths = stored(paths, "closure")
    looped = (F.col("depth") > 0) & (F.col("id") == F.col("ancestor"))
    return checked(paths, "depth", looped, "category cycle")


def roots(tree: DataFrame, root: str | int = ROOT_ID, parent_col: str = "parent_id", order: str = "id") -> DataFrame:
    return tree.where(F.col(parent_col) == root).orderBy(order)


def members(tree: DataFrame, id_col: str = "id", products_col: str = "products") -> DataFrame:
    """Bridge table (category, product)."""
    return tree.select(F.col(id_col).alias("category"), F.explode(products_col).alias("product")).distinct()


def under(bridge: DataFrame, paths: DataFrame, deep: bool = True) -> DataFrame:
    """(product, category): the product's own categories, and with ``deep`` their ancestors."""
    own = paths if deep else paths.where("depth = 0")
    return bridge.join(own, bridge["category"] == own["id"]).select("product", F.col("ancestor").alias("category")).distinct()


def accept_ignore(products: DataFrame, categories: DataFrame, accept: list | None = None, ignore: list | None = None, key: str = "product") -> DataFrame:
    """Products of an accepted category (all, if none is named) that have no ignored one."""
    out = products
    if accept:
        out = out.join(categories.where(F.col("category").isin(accept)).select(key), key, "left_semi")
    if ignore:
        out = out.join(categories.where(F.col("category").isin(ignore)).select(key), key, "left_anti")
    return out


def tags(categories: DataFrame, titles: DataFrame, accept: list | None = None, ignore: list | None = None) -> DataFrame:
    """(product, tags): titles of the product's categories that pass."""
    kept = categories.where(F.col("category").isin(accept)) if accept else categories
    kept = kept.where(~F.col("category").isin(ignore)) if ignore else kept
    return kept.join(titles, kept["category"] == titles["id"]).groupBy("product").agg(F.array_sort(F.collect_set("title")).alias("tags"))


def by_title(tree: DataFrame, title: str) -> DataFrame:
    """The category of a title, whatever its case; more than one raises."""
    found = tree.where(F.lower("title") == title.lower())
    several = found.withColumn("_n", F.count("*").over(Window.partitionBy(F.lower("title"))))
    return checked(several, "title", F.col("_n") > 1, "title is not unique").drop("_n")


def under_stopped(tree: DataFrame, paths: DataFrame, stopped: list[str]) -> DataFrame:
    """Categories in a subtree of one of the stopped titles."""
    tops = tree.where(F.lower("title").isin([s.lower() for s in stopped])).select(F.col("id").alias("ancestor"))
    return paths.join(tops, "ancestor", "left_semi").select("id").distinct()


def listing(tree: DataFrame, paths: DataFrame, title_col: str = "title") -> DataFrame:
    """Depth-first listing: (id, depth, line, n_below), in order of ``path``."""
    names = tree.select(F.col("id").alias("ancestor"), F.col(title_col).alias("name"))
    ways = paths.join(names, "ancestor").groupBy("id").agg(F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name"))).alias("way"))
    below = paths.where("depth > 0").groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_below"))
    path = F.array_join(F.transform("way", lambda x: x["name"]), " / ")
    return ways.join(below, "id", "left").select("id", "depth", path.alias("path"), F.concat(F.repeat(F.lit("  "), F.col("depth")), F.element_at("way", -1)["name"]).alias("line"), F.coalesce("n_below", F.lit(0)).alias("n_below"))
