"""Catalogue reports: histograms, bags, coverage, evaluation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Counts of the ' + '-separated values of an attribute; the empty text is a value."""
    return df.select(F.explode(F.split(F.coalesce(value, F.lit("")), r" \+ ")).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def bag(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(f"{value}s"))


def unbranded(df: DataFrame, brand: str = "brand", detected: str = "brand_detected") -> DataFrame:
    """Per brand the products whose name did not show it, and all of them."""
    return df.groupBy(brand).agg(F.sum((~F.col(detected)).cast("long")).alias("n_unbranded"), F.count("*").alias("n")).orderBy(F.desc("n_unbranded"), brand)


def makers(df: DataFrame, maker: str = "manufacturer", brand: str = "brand") -> DataFrame:
    return df.groupBy(maker).agg(F.array_sort(F.collect_set(brand)).alias("brands"))


def linked_makers(brands: DataFrame) -> DataFrame:
    """Registered brands (key, name, no_brand, manufacturers) to (manufacturer, brand, other): the makers that a maker's
    brands link it to."""
    owned = brands.where("NOT no_brand").select("name", F.explode("manufacturers").alias("manufacturer")).distinct()
    others = owned.select(F.col("name").alias("brand"), F.col("manufacturer").alias("other"))
    return owned.withColumnRenamed("name", "brand").join(others, "brand").where("manufacturer <> other").select("manufacturer", "brand", "other")


def coverage(products: DataFrame, types: DataFrame, sqn: str = "sqn") -> DataFrame:
    """Types by capacity, and the share of short names that types of at least that capacity cover."""
    pairs = products.select(F.col(sqn).alias("sqn"), F.explode_outer("types").alias("type_key")).join(types.select("type_key", "capacity"), "type_key", "left")
    best = pairs.groupBy("sqn").agg(F.coalesce(F.max("capacity"), F.lit(0)).alias("best"))
    steps = types.groupBy("capacity").agg(F.count("*").alias("n_types"))
    total = best.agg(F.count("*").alias("total"))
    reached = best.groupBy("best").agg(F.count("*").alias("names"))
    met = steps.join(reached, reached["best"] >= steps["capacity"], "left").groupBy("capacity", "n_types").agg(F.coalesce(F.sum("names"), F.lit(0)).alias("covered"))
    return met.crossJoin(F.broadcast(total)).select("capacity", "n_types", "covered", F.round(100 * F.col("covered") / F.col("total"), 2).alias("percent"))


def lemma_statistics(df: DataFrame) -> DataFrame:
    """(word, lemma, tag) to lemma -> {word: tag}."""
    return df.groupBy("lemma").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("word", "tag")))).alias("words"))


def prefix_candidates(vocabulary: DataFrame, least: int = 3, spare: int = 1) -> DataFrame:
    """(word, lemma) to words whose longer forms share one main form, but for ``spare`` of them."""
    prefixes = vocabulary.select("word", "lemma").withColumn("short", F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length("word") - 1)), lambda n: F.substring("word", F.lit(1), n))))
    longer = prefixes.where(F.length("word") > F.length("short")).join(vocabulary.select(F.col("word").alias("short")), "short", "left_semi")
    forms = longer.groupBy("short", "lemma").agg(F.count("*").alias("n"))
    return forms.groupBy("short").agg(F.max_by("lemma", F.struct("n", "lemma")).alias("lemma"), F.sum("n").alias("n"), F.max("n").alias("agree")).where(F.col("n") - F.col("agree") <= spare)


def context_log(df: DataFrame) -> DataFrame:
    return df.groupBy("term").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("context")))).alias("context"))


def enrichment(products: DataFrame) -> DataFrame:
    """Products, those with a type, and those with a type of several terms."""
    several = F.exists("types", lambda t: F.contains(t, F.lit(" + ")))
    return products.agg(F.count("*").alias("n"), F.count_if(F.size("types") > 0).alias("n_typed"), F.count_if(several).alias("n_compound"))


def failures(df: DataFrame, key: str = "brand", ok: str = "ok") -> DataFrame:
    return df.groupBy(key).agg(F.sum((~F.col(ok)).cast("long")).alias("n_failed"), F.count("*").alias("n")).where("n_failed > 0").orderBy(F.desc("n_failed"), key)


def dictionary_size(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count("*").alias("n_terms"), (F.coalesce(F.max("term_id"), F.lit(0)) + 1).alias("next_id"))


def names_that_are_types(names: DataFrame, types: DataFrame) -> DataFrame:
    """Brand names whose words, in any order, are a product type."""
    key = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("name"), r"\s+"))), " + ")
    return names.withColumn("type_key", key).join(types.select("type_key").distinct(), "type_key", "left_semi")


def sqn_tails(products: DataFrame, types: DataFrame, least: int = 3, sqn: str = "sqn") -> DataFrame:
    """What is left of short names when the longest type in them, as whole words in order, is taken out."""
    longest = types.agg(F.max(F.size(F.split("type_text", " ")))).first()[0] or 1
    words = products.select(F.col(sqn).alias("sqn"), F.split(sqn, " ").alias("w"))
    starts = words.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("i") + 1))))
    phrases = starts.withColumn("type_text", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ")).join(types.select("type_text").distinct(), "type_text", "left_semi")
    best = phrases.groupBy("sqn", "w").agg(F.max(F.struct(F.col("n"), (-F.col("i")).alias("at"))).alias("m"))
    at, n = -F.col("m.at"), F.col("m.n")
    left = F.array_join(F.concat(F.slice("w", F.lit(1), at - 1), F.slice("w", at + n, F.size("w"))), " ")
    return best.select(left.alias("tail")).where("tail <> ''").groupBy("tail").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "tail")
