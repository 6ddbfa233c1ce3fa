"""The batch catalogue build: raw products to extracted, branded, tagged and typed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import attributes
from quern.functions.terms import Terms, main_forms, type_tuples
from quern.functions.text import type_key
from quern.operators import brands, categories, relations
from quern.operators.dedup import last_wins
from quern.sources.paths import stored


def extracted(raw: DataFrame) -> DataFrame:
    """(id, name, brand, manufacturer) with attributes and the short name."""
    parts = attributes.legacy(F.col("name"))
    return raw.withColumn("p", parts).select("id", F.col("name").alias("pfqn"), "brand", "manufacturer", *[F.filter(F.split(f"p.{c}", r" \+ "), lambda x: x != "").alias(c) for c in ("weight", "fat", "pack")], "p.sqn")


def branded(products: DataFrame, registry: DataFrame) -> DataFrame:
    """The brand taken out of the short name: fuzzy spellings are learnt over all names first, then all are applied."""
    keyed = products.withColumn("key", brands.brand_key(F.coalesce("brand", F.lit(""))))
    spelled = brands.variants(registry)
    learnt = brands.fuzzy_tokens(keyed.select("id", "key", "sqn"), spelled)
    return brands.replaced(keyed, spelled, registry, learnt).drop("key", "met")


def without_makers(products: DataFrame, registry: DataFrame) -> DataFrame:
    """Of products with a manufacturer its spellings taken out of the short name, as if it were a brand; not where the
    manufacturer is the product's brand, which is out already."""
    named = products.where("manufacturer IS NOT NULL").withColumn("key", brands.brand_key(F.col("manufacturer")))
    makers = named.select(F.col("manufacturer").alias("maker")).distinct()
    same = brands.makers_brands(makers, registry).select(brands.brand_key(F.col("maker")).alias("key"), F.col("key").alias("brand_key"))
    other = named.withColumn("brand_key", brands.brand_key(F.coalesce("brand", F.lit("")))).join(same, ["key", "brand_key"], "left_anti").select("id", "key", "sqn")
    bare = makers.select(brands.brand_key(F.col("maker")).alias("key"), F.lit(None).cast("string").alias("generic")).distinct()
    return _replaced(products, brands.replaced(other, brands.maker_variants(makers), bare))


def without_unknown_makers(products: DataFrame, registry: DataFrame) -> DataFrame:
    """Of products without manufacturer and with a name that stands for no brand: the spellings of the no-brands' own
    manufacturers taken out of the short name."""
    none = registry.where("no_brand")
    makers = none.select(F.explode("manufacturers").alias("maker")).distinct()
    asked = products.where("manufacturer IS NULL").withColumn("key", brands.brand_key("brand")).join(none.select("key"), "key", "left_semi").select("id", "key", "sqn")
    met = brands.met_spellings(asked, brands.maker_variants(makers)).select("id", F.col("variant").alias("token"))
    learnt = asked.select("id", "key").join(met, "id")
    nothing = registry.select("key", F.lit(None).cast("string").alias("variant")).limit(0)
    found = asked.join(learnt.select("id").distinct(), "id", "left_semi")
    return _replaced(products, brands.replaced(found, nothing, none.select("key", "generic"), learnt))


def _replaced(products: DataFrame, done: DataFrame) -> DataFrame:
    """Products with the short names of ``done`` where a spelling was met there."""
    met = done.where("brand_detected").select("id", F.col("sqn").alias("_sqn"))
    return products.join(met, "id", "left").withColumns({"sqn": F.coalesce("_sqn", "sqn"), "brand_detected": F.col("brand_detected") | F.col("_sqn").isNotNull()}).drop("_sqn")


def guessed(products: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, brand, guess, sqn): for products whose brand was not detected the registered brands that the name may hold,
    and what it would be without.  A report only: nothing is changed."""
    left = products.where("NOT brand_detected").select("id", "brand", "sqn")
    sound = registry.where("NOT no_brand")
    met = brands.met_spellings(left, brands.variants(sound))
    learnt = met.select("id", "key", F.col("variant").alias("token"))
    asked = left.join(met.select("id", "key").distinct(), "id").select("id", "brand", "key", "sqn")
    nothing = registry.select("key", F.lit(None).cast("string").alias("variant")).limit(0)
    done = brands.replaced(asked, nothing, sound.select("key", "generic"), learnt).where("brand_detected")
    return done.join(sound.select("key", F.col("name").alias("guess")), "key").select("id", "brand", "guess", "sqn")


def tagged(products: DataFrame, tree: DataFrame, accept: list | None = None, ignore: list | None = None) -> DataFrame:
    paths = categories.closure(tree)
    under = categories.under(categories.members(tree), paths)
    kept = categories.accept_ignore(products.withColumnRenamed("id", "product"), under, accept, ignore)
    return kept.join(categories.tags(under, tree.select("id", "title"), None, ignore), "product", "left").withColumnRenamed("product", "id")


def typed(products: DataFrame, terms: Terms) -> DataFrame:
    """Adds ``types``: keys of the type tuples of the short name (with its first two words hyphenated if it has none)."""
    none = F.array().cast("array<string>")
    labels = F.transform(F.filter(F.coalesce("tags", none), lambda t: F.trim(t) != ""), lambda t: F.lower(F.trim(t)))
    joined = F.regexp_replace("sqn", "^(\\S+) ", "$1-")
    first = products.withColumn("_t", type_tuples(F.col("sqn"), labels, terms)).withColumn("_u", F.when(F.size("_t") > 0, F.col("_t")).otherwise(type_tuples(joined, labels, terms)))
    exploded = first.select("id", F.explode("_u").alias("one")).select("id", type_key(main_forms(F.col("one"), terms)).alias("type_key"), F.size("one").alias("arity")).distinct()
    keys = exploded.groupBy("id").agg(F.array_sort(F.collect_set("type_key")).alias("types"))
    return first.drop("_t", "_u").join(keys, "id", "left").withColumn("types", F.coalesce("types", none))


def graph(products: DataFrame) -> DataFrame:
    """Relations of all meaningful types of typed products, tags included."""
    bags = relations.bags(products).withColumn("forms", F.split("type_key", r" \+ ")).withColumn("arity", F.size("forms")).withColumn("flag", F.lit(False))
    types = relations.meaningful(bags)
    none = F.array().cast("array<string>")
    tag_rows = products.select(F.explode(F.coalesce("tags", none)).alias("tag"), "types", "sqn").select(F.concat(F.lit("#"), F.lower("tag")).alias("tag"), F.explode("types").alias("type_key"), "sqn").join(types.select("type_key"), "type_key", "left_semi")
    return relations.built(types, tag_rows)


def enriched(products: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds to each product's types those that are identical or equal to them."""
    same = relations.of_kinds(edges, "identical", "equals").select(F.col("a").alias("t"), "b")
    more = products.select("id", F.explode("types").alias("t")).join(same, "t").groupBy("id").agg(F.collect_set("b").alias("more"))
    return products.join(more, "id", "left").withColumn("types", F.array_sort(F.array_union("types", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")


def ingested(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by full name: a later product takes the place of an earlier one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, "pfqn", [F.col("_batch"), F.col("id")]).drop("_batch")


def build(raw: DataFrame, tree: DataFrame, registry: DataFrame, terms: Terms, accept: list | None = None, ignore: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, relations) of raw products, a category tree and a brand registry.  Each step joins products with what
    it found in them, so each is written before the next."""
    named = stored(branded(extracted(raw), registry), "branded")
    named = stored(without_makers(named, registry), "made")
    named = stored(without_unknown_makers(named, registry), "named")
    done = stored(typed(tagged(named, tree, accept, ignore), terms), "typed")
    edges = stored(graph(done), "edges")
    return enriched(done, edges), edges
