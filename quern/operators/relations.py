"""The graph of product types as edge tables (a, b, rel, soft, attr), always held in both directions.

``a`` and ``b`` are type keys (sorted distinct main forms).  ``contains`` means that a is the broader type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.similarity import type_similarity_udf
from quern.functions.text import checked
from quern.sources.paths import stored

INVERSE = {"contains": "subset_of", "subset_of": "contains"}
SIMILAR_FROM = 0.85
MIN_CAPACITY = 2
#: Forms of a type whose subsets are all listed.
MANY_FORMS = 8


def inverse(rel: Column) -> Column:
    return F.when(rel == "contains", "subset_of").when(rel == "subset_of", "contains").otherwise(rel)


def edge(df: DataFrame, a: str, b: str, rel: Column, soft: bool | Column = False, attr: Column | None = None) -> DataFrame:
    return df.select(F.col(a).alias("a"), F.col(b).alias("b"), rel.alias("rel"), (soft if isinstance(soft, Column) else F.lit(soft)).alias("soft"), (attr if attr is not None else F.lit(None)).cast("double").alias("attr"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), inverse(F.col("rel")).alias("rel"), "soft", "attr"))


def resolved(edges: DataFrame) -> DataFrame:
    """One relation per pair: hard ones replace soft ones, soft ones never replace; two different hard ones raise."""
    pair = Window.partitionBy("a", "b")
    first = pair.orderBy(F.col("soft"), F.col("attr").desc_nulls_last(), F.col("rel"))
    hard = F.size(F.collect_set(F.when(~F.col("soft"), F.col("rel"))).over(pair))
    one = edges.withColumn("_hard", hard).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return checked(one, "rel", F.col("_hard") > 1, F.concat(F.lit("conflicting relations: "), F.col("a"), F.lit(" / "), F.col("b"))).drop("_hard", "_n")


def without(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Break the relations of the given pairs, in both directions."""
    gone = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.join(gone, ["a", "b"], "left_anti")


def ordered(edges: DataFrame) -> DataFrame:
    """By relation, then for similar and almost the closest first, then by type."""
    closeness = F.when(F.col("rel").isin("similar", "almost"), F.round(1 - F.coalesce("attr", F.lit(0.0)), 2)).otherwise(F.lit(0.0))
    return edges.orderBy("a", "rel", closeness, "b")


def of_kinds(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("rel").isin(*kinds))


def compared(a: Column, b: Column) -> Column:
    """The hard relation of two types by their arrays of main forms; null for none."""
    left, right = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(left, right))
    return (
        F.when(a == b, "identical")
        .when((shared == F.size(left)) & (shared == F.size(right)), "equals")
        .when(shared == F.size(left), "contains")
        .when(shared == F.size(right), "subset_of")
    )


def subsets(forms: Column) -> Column:
    """All non-empty subsets of a few forms, as sorted arrays."""
    start = F.array(F.array().cast("array<string>"))
    every = F.aggregate(F.array_sort(F.array_distinct(forms)), start, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return F.filter(every, lambda s: F.size(s) > 0)


def containment(types: DataFrame, key: str = "type_key", forms: str = "forms") -> DataFrame:
    """contains / subset_of edges.  Types of up to MANY_FORMS forms list their subsets, which meet the keys by equality:
    no pair is compared.  Longer ones, which have too many, meet the types that share a form with them, and contain
    those all of whose forms they share."""
    known = types.select(F.col(key).alias("a")).distinct()
    few = types.where(F.size(forms) <= MANY_FORMS).select(F.col(key).alias("b"), F.explode(subsets(F.col(forms))).alias("subset")).select("b", F.array_join("subset", " + ").alias("a"))
    met = few.where("a <> b").join(known, "a", "left_semi").select("a", "b")
    long = types.where(F.size(forms) > MANY_FORMS).select(F.col(key).alias("b"), F.explode(F.array_distinct(forms)).alias("form"))
    every = types.select(F.col(key).alias("a"), F.size(F.array_distinct(forms)).alias("n"), F.explode(F.array_distinct(forms)).alias("form"))
    shared = long.join(every, "form").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("m = n").select("a", "b")
    return both_ways(edge(met.unionByName(shared).distinct(), "a", "b", F.lit("contains")))


def _blocked(types: DataFrame, key: str, forms: str, side: str) -> DataFrame:
    """Types by what similar ones have in common: how many forms, and their first letters."""
    letters = F.array_join(F.array_sort(F.transform(forms, lambda x: F.substring(x, 1, 1))), "")
    return types.select(F.col(key).alias(side), F.col(forms).alias(f"f{side}"), F.size(forms).alias("n"), letters.alias("letters"), F.length(F.array_join(forms, " ")).alias(f"l{side}"))


def _rated(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, fa, la, b, fb, lb) whose ratio, to two decimals, reaches ``least``.  A ratio is at most twice the shorter
    over both lengths, which rules out most pairs before it is computed."""
    may = 2 * F.least("la", "lb") >= (least - 0.005) * (F.col("la") + F.col("lb"))
    apart = pairs.where(may).where(compared(F.col("fa"), F.col("fb")).isNull())
    return apart.withColumn("attr", type_similarity_udf("fa", "fb")).where(F.col("attr") >= least)


def similar(types: DataFrame, key: str = "type_key", forms: str = "forms", least: float = SIMILAR_FROM) -> DataFrame:
    """similar edges among types of equal size and first letters whose ratio reaches ``least``."""
    pairs = _blocked(types, key, forms, "a").join(_blocked(types, key, forms, "b"), ["n", "letters"]).where("a < b")
    return both_ways(edge(_rated(pairs, least), "a", "b", F.lit("similar"), True, F.col("attr")))


def bags(products: DataFrame, types: str = "types", sqn: str = "sqn") -> DataFrame:
    """type -> bag of short names (capacity counts duplicates, breadth does not)."""
    return products.select(F.explode(types).alias("type_key"), F.col(sqn).alias("sqn")).groupBy("type_key").agg(F.array_sort(F.collect_list("sqn")).alias("bag"), F.count("*").alias("capacity"), F.countDistinct("sqn").alias("breadth"))


def capacities(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct short names of a type together with those of the types it equals or contains."""
    wider = of_kinds(edges, "equals", "contains").select(F.col("a").alias("type_key"), F.col("b").alias("of"))
    own = members.select("type_key", F.col("type_key").alias("of")).distinct()
    return own.unionByName(wider).join(members.select(F.col("type_key").alias("of"), "sqn"), "of").groupBy("type_key").agg(F.countDistinct("sqn").alias("capacity"))


def meaningful(types: DataFrame, least: int = MIN_CAPACITY) -> DataFrame:
    return types.where((F.coalesce("flag", F.lit(False))) | (F.col("capacity") >= least) | (F.col("arity") == 1))


def root_types(types: DataFrame, edges: DataFrame) -> DataFrame:
    return types.join(of_kinds(edges, "subset_of").select(F.col("a").alias("type_key")), "type_key", "left_anti")


def vocabulary(types: DataFrame, forms: str = "forms") -> DataFrame:
    return types.select(F.explode(forms).alias("term")).distinct()


def tag_overlap(tagged: DataFrame) -> DataFrame:
    """(tag, type_key, sqn) rows to tag edges: contains, subset_of, equals or almost by the overlap of their names."""
    pair = tagged.groupBy("tag", "type_key").agg(F.countDistinct("sqn").alias("both"))
    of_tag = tagged.groupBy("tag").agg(F.countDistinct("sqn").alias("n_tag"))
    of_type = tagged.groupBy("type_key").agg(F.countDistinct("sqn").alias("n_type"))
    met = pair.join(of_tag, "tag").join(of_type, "type_key")
    rel = F.when((F.col("both") == F.col("n_tag")) & (F.col("both") == F.col("n_type")), "equals").when(F.col("both") == F.col("n_type"), "contains").when(F.col("both") == F.col("n_tag"), "subset_of").otherwise("almost")
    return met.select("tag", "type_key", rel.alias("rel"), F.round(F.col("both") / F.col("n_tag"), 2).alias("of_tag"), F.round(F.col("both") / F.col("n_type"), 2).alias("of_type"))


def children(edges: DataFrame) -> DataFrame:
    """Immediate contains edges: those that no other contains edge goes between."""
    down = of_kinds(edges, "contains").select("a", "b")
    between = down.alias("x").join(down.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).distinct()
    return down.join(between, ["a", "b"], "left_anti")


def looked_up(parsed: DataFrame, types: DataFrame, edges: DataFrame, least: float = SIMILAR_FROM) -> DataFrame:
    """Parsed types (id, type_key, forms) to what the dictionary relates them to: (id, type_key, b, rel, attr).

    A type that the dictionary has is identical to itself and has its own relations there.  Types similar to it by the
    same measure as in the dictionary come after, with their relations; what was related before is not listed again.
    All of it is found for each distinct type, and stored; the ids meet it last."""
    relations = edges.select(F.col("a").alias("via"), F.col("b").alias("to"), "rel", "attr")
    asked = parsed.select("type_key", "forms").distinct().dropDuplicates(["type_key"])
    known = asked.select("type_key").join(types.select("type_key"), "type_key", "left_semi")
    own = known.select("type_key", F.col("type_key").alias("b"), F.lit("identical").alias("rel"), F.lit(None).cast("double").alias("attr"))
    there = known.join(relations, F.col("type_key") == F.col("via")).select("type_key", F.col("to").alias("b"), "rel", "attr")
    first = own.unionByName(there).distinct()
    pairs = _blocked(asked, "type_key", "forms", "a").join(_blocked(types, "type_key", "forms", "b"), ["n", "letters"])
    near = _rated(pairs, least).select(F.col("a").alias("type_key"), "b", "attr")
    met = near.join(first.select("type_key", "b"), ["type_key", "b"], "left_anti")
    fallback = met.select("type_key", "b", F.lit("similar").alias("rel"), "attr")
    onward = met.select("type_key", F.col("b").alias("via")).join(relations, "via").select("type_key", F.col("to").alias("b"), "rel", "attr").where("b <> type_key")
    more = fallback.unionByName(onward.join(first.unionByName(fallback).select("type_key", "b"), ["type_key", "b"], "left_anti")).distinct()
    related = stored(first.unionByName(more), "related")
    each = parsed.select("id", "type_key").repartition("id", "type_key").distinct()  # dealt out first: no task lists all of a file's rows
    return each.join(related, "type_key").select("id", "type_key", "b", "rel", "attr")


def has_types(parsed: DataFrame, types: DataFrame, edges: DataFrame) -> DataFrame:
    """Parsed types that are root types of the dictionary."""
    return parsed.join(root_types(types, edges).select("type_key"), "type_key", "left_semi")


def spelled_out(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """(type_text, type_key) of types as they are written, and edges of keys, to edges of texts.  Texts of one key are
    equal; what one contains, so does the other."""
    same = texts.select(F.col("type_text").alias("a"), "type_key").join(texts.select(F.col("type_text").alias("b"), "type_key"), "type_key").where("a <> b")
    left, right = (texts.select(F.col("type_text").alias(f"text_{k}"), F.col("type_key").alias(k)) for k in "ab")
    carried = edges.join(left, "a").join(right, "b").select(F.col("text_a").alias("a"), F.col("text_b").alias("b"), "rel", "soft", "attr")
    return edge(same, "a", "b", F.lit("equals")).unionByName(carried).distinct()


def built(types: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """All relations over types, and over tags where given."""
    edges = containment(types).unionByName(similar(types))
    if tagged is not None:
        found = tag_overlap(tagged)
        soft = F.col("rel") == "almost"
        edges = edges.unionByName(edge(found, "tag", "type_key", F.col("rel"), soft, F.when(soft, F.col("of_tag")))).unionByName(
            edge(found, "type_key", "tag", inverse(F.col("rel")), soft, F.when(soft, F.col("of_type")))
        )
    return resolved(edges)
