"""Catalogue files: categories, products, brands, word forms, type graphs, term dictionaries, indexes."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import blank_to_null, join_list, no_nbsp, split_list, split_values
from quern.sources.paths import numbered, stored

META = ("raw_id", "sqn", "brand", "brand_detected", "product_manufacturer", "weight", "fat", "pack", "pfqn", "tags", "types")
BRAND = ("name", "type", "no_brand", "generic", "synonyms", "manufacturers", "linked")
#: Lines of a file whose articles are told apart by one task.
STRETCH = 100_000
_META_SCHEMA = ", ".join(f"{c} string" for c in META)
_BRAND_SCHEMA = ", ".join(f"{c} string" for c in BRAND)


def _csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, encoding=encoding, quote='"', escape='"', multiLine=True)


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def categories(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, "id string, title string, crawllink string, level string, parentId string, pathTitles string, productCount string, products string")
    return raw.select(
        "id",
        "title",
        F.col("crawllink").alias("crawl_link"),
        F.col("level").try_cast("int").alias("level"),
        F.col("parentId").alias("parent_id"),
        split_list(F.col("pathTitles")).alias("path_titles"),
        F.col("productCount").try_cast("int").alias("product_count"),
        split_list(F.col("products")).alias("products"),
    )


def write_categories(df: DataFrame, path: str, stopped: DataFrame | None = None) -> None:
    kept = df if stopped is None else df.join(stopped.select("id"), "id", "left_anti")
    lists = [F.array_join(c, "|").alias(n) for c, n in (("path_titles", "pathTitles"), ("products", "products"))]
    _write_csv(kept.select("id", "title", F.col("crawl_link").alias("crawllink"), "level", F.col("parent_id").alias("parentId"), lists[0], F.col("product_count").alias("productCount"), lists[1]), path)


def raw_products(spark: SparkSession, path: str) -> DataFrame:
    """Crawled products; details is a map, and a missing raw id is the item's."""
    raw = _csv(spark, path, "id string, name string, imgUrl string, price string, link string, crawllink string, weight string, details string")
    clean = raw.select(*[no_nbsp(F.col(c)).alias(c) for c in raw.columns])
    details = F.from_json("details", "map<string,string>")
    return clean.withColumn("details", details).select(
        "*", details_value(F.col("details"), "Бренд:").alias("brand"), details_value(F.col("details"), "Изготовитель:").alias("manufacturer"), details_value(F.col("details"), "Вес:").alias("label_weight")
    )


def details_value(details: Column, key: str) -> Column:
    return blank_to_null(F.try_element_at(details, F.lit(key)))


def meta_products(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, _META_SCHEMA)
    return raw.select(
        "raw_id",
        "sqn",
        blank_to_null(F.col("brand")).alias("brand"),
        (F.lower("brand_detected") == "true").alias("brand_detected"),
        blank_to_null(F.col("product_manufacturer")).alias("product_manufacturer"),
        *[split_values(F.col(c)).alias(c) for c in ("weight", "fat", "pack")],
        "pfqn",
        split_list(F.col("tags")).alias("tags"),
        F.transform(split_list(F.col("types")), lambda t: F.split(t, r" \+ ")).alias("types"),
    )


def write_meta_products(df: DataFrame, path: str) -> None:
    _write_csv(
        df.select(
            "raw_id",
            "sqn",
            "brand",
            F.when(F.col("brand_detected"), "True").otherwise("False").alias("brand_detected"),
            "product_manufacturer",
            *[F.array_join(c, " + ").alias(c) for c in ("weight", "fat", "pack")],
            "pfqn",
            join_list(F.col("tags")).alias("tags"),
            join_list(F.transform("types", lambda t: F.array_join(t, " + "))).alias("types"),
        ),
        path,
    )


def brands(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, _BRAND_SCHEMA)
    return raw.select("name", blank_to_null(F.col("type")).alias("type"), (F.lower("no_brand") == "true").alias("no_brand"), blank_to_null(F.col("generic")).alias("generic"), *[split_list(F.col(c)).alias(c) for c in BRAND[4:]])


def write_brands(df: DataFrame, path: str) -> None:
    kept = df.where(F.coalesce("type", F.lit("")) != "duplicate")
    _write_csv(kept.select("name", "type", F.when(F.col("no_brand"), "True").otherwise("False").alias("no_brand"), "generic", *[join_list(F.col(c)).alias(c) for c in BRAND[4:]]).orderBy("name"), path)


def word_forms(lines: DataFrame) -> DataFrame:
    """``word~noun:a|b~same:c~pet:d  # comment`` lines (column value) to (word, noun_base, same, pet, source)."""
    text = F.lower(F.trim(F.regexp_replace("value", "#.*$", "")))
    parts = F.split("t", "~")

    def part(name: str) -> Column:
        found = F.get(F.filter("parts", lambda p: F.startswith(F.trim(p), F.lit(f"{name}:"))), 0)
        return F.filter(F.transform(F.split(F.regexp_replace(F.trim(found), f"^{name}:", ""), "[|]"), lambda x: F.trim(x)), lambda x: x != "")

    none = F.array().cast("array<string>")
    kept = lines.select(text.alias("t")).where("t <> ''").withColumn("parts", parts)
    return kept.select(F.trim(F.get("parts", 0)).alias("word"), *[F.coalesce(part(n), none).alias(c) for n, c in (("noun", "noun_base"), ("same", "same"), ("pet", "pet"))], F.lit(None).cast("string").alias("source"))


def read_word_forms(spark: SparkSession, path: str) -> DataFrame:
    return word_forms(spark.read.text(path))


def explanatory_articles(spark: SparkSession, path: str, encoding: str = "windows-1251") -> DataFrame:
    """Articles parted by blank lines to lexicon rows: the head word, and the words that its definition relates it to."""
    raw = spark.read.csv(path, schema="value string", sep="\u0001", quote="", encoding=encoding, lineSep="\n") if encoding else spark.read.text(path)
    return articles(raw.withColumn("n", F.monotonically_increasing_id()))


def articles(lines: DataFrame) -> DataFrame:
    """(n, value) lines to lexicon rows.  Relations are read from the definition's first words."""
    from pyspark.sql import Window

    blank = (F.trim(F.coalesce("value", F.lit(""))) == "").cast("int")
    # blank lines before a line: within stretches of lines, and over the stretches
    cut = lines.withColumn("_stretch", F.floor(F.col("n") / STRETCH)).withColumn("_blank", blank)
    earlier = F.sum("_blanks").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))  # a row a stretch
    starts = cut.groupBy("_stretch").agg(F.sum("_blank").alias("_blanks")).select("_stretch", F.coalesce(earlier, F.lit(0)).alias("_start"))
    inner = F.sum("_blank").over(Window.partitionBy("_stretch").orderBy("n"))
    counted = cut.withColumn("_inner", inner).join(starts, "_stretch").withColumn("article", F.col("_start") + F.col("_inner"))
    whole = counted.where(blank == 0).groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: F.trim(x["value"])), " ").alias("text"))
    head = F.lower(F.regexp_extract("text", r"(?U)^(\w[\w-]*)", 1))

    def related(pattern: str) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(rf"(?iU){pattern}\s+(?:сущ\.\s*:?\s*)?(\w[\w-]*)"), F.lit(1)), F.lower))

    return whole.select(head.alias("word"), related(r"соотн\.\s+с").alias("noun_base"), related(r"то\s+же,?\s+что").alias("same"), related(r"уменьш\.?(?:-ласк\.?)?\s+к").alias("pet"), F.lit("articles").alias("source")).where("word <> ''")


def piped_dictionary(lines: DataFrame) -> DataFrame:
    """``word|...|definition`` one-liners (column value): nouns, with ``==word`` references; words that share three first
    letters and a reference merge into the shortest."""
    parts = F.split("value", "[|]")
    one = lines.select(F.lower(F.trim(F.get(parts, 0))).alias("word"), F.transform(F.regexp_extract_all("value", F.lit(r"(?U)==\s*(\w[\w-]*)"), F.lit(1)), F.lower).alias("refs")).where("word <> ''")
    pairs = one.select("word", F.explode_outer("refs").alias("ref"))
    short = pairs.groupBy(F.substring("word", 1, 3).alias("head"), F.col("ref").alias("to")).agg(F.min_by("word", F.struct(F.length("word"), "word")).alias("base"))
    joined = pairs.join(short, (F.substring("word", 1, 3) == F.col("head")) & F.col("ref").eqNullSafe(F.col("to"))).select("word", "ref", "base")
    none = F.array().cast("array<string>")
    same = F.array_sort(F.array_union(F.collect_set(F.when(F.col("base") != F.col("word"), F.col("base"))), F.collect_set("ref")))
    return joined.groupBy("word").agg(same.alias("same")).select("word", none.alias("noun_base"), "same", none.alias("pet"), F.lit("piped").alias("source"))


# -- type graphs

# How a relation and a count are written.
_RELATION = r"(?U)^(\w+)(?:\[([^\]]+)\])?(~)?\s+(.*)$"
_COUNT = r"^(\d+)(?:/(\d+))?$"


def without_comments(text: str) -> str:
    """JSON text without // and /* */ comments (strings are left alone)."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.DOTALL)


def type_graph(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(types, edges) of a graph file's text: ``{"a + b": ["3/1", "contains c + d", "similar[0.9]~ e"]}``."""
    rows = [(k, v) for k, v in json.loads(without_comments(text)).items()]  # a dictionary file, read on the driver
    flat = spark.createDataFrame(rows or [("", [])], "type_text string, entries array<string>").where("type_text <> ''")
    return graph_tables(flat)


def graph_tables(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    counts = F.filter("entries", lambda e: e.rlike(_COUNT))
    types = flat.select("type_text", F.split("type_text", r" \+ ").alias("terms"), F.regexp_extract(F.get(counts, 0), _COUNT, 1).try_cast("int").alias("own"), F.regexp_extract(F.get(counts, 0), _COUNT, 2).try_cast("int").alias("under"))
    entry = flat.select("type_text", F.explode("entries").alias("e")).where(~F.col("e").rlike(_COUNT))
    edges = entry.select(F.col("type_text").alias("a"), F.regexp_extract("e", _RELATION, 4).alias("b"), F.regexp_extract("e", _RELATION, 1).alias("rel"), (F.regexp_extract("e", _RELATION, 3) == "~").alias("soft"), F.regexp_extract("e", _RELATION, 2).try_cast("double").alias("attr"))
    return types, edges


def graph_lines(types: DataFrame, edges: DataFrame) -> DataFrame:
    """(type_text, entries): the meaningful types in order, each with its count and its relations in order."""
    attr = F.when(F.col("attr").isNotNull(), F.concat(F.lit("["), F.format_number("attr", 2), F.lit("]"))).otherwise("")
    line = F.concat("rel", attr, F.when(F.col("soft"), "~").otherwise(""), F.lit(" "), "b")
    listed = edges.groupBy(F.col("a").alias("type_text")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    count = F.concat(F.coalesce("own", F.lit(0)).cast("string"), F.when(F.col("under").isNotNull(), F.concat(F.lit("/"), F.col("under").cast("string"))).otherwise(""))
    return types.join(listed, "type_text", "left").select("type_text", F.concat(F.array(count), F.coalesce("lines", F.array().cast("array<string>"))).alias("entries")).orderBy("type_text")


def write_type_graph(types: DataFrame, edges: DataFrame, path: str, meaningful: DataFrame | None = None) -> None:
    """JSON lines of (type_text, entries), in the order of types; with ``meaningful`` (type_text) of those types only."""
    if meaningful is not None:
        types = types.join(meaningful.select("type_text"), "type_text", "left_semi")
        edges = edges.join(meaningful.select(F.col("type_text").alias("a")), "a", "left_semi").join(meaningful.select(F.col("type_text").alias("b")), "b", "left_semi")
    graph_lines(types, edges).write.mode("overwrite").json(path)


def read_type_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_type_graph`` wrote: (types, edges)."""
    return graph_tables(spark.read.schema("type_text string, entries array<string>").json(path))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_type_graph(spark: SparkSession, path: str, compact: str | None = None, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(types, edges) from the compact form where there is one (its dictionary is checked), else from JSON lines."""
    if compact and terms is not None and exists(spark, f"{compact}/types"):
        return read_compact_graph(spark, compact, terms)
    return read_type_graph(spark, path)


def dump_terms(types: DataFrame, path: str) -> None:
    """Write the dictionary of types' terms beside its fingerprint.  A dictionary that is there keeps its ids."""
    spark = types.sparkSession
    known = load_terms(spark, path) if exists(spark, f"{path}/terms") else None
    terms = stored(term_dictionary(types, known), "terms")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    fingerprint(terms, "term_id", "term").write.mode("overwrite").parquet(f"{path}/fingerprint")


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary; terms that don't have the fingerprint beside them raise."""
    terms = spark.read.parquet(f"{path}/terms")
    if spark.read.parquet(f"{path}/fingerprint").first()["fingerprint"] != fingerprint(terms, "term_id", "term").first()["fingerprint"]:
        raise ValueError("the term dictionary is not the one that was written")
    return terms


def write_compact_graph(types: DataFrame, edges: DataFrame, terms: DataFrame, path: str) -> None:
    """Types and edges as Parquet over term ids, beside the dictionary's fingerprint."""
    ids = types.select("type_text", F.posexplode("terms").alias("n", "term")).join(terms, "term").groupBy("type_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term_id"))), lambda x: x["term_id"]).alias("term_ids"))
    ids.write.mode("overwrite").parquet(f"{path}/types")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    fingerprint(terms, "term_id", "term").write.mode("overwrite").parquet(f"{path}/fingerprint")


def read_compact_graph(spark: SparkSession, path: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph back as texts; a dictionary of another fingerprint raises."""
    if spark.read.parquet(f"{path}/fingerprint").first()["fingerprint"] != fingerprint(terms, "term_id", "term").first()["fingerprint"]:
        raise ValueError("the term dictionary is not the one that the graph was written with")
    ids = spark.read.parquet(f"{path}/types").select("type_text", F.posexplode("term_ids").alias("n", "term_id")).join(terms, "term_id")
    types = ids.groupBy("type_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("terms"))
    return types, spark.read.parquet(f"{path}/edges")


def term_dictionary(types: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(term_id, term): the terms of types.  Terms of a ``known`` dictionary keep their ids; new ones are numbered on from
    its largest, in their order."""
    terms = types.select(F.explode("terms").alias("term")).distinct()
    if known is None:
        return numbered(terms, "term_id", F.col("term")).select(F.col("term_id").cast("int").alias("term_id"), "term")
    last = known.agg(F.max("term_id")).first()[0] or 0
    fresh = numbered(terms.join(known.select("term"), "term", "left_anti"), "term_id", F.col("term"))
    return known.select("term_id", "term").unionByName(fresh.select((F.col("term_id") + last).cast("int").alias("term_id"), "term"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row: a checksum of the given columns that doesn't depend on the rows' order."""
    return df.agg(F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("fingerprint"), F.count("*").alias("n"))


def open_or_build(spark: SparkSession, path: str, source: DataFrame, build, readonly: bool = False) -> DataFrame:
    """A materialised index: read if it isn't empty and the source's schema and fingerprint are those that it was built
    from, else built and written."""
    now = (*fingerprint(source, *source.columns).first(), source.schema.simpleString())
    if exists(spark, f"{path}/fingerprint") and tuple(spark.read.parquet(f"{path}/fingerprint").first()) == now:
        index = spark.read.parquet(f"{path}/index")
        if not now[1] or not index.isEmpty():
            return index
    if readonly:
        raise ValueError("the index is missing or stale")
    build(source).write.mode("overwrite").parquet(f"{path}/index")
    spark.createDataFrame([now], "fingerprint decimal(38,0), n long, schema string").write.mode("overwrite").parquet(f"{path}/fingerprint")
    return spark.read.parquet(f"{path}/index")
