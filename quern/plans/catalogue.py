"""Registered catalogue queries and their DuckDB twins.

Each query applies operators of the engine to whole tables (or to a small table given in place) and has the columns of
its twin.  Arrays are joined to text so that both engines compare alike.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import attributes, morphology, similarity, text, tokens
from quern.functions.terms import Terms, main_forms, resolved_terms, type_tuples
from quern.operators import brands, categories, dedup, relations, reports, search
from quern.plans import products
from quern.sources import catalogue as files
from quern.sources import html
from quern.sources.paths import shared_path, ship, spread, stored
from quern.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return run

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))


# -- tokens and text

_WORDS = r"""list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[\s"|,.«»“”()?!+:]+'), lambda x: x <> '')"""


@query(f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY ALL")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.explode(text.words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, len({_WORDS.format('p_name')})::BIGINT AS n_words, list_aggregate({_WORDS.format('p_name')}, 'string_agg', ' ') AS joined FROM part")
def tokenize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tokens.tokens(tokens.DEFAULT.column(F.col("p_name")))
    return _t(spark, sf_dir, "part").select("p_partkey", F.size(items).cast("long").alias("n_words"), F.array_join(tokens.texts(items), " ").alias("joined"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\",.«»“”()?+:]+', ' ', 'g')) AS label FROM documents")
def cleanup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.cleanup(F.col("text")).alias("label"))


def _last_edited(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, w) to the word that each turn edits of the turn before."""
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("b", before).select("conv_id", "turn", F.when(F.col("b").isNotNull() | (F.size("w") == 1), tokens.last_changed_token(F.coalesce("b", F.array().cast("array<string>")), F.col("w"))).alias("edited"))


@query(
    r"""
    WITH c AS (
      SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s"|,.«»“”()?!+:]+'), lambda x: x <> '') AS w FROM conversations),
    p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c),
    s AS (
      SELECT *, coalesce(list_min(list_filter(range(1, least(len(w), len(b)) + 1), lambda i: w[i] <> b[i])), least(len(w), len(b)) + 1) - 1 AS same FROM p)
    SELECT conv_id, turn, CASE
      WHEN len(w) = 1 THEN w[1]
      WHEN b IS NULL OR w = b OR len(w) = 0 OR abs(len(w) - len(b)) > 1 THEN NULL
      WHEN w[same + CASE WHEN len(w) >= len(b) THEN 2 ELSE 1 END:] = b[same + CASE WHEN len(w) <= len(b) THEN 2 ELSE 1 END:] THEN w[least(same + 1, len(w))] END AS edited
    FROM s
    """
)
def last_edited_token_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each turn as successive queries of a session."""
    return _last_edited(_t(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("w")))


_NAMES = (
    "продукт(10 % жирн) с соком",
    "Продукт творож 5.6%130г клубника+бисквит",
    "чай 25пак с жасмином",
    "Кофе растворимый 150г пакет",
    "сахар 1 кг. коричневый",
    "сахар кг., коричневый",
    "сахар1 кг. корич.",
    "рыба г/к",
)


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n) for k, n in enumerate(_NAMES)], "id int, name string")


def _values(rows: list[tuple], *columns: str) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({', '.join(columns)})"


_ATTRIBUTES = [
    (0, "", "10 % жирн", "", "продукт с соком"),
    (1, "130г", "5.6%", "", "продукт творож клубника бисквит"),
    (2, "", "", "25пак", "чай с жасмином"),
    (3, "150г", "", "пакет", "кофе растворимый"),
    (4, "1 кг.", "", "", "сахар коричневый"),
    (5, "кг.", "", "", "сахар коричневый"),
    (6, "1 кг.", "", "", "сахар корич"),
    (7, "", "", "", "рыба г/к"),
]


@query(f"SELECT * FROM {_values(_ATTRIBUTES, 'id', 'weight', 'fat', 'pack', 'words')}")
def attribute_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attributes.attributes(F.col("name"))
    return _names(spark).withColumn("a", a).select("id", *[F.array_join(f"a.{c}", "+" if c != "words" else " ").alias(c) for c in ("weight", "fat", "pack", "words")])


_OLD_ATTRIBUTES = [
    (0, "", "10 % жирн", "", "продукт с соком"),
    (1, "130г", "5.6%", "", "продукт творож клубника бисквит"),
    (2, "", "", "25пак", "чай с жасмином"),
    (3, "150г", "", "пакет", "кофе растворимый"),
    (4, "1 кг.", "", "", "сахар коричневый"),
    (5, "кг.", "", "", "сахар коричневый"),
    (6, "1 кг.", "", "", "сахар корич"),
    (7, "г", "", "", "рыба /к"),  # a bare unit before a slash is a weight in the old grammar
]


@query(f"SELECT * FROM {_values(_OLD_ATTRIBUTES, 'id', 'weight', 'fat', 'pack', 'sqn')}")
def attribute_parse_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark).select("id", attributes.legacy(F.col("name")).alias("a")).select("id", "a.weight", "a.fat", "a.pack", "a.sqn")


@query(r"SELECT unnest(regexp_extract_all(lower(text), '(?:^|[^\w])(\d+(?:[.,]\d+)?)\s*%', 1)) AS share, count(*) AS n FROM documents GROUP BY 1")
def percent_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?:^|[^\w])({attributes.NUMBER})\s*%"), F.lit(1))
    return _documents(spark, sf_dir).select(F.explode(found).alias("share")).groupBy("share").agg(F.count("*").alias("n"))


@query("SELECT part AS value, count(*) AS n FROM (SELECT unnest(string_split(replace(p_name, ' ', ' + '), ' + ')) AS part FROM part) GROUP BY 1")
def attribute_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_t(spark, sf_dir, "part"), F.replace("p_name", F.lit(" "), F.lit(" + ")))


_WORDLIST = [("ёж",), ("лес",), ("темен",), ("Test",), ("а-б",), ("соль-перец",), ("с",)]


@query(
    f"""SELECT word, regexp_full_match(word, '[А-Яа-яЁё]+(-[А-Яа-яЁё]+)?') AND length(word) >= 2 AS simple,
    word IN ('в','во','с','со','из','для','и','на','без','к','не','де','по','под') AS preposition,
    CASE WHEN contains(word, 'ё') THEN replace(word, 'ё', 'е') ELSE coalesce(list_aggregate(list_transform(list_filter(range(1, length(word) + 1), lambda i: word[i] = 'е'), lambda i: word[1:i - 1] || 'ё' || word[i + 1:]), 'string_agg', ','), '') END AS variants
    FROM {_values(_WORDLIST, 'word')}"""
)
def word_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return spark.createDataFrame(_WORDLIST, "word string").select("word", text.is_simple_russian_word(w).alias("simple"), text.is_preposition(w).alias("preposition"), F.array_join(text.yo_variants(w), ",").alias("variants"))


# -- categories


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations below regions below the root, as a category tree with suppliers as products."""
    region, nation, supplier = (_t(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    sold = supplier.groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("string")).alias("products"))
    none = F.array().cast("array<string>")
    tops = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit("-1").alias("parent_id"), none.alias("products"))
    below = nation.join(sold, nation["n_nationkey"] == sold["s_nationkey"], "left").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.coalesce("products", none).alias("products"))
    return tops.unionByName(below)


_TREE = "SELECT 'r' || r_regionkey AS id, r_name AS title, '-1' AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation"


@query(f"WITH RECURSIVE t AS ({_TREE}), p AS (SELECT id, id AS ancestor, 0 AS depth FROM t UNION ALL SELECT p.id, t.parent_id, depth + 1 FROM p JOIN t ON p.ancestor = t.id WHERE t.parent_id <> '-1') SELECT * FROM p")
def category_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.closure(_regions(spark, sf_dir))


@query("SELECT s_suppkey::VARCHAR AS product, 'n' || s_nationkey AS category FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def products_under_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _regions(spark, sf_dir)
    return categories.under(categories.members(tree), categories.closure(tree))


@query("SELECT 'r' || r_regionkey AS id, r_name AS title FROM region")
def root_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.roots(_regions(spark, sf_dir)).select("id", "title")


@query("SELECT s_suppkey::VARCHAR AS product, least(n_name, r_name) || '|' || greatest(n_name, r_name) AS tags FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tags_by_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _regions(spark, sf_dir)
    under = categories.under(categories.members(tree), categories.closure(tree))
    return categories.tags(under, tree.select("id", "title")).select("product", text.join_list(F.col("tags")).alias("tags"))


@query("SELECT s_suppkey::VARCHAR AS product FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 1) AND n_nationkey NOT IN (1, 2)")
def accept_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _regions(spark, sf_dir)
    under = categories.under(categories.members(tree), categories.closure(tree))
    sold = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("product"))
    return categories.accept_ignore(sold, under, accept=["r0", "r1"], ignore=["n1", "n2"])


@query("SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS path, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_below FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || ' / ' || n_name, 0 FROM nation JOIN region ON n_regionkey = r_regionkey")
def category_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _regions(spark, sf_dir)
    return categories.listing(tree, categories.closure(tree)).select("id", "depth", "path", "n_below")


@query("SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'r2'")
def stopped_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _regions(spark, sf_dir)
    title = _t(spark, sf_dir, "region").where("r_regionkey = 2").first()["r_name"]
    return categories.under_stopped(tree, categories.closure(tree), [title])


# -- dedup, upserts, sorts


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 OR user_id IS NULL")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(_t(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("k", F.concat_ws("/", "user_id", "event_type"))
    return dedup.last_wins(rows, "k", [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "value")


@query(
    r"""
    SELECT page_id, sha1('GET' || chr(10) || lower(regexp_extract(url, '^([A-Za-z][\w+.-]*://[^/?#]*)', 1))
      || CASE WHEN regexp_extract(url, '^(?:[A-Za-z][\w+.-]*://[^/?#]*)?([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^(?:[A-Za-z][\w+.-]*://[^/?#]*)?([^?#]*)', 1) END
      || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || list_aggregate(list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), 'string_agg', '&') ELSE '' END
      || regexp_extract(url, '(#.*)$', 1) || chr(10)) AS fingerprint FROM pages
    """
)
def url_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", dedup.request_fingerprint(F.lit("get"), F.col("url")).alias("fingerprint"))


_LAYERS = [(0, "кот", "", "котик"), (1, "кот", "кошка", ""), (2, "кот", "", ""), (0, "дом", "", ""), (1, "дом", "", "")]


@query(f"SELECT word, noun_base, same FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY (noun_base <> '' OR same <> '') DESC, layer DESC) AS n FROM {_values(_LAYERS, 'layer', 'word', 'noun_base', 'same')}) WHERE n = 1")
def layered_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.functions.morphology import merged_layers

    rows = spark.createDataFrame(_LAYERS, "layer int, word string, noun_base string, same string")
    as_lists = rows.select("layer", "word", text.split_list(F.col("noun_base")).alias("noun_base"), text.split_list(F.col("same")).alias("same"), F.array().cast("array<string>").alias("pet"), F.lit(None).cast("string").alias("source"))
    return merged_layers(as_lists).select("word", F.array_join("noun_base", "|").alias("noun_base"), F.array_join("same", "|").alias("same"))


@query("SELECT p_partkey, p_brand, p_retailprice, rank FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::INT AS rank FROM part) WHERE rank <= 3")
def group_limit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.group_limit(_t(spark, sf_dir, "part"), 3, "p_retailprice", F.col("p_brand")).select("p_partkey", "p_brand", "p_retailprice", "rank")


@query("SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1) // 10 AS page FROM part")
def result_pages_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's list in pages."""
    return dedup.in_chunks(_t(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], group=F.col("p_brand")).select("p_partkey", "p_brand", "page")


# -- brands

_BRANDS = [
    ("Домик в деревне", "marketing", None, "молоко", "", "", ""),
    ("Рузское молоко", "marketing", None, None, "рузское", "", ""),
    ("На зубок", "marketing", None, None, "", "", ""),
    ("Чудо-ягода", "marketing", None, None, "", "", ""),
    ("Не Бренд", None, True, None, "", "", ""),
]


def _registry(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_BRANDS, "name string, type string, no_brand boolean, generic string, synonyms string, manufacturers string, linked string")
    return brands.registered(rows.select("name", "type", "no_brand", "generic", *[text.split_list(F.col(c)).alias(c) for c in ("synonyms", "manufacturers", "linked")]))


@query("SELECT n AS name FROM (VALUES ('Домик в деревне'), ('Рузское молоко'), ('На зубок'), ('Чудо-ягода')) t(n)")
def brand_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.listed(_registry(spark)).select("name")


_PHRASES = [
    (0, "домик в деревне", "Домик в деревне", "домик в деревне", ""),
    (1, "домик деревне", "Домик в деревне", "домик деревне", ""),
    (2, "деревне в домик", "Домик в деревне", "деревне в домик", ""),
    (3, "домик деревне в", "Домик в деревне", "домик деревне", "в"),
    (4, "в домик деревне", "Домик в деревне", "домик деревне", "в"),
    (5, "домик в большой деревне", None, None, None),
    (6, "молоко рузское", "Рузское молоко", "молоко рузское", ""),
    (7, "молоко пастер рузское", "Рузское молоко", "рузское", "молоко пастер"),
    (8, "на зубок", "На зубок", "на зубок", ""),
    (9, "на большой зубок", None, None, None),
    (10, "семечки на зубок", "На зубок", "на зубок", "семечки"),
    (11, "семечки зубок на", None, None, None),
    (12, "на зуб", "На зубок", "на зуб", ""),
    (13, "семечки на зуб", "На зубок", "на зуб", "семечки"),
    (14, "дом в деревн", "Домик в деревне", "дом в деревн", ""),
    (15, "молоко дом в деревн", "Домик в деревне", "дом в деревн", "молоко"),
    (16, "молоко дом в де", None, None, None),
    (17, "мол домик в деревне", "Домик в деревне", "домик в деревне", "мол"),
    (18, "дер в дерев", None, None, None),
    (19, "чудо-ягода", "Чудо-ягода", "чудо-ягода", ""),
    (20, "чудо ягода", "Чудо-ягода", "чудо ягода", ""),
]


@query(f"SELECT id, name, matched, not_matched FROM {_values(_PHRASES, 'id', 'q', 'name', 'matched', 'not_matched')} WHERE name IS NOT NULL")
def brand_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(i, q.split()) for i, q, *_ in _PHRASES], "query_id int, words array<string>")
    return search.find_brands(brands.index(_registry(spark)), asked).select(F.col("query_id").alias("id"), "name", "matched", "not_matched")


@query("SELECT p_partkey, token, v AS variant FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part) JOIN (VALUES ('widgit'), ('plats'), ('geear'), ('screww'), ('bolts')) t(v) ON length(token) > 4 AND levenshtein(token, v) BETWEEN 1 AND CASE WHEN length(token) > 5 THEN 2 ELSE 1 END")
def fuzzy_brand_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("b").alias("key"), F.col("p_name").alias("sqn"))
    spelled = spark.createDataFrame([("b", v) for v in ("widgit", "plats", "geear", "screww", "bolts")], "key string, variant string")
    return brands.fuzzy_tokens(names, spelled).select(F.col("id").alias("p_partkey"), "token", "variant")


@query("SELECT * FROM (VALUES (0, 'молоко', true), (1, 'молоко пастеризованное', true), (2, 'сыр', false)) t(id, sqn, brand_detected)")
def brand_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _registry(spark)
    names = spark.createDataFrame([(0, "домик в деревне", "Домик в деревне"), (1, "пастеризованное", "Домик в деревне молоко пастеризованное"), (2, "сыр", "сыр")], "id int, k string, sqn string")
    keyed = names.select("id", F.lit("домик в деревне").alias("key"), "sqn")
    return brands.replaced(keyed, brands.variants(registry), registry).select("id", "sqn", "brand_detected")


@query("SELECT * FROM (VALUES ('ООО \"Рога\"', 'ЗАО Рога'), ('ЗАО Рога', 'ЗАО Рога'), ('Копыта', 'Копыта')) t(maker, \"group\")")
def manufacturer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.manufacturer_groups(spark.createDataFrame([('ООО "Рога"',), ("ЗАО Рога",), ("Копыта",)], "maker string"))


@query("SELECT lower(trim(p_brand)) AS key, p_brand AS name, count(*) AS n FROM part GROUP BY ALL")
def brand_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    registry = part.select(F.col("p_brand").alias("name")).distinct().withColumn("key", brands.brand_key(F.col("name")))
    return part.select(brands.brand_key(F.col("p_brand")).alias("key")).join(registry, "key").groupBy("key", "name").agg(F.count("*").alias("n"))


# -- reports


@query("SELECT p_name AS sqn, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS keys FROM part GROUP BY 1")
def sqn_to_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bag(_t(spark, sf_dir, "part").select(F.col("p_name").alias("sqn"), F.col("p_partkey").alias("key")), "sqn", "key").select("sqn", F.array_join("keys", ",").alias("keys"))


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE contains(p_name, 'red') GROUP BY 1")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    hits = part.where(F.contains("p_name", F.lit("red"))).select(F.col("p_partkey").alias("doc_id"))
    return search.facets(hits, part, "p_brand", "p_partkey")


@query("SELECT p_brand AS brand, count(*) FILTER (NOT contains(p_name, 'red')) AS n_unbranded, count(*) AS n FROM part GROUP BY 1")
def unbranded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unbranded(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.contains("p_name", F.lit("red")).alias("brand_detected")))


@query("SELECT p_type AS manufacturer, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def manufacturer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.makers(_t(spark, sf_dir, "part"), "p_type", "p_brand").select(F.col("p_type").alias("manufacturer"), F.array_join("brands", "|").alias("brands"))


@query("SELECT p_brand AS brand, count(*) FILTER (p_size % 5 = 0) AS n_failed, count(*) AS n FROM part GROUP BY 1 HAVING count(*) FILTER (p_size % 5 = 0) > 0")
def failures_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failures(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") % 5 != 0).alias("ok")))


#: DuckDB: length of the longest common subsequence of {a} and {b}, row by row of the table.
_LCS = """list_last(list_reduce([[0 FOR x IN range(0, length({b}) + 1)]] || [[unicode(c)] FOR c IN string_split({a}, '')],
  lambda prev, ca: list_reduce([[0]] || [[j] FOR j IN range(1, length({b}) + 1)],
    lambda line, j: list_append(line, CASE WHEN ca[1] = unicode(substr({b}, j[1], 1)) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], line[j[1]]) END))))"""


# -- types and relations: a part's name is its short name; its words and word pairs are its types

_TYPE_SQL = """
ty AS (
  SELECT p_partkey, p_name AS sqn, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2),
    least(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) || ' + ' || greatest(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))]) AS type_key FROM part)
"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return _t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sqn"), F.col("p_type").alias("tag"), F.array(words[0], words[1], text.type_key(words)).alias("types"))


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.split("type_key", r" \+ ")
    return relations.bags(_typed(spark, sf_dir)).withColumn("forms", forms).withColumn("arity", F.size(forms)).withColumn("flag", F.lit(False))


@query(f"WITH {_TYPE_SQL} SELECT type_key, count(*) AS capacity, count(DISTINCT sqn) AS breadth FROM ty GROUP BY 1")
def type_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.bags(_typed(spark, sf_dir)).select("type_key", "capacity", "breadth")


@query(f"WITH {_TYPE_SQL} SELECT type_key FROM ty GROUP BY 1 HAVING count(*) >= 40 OR NOT contains(type_key, '+')")
def meaningful_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.meaningful(_types(spark, sf_dir), 40).select("type_key")


_CONTAINS_SQL = f"WITH {_TYPE_SQL}, k AS (SELECT DISTINCT type_key FROM ty), e AS (SELECT x.type_key AS a, y.type_key AS b FROM k x JOIN k y ON NOT contains(x.type_key, '+') AND contains(y.type_key, '+') AND x.type_key IN (split_part(y.type_key, ' + ', 1), split_part(y.type_key, ' + ', 2)))"


@query(f"{_CONTAINS_SQL} SELECT a, b, 'contains' AS rel FROM e UNION ALL SELECT b, a, 'subset_of' FROM e")
def type_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.containment(_types(spark, sf_dir)).select("a", "b", "rel")


@query(f"{_CONTAINS_SQL} SELECT type_key FROM k WHERE type_key NOT IN (SELECT b FROM e)")
def root_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _types(spark, sf_dir)
    return relations.root_types(types, relations.containment(types)).select("type_key")


@query(f"WITH {_TYPE_SQL} SELECT DISTINCT unnest(string_split(type_key, ' + ')) AS term FROM ty")
def type_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.vocabulary(_types(spark, sf_dir))


@query(
    f"""WITH {_TYPE_SQL}, g AS (SELECT DISTINCT p_type AS tag, type_key, sqn FROM ty JOIN part USING (p_partkey)),
    p AS (SELECT tag, type_key, count(*) AS c FROM g GROUP BY ALL), a AS (SELECT tag, count(DISTINCT sqn) AS n FROM g GROUP BY 1), b AS (SELECT type_key, count(DISTINCT sqn) AS m FROM g GROUP BY 1)
    SELECT tag, type_key, CASE WHEN c = n AND c = m THEN 'equals' WHEN c = m THEN 'contains' WHEN c = n THEN 'subset_of' ELSE 'almost' END AS rel,
      round(c / n, 2) AS of_tag, round(c / m, 2) AS of_type FROM p JOIN a USING (tag) JOIN b USING (type_key)"""
)
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.tag_overlap(_typed(spark, sf_dir).select("tag", F.explode("types").alias("type_key"), "sqn"))


@query(f"{_CONTAINS_SQL}, o AS (SELECT type_key, type_key AS t FROM k UNION ALL SELECT a, b FROM e) SELECT o.type_key, count(DISTINCT sqn) AS capacity FROM o JOIN ty ON o.t = ty.type_key GROUP BY 1")
def type_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _typed(spark, sf_dir).select(F.explode("types").alias("type_key"), "sqn")
    return relations.capacities(members, relations.containment(_types(spark, sf_dir)))


@query(f"{_CONTAINS_SQL} SELECT a, b FROM e")
def type_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.children(relations.containment(_types(spark, sf_dir)))


@query(
    f"""WITH {_TYPE_SQL}, k AS (SELECT DISTINCT type_key, string_split(type_key, ' + ') AS f FROM ty),
    l AS (SELECT *, list_aggregate(list_sort([x[1] FOR x IN f]), 'string_agg', '') AS letters FROM k),
    p AS (SELECT x.type_key AS a, y.type_key AS b, x.f AS fa, y.f AS fb FROM l x JOIN l y ON x.letters = y.letters AND len(x.f) = len(y.f) AND x.type_key < y.type_key
      WHERE NOT list_has_all(x.f, y.f) AND NOT list_has_all(y.f, x.f)),
    w AS (SELECT *, array_to_string(fa, ' ') AS ja, array_to_string(fb, ' ') AS jb, array_to_string(fa, '') AS ta, array_to_string(fb, '') AS tb,
      fa[1] AS a1, fb[1] AS b1, coalesce(fa[2], '') AS a2, coalesce(fb[2], '') AS b2 FROM p),
    r AS (SELECT a, b, round(greatest(2 * greatest({_LCS.format(a='a1', b='b1')} + {_LCS.format(a='a2', b='b2')}, {_LCS.format(a='a1', b='b2')} + {_LCS.format(a='a2', b='b1')})::DOUBLE / (length(ta) + length(tb)),
      CASE WHEN len(fa) > 1 THEN 2 * {_LCS.format(a='ja', b='jb')}::DOUBLE / (length(ja) + length(jb)) ELSE 0 END), 2) AS attr FROM w)
    SELECT a, b, 'similar' AS rel, attr FROM r WHERE attr >= 0.7 UNION ALL SELECT b, a, 'similar', attr FROM r WHERE attr >= 0.7"""
)
def type_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.similar(_types(spark, sf_dir), least=0.7).select("a", "b", "rel", "attr")


@query(f"WITH {_TYPE_SQL}, c AS (SELECT type_key, count(*) AS capacity FROM ty GROUP BY 1), s AS (SELECT sqn, max(capacity) AS best FROM ty JOIN c USING (type_key) GROUP BY 1) SELECT capacity, n_types, covered, round(100 * covered / (SELECT count(*) FROM s), 2) AS percent FROM (SELECT capacity, count(*) AS n_types, (SELECT count(*) FROM s WHERE best >= c.capacity) AS covered FROM c GROUP BY capacity)")
def type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage(_typed(spark, sf_dir), _types(spark, sf_dir))


@query("SELECT count(*) AS n, count(*) FILTER (p_size % 5 <> 0) AS n_typed, count(*) FILTER (p_size % 5 > 2) AS n_compound FROM part")
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size without types, with single ones only, and with all."""
    left = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("k"))
    rows = _typed(spark, sf_dir).join(left, "p_partkey")
    types = F.when(F.col("k") == 0, F.slice("types", 1, 0)).when(F.col("k") <= 2, F.slice("types", 1, 2)).otherwise(F.col("types"))
    return reports.enrichment(rows.withColumn("types", types))


_EDGES = [("a", "b", "similar", True, 0.9), ("a", "b", "contains", False, None), ("a", "c", "similar", True, 0.3), ("a", "c", "almost", True, 0.5), ("d", "e", "equals", False, None)]


@query("SELECT * FROM (VALUES ('a', 'b', 'contains'), ('b', 'a', 'subset_of'), ('a', 'c', 'almost'), ('c', 'a', 'almost'), ('d', 'e', 'equals'), ('e', 'd', 'equals')) t(a, b, rel)")
def relation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(_EDGES, "a string, b string, rel string, soft boolean, attr double")
    return relations.resolved(relations.both_ways(edges)).select("a", "b", "rel")


@query(
    f"""WITH n AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS word FROM part),
    p AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM n x JOIN n y USING (word) WHERE x.p_name < y.p_name)
    SELECT a, b, 2 * {_LCS.format(a='a', b='b')}::DOUBLE / (length(a) + length(b)) AS ratio FROM p"""
)
def lcs_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different names that share a word."""
    named = _t(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.explode(F.split("p_name", " ")).alias("word"))
    pairs = named.alias("x").join(named.alias("y"), "word").where("x.p_name < y.p_name").select(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b")).distinct()
    return pairs.select("a", "b", similarity.ratio_udf("a", "b").alias("ratio"))


@query("SELECT p_brand AS name, lower(p_brand) AS type_key FROM part WHERE lower(p_brand) IN (SELECT p_name FROM part) GROUP BY ALL UNION ALL SELECT DISTINCT p_name, list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' + ') FROM part")
def data_quality_name_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return reports.names_that_are_types(names, _types(spark, sf_dir)).select("name", "type_key")


@query("SELECT p_type AS lemma, string_agg(DISTINCT p_name || '=' || upper(p_name), ',' ORDER BY p_name || '=' || upper(p_name)) AS words FROM part GROUP BY 1")
def lemma_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_type").alias("lemma"), F.col("p_name").alias("word"), F.upper("p_name").alias("tag"))
    entries = F.transform(F.map_entries("words"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return reports.lemma_statistics(rows).select("lemma", F.array_join(F.array_sort(entries), ",").alias("words"))


@query(f"WITH {_TYPE_SQL} SELECT count(DISTINCT t) AS n_terms, count(DISTINCT t) + 1 AS next_id FROM (SELECT unnest(string_split(type_key, ' + ')) AS t FROM ty)")
def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = files.term_dictionary(_types(spark, sf_dir).select(F.col("forms").alias("terms")))
    return reports.dictionary_size(terms).select("n_terms", F.col("next_id").cast("long").alias("next_id"))


@query("SELECT p_type AS term, string_agg(DISTINCT w, ' ' ORDER BY w) AS context FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def context_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_type").alias("term"), F.split("p_name", " ").alias("context"))
    return reports.context_log(rows).select("term", F.array_join("context", " ").alias("context"))


@query("SELECT * FROM (VALUES ('мол', 'молоко', 3), ('молоко', 'молоко', 1), ('сыр', 'сыр', 2)) t(short, lemma, n)")
def prefix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short words whose longer forms, all but one, share a main form."""
    rows = [("мол", "мол"), ("молоко", "молоко"), ("молоком", "молоко"), ("молот", "молот"), ("сыр", "сыр"), ("сыра", "сыр"), ("сыром", "сыр"), ("кот", "кот")]
    return reports.prefix_candidates(spark.createDataFrame(rows, "word string, lemma string")).select("short", "lemma", F.col("n").cast("int").alias("n"))


@query("SELECT DISTINCT 'n' || n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3")
def category_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _t(spark, sf_dir, "nation").where("n_nationkey = 3").first()["n_name"]
    return categories.by_title(_regions(spark, sf_dir), title.lower()).select("id")


@query("SELECT p_partkey, 'unicorn' AS added, split_part(p_name, ' ', 2) AS removed FROM part")
def changes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.split("p_name", " ")
    found = dedup.changes(before, F.array(before[0], F.lit("unicorn")))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(found["added"], ",").alias("added"), F.array_join(found["removed"], ",").alias("removed"))


@query("SELECT tail, count(*) AS n FROM (SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS tail FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'blue')) GROUP BY 1 HAVING count(*) >= 2")
def sqn_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([("red",), ("blue",)], "type_text string")
    return reports.sqn_tails(_t(spark, sf_dir, "part").select(F.col("p_name").alias("sqn")).distinct(), types, 2)


# -- terms (Russian, on a small lexicon)

LEXICON = {
    "йогуртный": "йогурт", "рыбе": "рыба", "рыбы": "рыба", "конфеты": "конфета", "шоколаде": "шоколад", "шоколадный": "шоколад", "горьком": "горький",
    "молочный": "молоко", "тушеная": "тушёный", "молоток": "молоток",
}
_TERMS = [(0, "приправа лимонная к рыбе"), (1, "конфеты в гор шок"), (2, "гор шок мол продукт"), (3, "говядина.туш"), (4, "мол-шок")]
_RESOLVED = [
    (0, "приправа", "simple", "приправа", "ok"), (0, "лимонная", "simple", "лимонная", "ok"), (0, "к рыбе", "with_preposition", "рыба", "ok"),
    (1, "конфеты", "simple", "конфета", "ok"), (1, "в гор", "with_preposition", "горький", "ok"), (1, "в шок", "with_preposition", "шоколад", "ok"),
    (2, "гор", "context", "горький", "ok"), (2, "шок", "context", "шоколад", "ok"), (2, "мол", "context", "молоко", "ok"), (2, "продукт", "simple", "продукт", "ok"),
    (3, "говядина.туш", "compound", "говядина тушёный", "ok"), (4, "мол-шок", "compound", None, "needs_context"),
]


@query(f"SELECT * FROM {_values(_RESOLVED, 'id', 'term', 'kind', 'main_form', 'status')}")
def context_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_TERMS, "id int, sqn string")
    found = resolved_terms(F.col("sqn"), F.array().cast("array<string>"), Terms(LEXICON))
    return rows.select("id", F.explode(found).alias("r")).select("id", "r.term", "r.kind", "r.main_form", "r.status")


_TUPLES = [("приправа",), ("лимонная + приправа",), ("приправа + рыба",), ("лимонная + приправа + рыба",)]


@query(f"SELECT type_key, 2 AS n FROM {_values(_TUPLES, 'type_key')}")
def type_tuples_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with synonymous prepositions have the same types."""
    terms = Terms(LEXICON)
    rows = spark.createDataFrame([("приправа лимонная к рыбе",), ("приправа лимонная для рыбы",)], "sqn string")
    found = rows.select("sqn", F.explode(type_tuples(F.col("sqn"), F.array().cast("array<string>"), terms)).alias("one"))
    return found.select("sqn", text.type_key(main_forms(F.col("one"), terms)).alias("type_key")).distinct().groupBy("type_key").agg(F.count("*").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('котик', 'кошка'), ('кот', 'кошка'), ('кошка', 'кошка'), ('котофей', 'котофей'), ('дом', 'дом')) t(word, lemma)")
def lemma_chains_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word, those that articles only refer to among them."""
    from quern.functions.morphology import lemma_table

    lines = spark.createDataFrame([("котик~same:кот # a chain",), ("кот~noun:кошка|котофей",), ("дом",), ("# comment",)], "value string")
    return lemma_table(files.word_forms(lines))


# -- search

_BM25 = """
w AS (SELECT doc_id, unnest({words}) AS term FROM documents),
i AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1),
s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len FROM l),
f AS (SELECT term, count(*) AS df FROM i GROUP BY 1)
""".format(words=_WORDS.format("text"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY ALL")
def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_postings(_documents(spark, sf_dir), "doc_id", "text").select("doc_id", "term", "tf")


@query(
    f"""WITH {_BM25} SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
    FROM i JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN s WHERE term IN ('the', 'nicht', 'pathetic') GROUP BY 1"""
)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = _documents(spark, sf_dir), {"text": text.words(F.col("text"))}
    asked = spark.createDataFrame([(0, "text", t, 1.0) for t in ("the", "nicht", "pathetic")], "query_id int, field string, term string, boost double")
    index = search.postings(docs, "doc_id", fields, only=asked)
    return search.any_terms(index, asked, search.field_statistics(docs, fields)).select("doc_id", F.round("score", 6).alias("score"))


def _found_parts(spark: SparkSession, sf_dir: str, asked: search.ProductQuery) -> DataFrame:
    part = spread(_t(spark, sf_dir, "part"))
    words = F.split("p_name", " ")
    fields = {"types": F.array(words[0], words[1], text.type_key(words)), "pfqn": words, "brand": F.array(F.lower("p_brand"))}
    index = stored(search.postings(part, "p_partkey", fields), "parts")  # a search refers to its index many times
    return search.find_products(index, asked, stored(search.field_statistics(part, fields), "fields"))


@query(
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_name IN ('red ring', 'ring red')) AS df, count(*) FILTER (p_brand = 'Brand#3') AS db FROM part)
    SELECT p_partkey AS doc_id, -4::BIGINT AS variant, p_brand AS brand,
      round(2 * ln(1 + (n - df + 0.5) / (df + 0.5)) + CASE WHEN p_brand = 'Brand#3' THEN 1.5 * ln(1 + (n - db + 0.5) / (db + 0.5)) ELSE 0 END, 6) AS score
    FROM part, n WHERE p_name IN ('red ring', 'ring red')"""
)
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search.ProductQuery(types=(("red", 1), ("ring", 1), ("red + ring", 2), ("red + unicorn", 2)), attributes=(("brand", "brand#3"),), words=("red", "ring"))
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("brand"))
    return _found_parts(spark, sf_dir, asked).join(part, "doc_id").select("doc_id", F.col("variant").cast("long").alias("variant"), "brand", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_TYPE_SQL}, i AS (SELECT p_partkey, type_key, count(*) AS tf FROM ty GROUP BY ALL), f AS (SELECT type_key, count(*) AS df FROM i GROUP BY 1)
    SELECT p_partkey AS doc_id, -1::BIGINT AS variant,
      round(sum(2 * ln(1 + ((SELECT count(*) FROM part) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 6) AS score
    FROM i JOIN f USING (type_key) WHERE type_key IN ('red', 'blue') GROUP BY p_partkey"""
)
def product_search_any_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search.ProductQuery(types=(("red", 1), ("blue", 1)))
    return _found_parts(spark, sf_dir, asked).select("doc_id", F.col("variant").cast("long").alias("variant"), F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS doc_id, 2::BIGINT AS variant, 2.0::DOUBLE AS score FROM part WHERE (split_part(p_name, ' ', 1) LIKE 're%' OR split_part(p_name, ' ', 2) LIKE 're%') AND (split_part(p_name, ' ', 1) LIKE 'ri%' OR split_part(p_name, ' ', 2) LIKE 'ri%')")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search.ProductQuery(words=("re", "ri"))
    return _found_parts(spark, sf_dir, asked).select("doc_id", F.col("variant").cast("long").alias("variant"), "score")


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'unicorn' ELSE 'red,unicorn' END AS missing FROM part")
def not_matched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(F.lit("red"), F.lit("unicorn"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(search.not_matched(asked, F.split("p_name", " ")), ",").alias("missing"))


# -- deep trees, wide types, look-ups


@query(
    """WITH RECURSIVE t AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 90 = 7 THEN -1 ELSE s_suppkey - 1 END AS parent FROM supplier),
    p AS (SELECT id, id AS ancestor, 0 AS depth FROM t UNION ALL SELECT p.id, t.parent, depth + 1 FROM p JOIN t ON p.ancestor = t.id WHERE t.parent IN (SELECT id FROM t))
    SELECT * FROM p"""
)
def deep_category_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in chains of 90."""
    k = F.col("s_suppkey")
    return categories.closure(_t(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 90 == 7, -1).otherwise(k - 1).alias("parent_id")))


_WIDE_SQL = """
wide AS (SELECT DISTINCT list_aggregate(list_sort(f), 'string_agg', ' + ') AS type_key, list_sort(f) AS forms FROM (
  SELECT unnest([[a], [a, b], [b, c], [a, b, c], [a, b, c, d], [a, c, d, e], [a, b, c, d, e]]) AS f FROM (
    SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_brand AS c, 's' || p_size % 3 AS d, p_type AS e FROM part)))
"""


def _wide_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of one to five forms: words, brand, size and kind of a part."""
    w = F.split("p_name", " ")
    a, b, c, d, e = w[0], w[1], F.col("p_brand"), F.concat(F.lit("s"), F.col("p_size") % 3), F.col("p_type")
    sets = F.array(F.array(a), F.array(a, b), F.array(b, c), F.array(a, b, c), F.array(a, b, c, d), F.array(a, c, d, e), F.array(a, b, c, d, e))
    return _t(spark, sf_dir, "part").select(F.explode(sets).alias("f")).select(text.type_key(F.col("f")).alias("type_key"), F.array_sort("f").alias("forms")).distinct()


_WIDE_EDGES = f"""{_WIDE_SQL}, u AS (SELECT type_key, unnest(forms) AS form FROM wide),
m AS (SELECT x.type_key AS a, y.type_key AS b, count(*) AS n FROM u x JOIN u y USING (form) WHERE x.type_key <> y.type_key GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN wide ON wide.type_key = m.a WHERE n = len(forms))"""


@query(f"WITH {_WIDE_EDGES} SELECT a, b, 'contains' AS rel FROM e UNION ALL SELECT b, a, 'subset_of' FROM e")
def wide_type_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.containment(_wide_types(spark, sf_dir)).select("a", "b", "rel")


@query(f"WITH {_WIDE_EDGES} SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.b = y.a WHERE x.a = e.a AND y.b = e.b)")
def wide_type_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.children(stored(relations.containment(_wide_types(spark, sf_dir)), "edges"))


@query(f"WITH {_WIDE_EDGES} SELECT DISTINCT split_part(p_name, ' ', 2) AS type_key FROM part WHERE split_part(p_name, ' ', 2) IN (SELECT type_key FROM wide) AND split_part(p_name, ' ', 2) NOT IN (SELECT b FROM e) UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE split_part(p_name, ' ', 1) NOT IN (SELECT b FROM e)")
def root_type_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _wide_types(spark, sf_dir)
    asked = _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("type_key")).distinct()
    return relations.has_types(asked, types, relations.containment(types))


@query(f"""WITH {_CONTAINS_SQL.removeprefix("WITH ")}, q AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS type_key FROM part)
SELECT id, type_key, type_key AS b, 'identical' AS rel FROM q UNION ALL SELECT id, type_key, e.b, 'contains' FROM q JOIN e ON e.a = type_key""")
def type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each name, looked up: itself and what it contains (no other is as similar as 0.97)."""
    types, word = stored(_types(spark, sf_dir).select("type_key", "forms"), "types"), F.split("p_name", " ")[0]
    parsed = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), word.alias("type_key"), F.array(word).alias("forms"))
    return relations.looked_up(parsed, types, stored(relations.containment(types), "edges"), least=0.97).select("id", "type_key", "b", "rel")


@query(
    """WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
    x AS (SELECT a || ' ' || b AS t, b || ' ' || a AS o, a, b FROM n)
    SELECT t AS a, o AS b, 'equals' AS rel FROM x WHERE t <> o UNION SELECT o, t, 'equals' FROM x WHERE t <> o
    UNION SELECT a, t, 'contains' FROM x WHERE a <> b UNION SELECT b, t, 'contains' FROM x WHERE a <> b UNION SELECT a, o, 'contains' FROM x WHERE a <> b UNION SELECT b, o, 'contains' FROM x WHERE a <> b
    UNION SELECT t, a, 'subset_of' FROM x WHERE a <> b UNION SELECT t, b, 'subset_of' FROM x WHERE a <> b UNION SELECT o, a, 'subset_of' FROM x WHERE a <> b UNION SELECT o, b, 'subset_of' FROM x WHERE a <> b"""
)
def equal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in both orders of their words are equal types, and each word contains both."""
    w = F.split("p_name", " ")
    texts = _t(spark, sf_dir, "part").select(F.explode(F.array(w[0], w[1], F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[0]))).alias("type_text")).distinct()
    texts = texts.withColumn("type_key", text.type_key(F.split("type_text", " ")))
    types = texts.select("type_key").distinct().withColumn("forms", F.split("type_key", r" \+ "))
    return relations.spelled_out(texts, relations.containment(types)).select("a", "b", "rel")


@query("SELECT p_type AS manufacturer, p_brand AS brand, o AS other FROM (SELECT DISTINCT p_type, p_brand FROM part) JOIN (SELECT DISTINCT p_type AS o, p_brand FROM part) USING (p_brand) WHERE p_type <> o")
def linked_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_type").alias("manufacturers"))
    return reports.linked_makers(owned.withColumn("no_brand", F.lit(False)))


# -- manufacturers in names


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of which every second has a maker's name in its own, and every third the maker as a value."""
    even, third = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    sqn = F.when(even, F.concat(F.split("p_name", " ")[0], F.lit(" рога "), F.split("p_name", " ")[1])).otherwise(F.col("p_name"))
    brand = F.when(F.col("p_size") % 5 == 0, F.lit("Не Бренд")).otherwise(F.col("p_brand"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sqn.alias("sqn"), brand.alias("brand"), F.when(third, F.lit('ООО "Рога"')).alias("manufacturer"), F.lit(False).alias("brand_detected"))


def _makers_registry(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("Не Бренд", None, True, None, "", 'ЗАО "Рога"', ""), ("Red", "marketing", None, None, "", "", "")], "name string, type string, no_brand boolean, generic string, synonyms string, manufacturers string, linked string")
    return brands.registered(rows.select("name", "type", "no_brand", "generic", *[text.split_list(F.col(c)).alias(c) for c in ("synonyms", "manufacturers", "linked")]))


_MADE_SQL = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND NOT ({0}) THEN split_part(p_name, ' ', 1) || ' рога ' || split_part(p_name, ' ', 2) ELSE p_name END AS sqn, p_size % 2 = 0 AND ({0}) AS brand_detected FROM part"


@query(_MADE_SQL.format("p_size % 3 = 0 AND p_size % 5 <> 0"))
def makers_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maker that a product names goes out of its short name, unless it is the product's brand."""
    return products.without_makers(_made(spark, sf_dir), _makers_registry(spark)).select("id", "sqn", "brand_detected")


@query(_MADE_SQL.format("p_size % 3 <> 0 AND p_size % 5 = 0"))
def no_brand_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers of no-brands go out of the names of products that have neither brand nor maker."""
    return products.without_unknown_makers(_made(spark, sf_dir), _makers_registry(spark)).select("id", "sqn", "brand_detected")


@query("SELECT p_partkey AS id, 'Red' AS guess, split_part(p_name, ' ', 2) AS sqn FROM part WHERE split_part(p_name, ' ', 1) = 'red' AND p_size % 2 = 1 UNION ALL SELECT p_partkey, 'Red', 'рога ' || split_part(p_name, ' ', 2) FROM part WHERE split_part(p_name, ' ', 1) = 'red' AND p_size % 2 = 0")
def brand_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.guessed(_made(spark, sf_dir), _makers_registry(spark)).select("id", "guess", "sqn")


@query("SELECT * FROM (VALUES ('ООО \"Рога\"', 'не бренд')) t(maker, key)")
def makers_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    makers = spark.createDataFrame([('ООО "Рога"',), ("Копыта",)], "maker string")
    return brands.makers_brands(makers, _makers_registry(spark))


# -- words


@query("SELECT DISTINCT translate(w, 'e', 'ё') AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w IN (SELECT split_part(p_name, ' ', 1) FROM part)")
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words written with ё that a lexicon has with е."""
    part = _t(spark, sf_dir, "part")
    words = part.select(F.explode(F.split(F.translate("p_name", "e", "ё"), " ")).alias("word")).distinct()
    return morphology.known_words(words, part.select(F.translate(F.split("p_name", " ")[0], "e", "е").alias("word")))


@query(
    f"""WITH a AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+(?:\\.?[\\p{{L}}\\p{{N}}_]+)*'), lambda x: length(x) > 1 AND NOT list_contains({list(morphology.STOP_WORDS)!r}, x)) AS t FROM documents)
    SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS terms FROM a"""
)
def analyzed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index terms of the documents: tokens in lower case, without stop words, stemmed (only Russian words have stems)."""
    rows = _documents(spark, sf_dir).withColumn("t", morphology.analyzed_column(F.col("text")))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("terms"))


_PARSED = [
    ("шок", [("NOUN", [], 0.9, "шок", "шок")]),
    ("молочного", [("ADJF", [], 0.8, "молочный", "молочный"), ("NOUN", ["Surn"], 0.9, "молочного", None)]),
    ("конфеты", [("NOUN", [], 0.7, "конфета", "конфета"), ("NOUN", ["Pltm"], 0.7, "конфеты", "конфеты")]),
    ("котика", [("NOUN", ["Geox"], 0.5, "котика", None), ("NOUN", [], 0.5, "котик", "котик")]),
    ("печёная", [("PRTF", [], 0.4, "печь", "печёный")]),
    ("абвгд", [("VERB", [], 0.1, "абвгда", None)]),
]
_NORMAL = [("шок", "шок"), ("молочного", "молоко"), ("конфеты", "конфеты"), ("котика", "кошка"), ("печёная", "печёный"), ("абвгд", "абвгд")]


@query(f"SELECT * FROM {_values(_NORMAL, 'word', 'form')}")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parses of words to the forms by which types know them."""
    lexicon = files.word_forms(spark.createDataFrame([("молочный~noun:молоко|молочище",), ("котик~same:кот",), ("кот~same:кошка",)], "value string"))
    known = spark.createDataFrame([(w,) for w in ("шок", "молочный", "конфета", "конфеты", "котик", "печеный")], "word string")
    return morphology.normal_forms(spark.createDataFrame(_PARSED, f"word string, parses {morphology.PARSES}"), lexicon, known)


# -- graphs and dictionaries on disk


@query(f"{_CONTAINS_SQL} SELECT a, b, 'contains' AS rel FROM e UNION ALL SELECT b, a, 'subset_of' FROM e")
def graph_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as JSON lines, read back, written in the compact form and loaded from there."""
    types = _types(spark, sf_dir)
    listed = types.select(F.col("type_key").alias("type_text"), F.col("breadth").cast("int").alias("own"), F.lit(None).cast("int").alias("under"))
    path = shared_path(spark, "graph")
    files.write_type_graph(listed, relations.containment(types), f"{path}/json")
    again, edges = files.load_type_graph(spark, f"{path}/json")
    files.dump_terms(again, f"{path}/dictionary")
    terms = files.load_terms(spark, f"{path}/dictionary")
    files.write_compact_graph(again, edges, terms, f"{path}/compact")
    return files.load_type_graph(spark, f"{path}/json", f"{path}/compact", terms)[1].select("a", "b", "rel")


@query(
    """WITH o AS (SELECT term, row_number() OVER (ORDER BY term) AS term_id FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS term FROM part)),
    n AS (SELECT term, row_number() OVER (ORDER BY term) + (SELECT count(*) FROM o) AS term_id FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part) WHERE term NOT IN (SELECT term FROM o))
    SELECT term_id::INT AS term_id, term FROM o UNION ALL SELECT term_id::INT, term FROM n"""
)
def stable_term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a second build are numbered on from those of the first, which keep their ids."""
    w = F.split("p_name", " ")
    part = _t(spark, sf_dir, "part")
    first = stored(files.term_dictionary(part.select(F.array(w[1]).alias("terms"))), "terms")
    return files.term_dictionary(part.select(F.array(w[0], w[1]).alias("terms")), first)


# -- files and pages


@query("SELECT p_partkey::VARCHAR AS raw_id, p_name AS sqn, p_brand AS brand, p_size % 2 = 0 AS brand_detected, list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', '|') AS tags FROM part")
def meta_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("raw_id"), F.col("p_name").alias("sqn"), F.col("p_brand").alias("brand"), (F.col("p_size") % 2 == 0).alias("brand_detected"),
        F.lit(None).cast("string").alias("product_manufacturer"), none.alias("weight"), none.alias("fat"), none.alias("pack"), F.col("p_name").alias("pfqn"),
        F.split("p_name", " ").alias("tags"), F.array(F.split("p_name", " ")).alias("types"),
    )
    path = shared_path(spark, "meta")
    files.write_meta_products(rows, path)
    back = files.meta_products(spark, path)
    return back.select("raw_id", "sqn", "brand", "brand_detected", F.array_join("tags", "|").alias("tags"))


_GRAPH = """{ // types
"красный": ["3", "contains красный + мяч"],
"красный + мяч": ["1/2", "subset_of красный", "similar[0.90]~ красный + меч"], /* soft */
"красный + меч": ["1", "similar[0.90]~ красный + мяч"]}"""


@query("SELECT * FROM (VALUES ('красный', '3;contains красный + мяч'), ('красный + мяч', '1/2;similar[0.90]~ красный + меч;subset_of красный'), ('красный + меч', '1;similar[0.90]~ красный + мяч')) t(type_text, entries)")
def type_graph_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    types, edges = files.type_graph(spark, _GRAPH)
    return files.graph_lines(types, edges).select("type_text", F.array_join("entries", ";").alias("entries"))


@query(
    r"""
    WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>') AS m FROM pages),
    b AS (SELECT page_id, url, m, unnest(range(1, len(m) + 1)) AS k FROM a),
    c AS (SELECT page_id, url, (k - 1)::INT AS n, replace(regexp_extract(m[k], 'href="([^"]*)"', 1), '&amp;', '&') AS href, replace(regexp_extract(m[k], '>([^<]*)</a>', 1), '&amp;', '&') AS text FROM b)
    SELECT page_id, n, href, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END AS resolved, text FROM c
    """
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_t(spark, sf_dir, "pages"), html.links)


@query(
    r"""
    WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*"[^>]*>[^<]*</a>') AS m FROM pages),
    b AS (SELECT page_id, url, m, unnest(range(1, len(m) + 1)) AS k FROM a),
    c AS (SELECT page_id, url, (k - 1)::INT AS n, replace(regexp_extract(m[k], 'href="([^"]*)"', 1), '&amp;', '&') AS href, replace(regexp_extract(m[k], '>([^<]*)</a>', 1), '&amp;', '&') AS title FROM b)
    SELECT page_id, n, title, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END AS link, NULL AS parent, 0 AS level FROM c
    """
)
def html_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_t(spark, sf_dir, "pages"), html.categories)


_GRID = """<ul><li><div id="entitledItem_1">{"catentry_id" : "77",}</div><div class="product x"><div class="image"><img src="/i.png"></div>
<div class="product_name"><a href="/p/77" title=" Чай зелёный ">Чай</a></div><div class="product_weight"><span>5 г</span></div><span class="price">9,5</span></div></li></ul>
<a href='javascript:show([{pageNumber:"2",pageSize:"72"}])'>2</a><a href='javascript:show([{pageNumber:"2",pageSize:"72"}])'>2</a><a href='javascript:show([{pageNumber:"3",pageSize:"72"}])'>3</a>"""
_PAGE = """<div id="entitledItem_1">{"catentry_id" : "77",}</div><div class="product-info"><h1 class="main_header">Чай зелёный крупный</h1></div>
<div class="product-desc"><table><tr><th>Бренд:</th><td>Лес</td></tr><tr><th>Вес:</th><td>5 г</td></tr><tr><th>Вес:</th><td>6 г</td></tr></table></div>"""
_FOOD = """<h3>Мясо</h3><h4>Колбасы</h4><table><tr><th>Продукт</th><th>Белки</th></tr><tr><td><a href="base/541.php">Буженина</a></td><td>15</td></tr></table>"""


def _shop_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "http://Shop.example/a/", _GRID), (2, "http://Shop.example/p/77", _PAGE), (3, "http://food.example/x/", _FOOD)], "page_id long, url string, html string")


@query("SELECT * FROM (VALUES (2, 'Бренд:', 'Лес'), (2, 'Вес:', '6 г')) t(page_id, key, value)")
def html_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_shop_pages(spark), html.key_values).select("page_id", "key", "value")


@query("SELECT * FROM (VALUES (1, 2, 72, 72), (1, 3, 144, 72)) t(page_id, page, begin, size)")
def html_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_shop_pages(spark), html.paging).select("page_id", "page", "begin", "size")


@query("SELECT '77' AS id, 'Чай зелёный крупный' AS name, '9,5' AS price, '5 г' AS weight, 'http://shop.example/product?id=77' AS link, true AS complete")
def html_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _shop_pages(spark)
    return html.reconciled(html.extract(pages, html.thumbnails), html.extract(pages, html.details)).select("id", "name", "price", "weight", "link", "complete")


@query(
    """SELECT * FROM (VALUES (2, NULL, 'Лес', 'Чай зелёный крупный'), (2, NULL, '5 г', 'Чай зелёный крупный'), (2, NULL, '6 г', 'Чай зелёный крупный'),
    (3, '541', 'Буженина', 'Мясо|Колбасы')) t(page_id, id, name, tags)"""
)
def html_nutrition_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all pages' tables; a table that isn't of nutrition has rows too."""
    rows = html.nutrition_products(html.extract(_shop_pages(spark), html.nutrition))
    return rows.select("page_id", "id", "name", F.array_join("tags", "|").alias("tags"))


@query("SELECT * FROM (VALUES ('котик', 'кот'), ('молочный', 'молоко'), ('котяра', 'котище')) t(word, ref)")
def explanatory_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ["КОТИК, -а. Уменьш. к кот", "", "МОЛОЧНЫЙ прил.", "1. соотн. с сущ. молоко, связанный с ним", "", "КОТЯРА то же, что котище"]
    found = files.articles(spark.createDataFrame(list(enumerate(lines)), "n int, value string"))
    return found.select("word", F.concat_ws(",", "noun_base", "same", "pet").alias("ref"))


@query("SELECT * FROM (VALUES ('кот', 'кошак'), ('котофей', 'кот,кошак'), ('дом', '')) t(word, same)")
def piped_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([("кот|м.|==кошак",), ("котофей|м.|==кошак",), ("дом|м.|",)], "value string")
    return files.piped_dictionary(lines).select("word", F.array_join("same", ",").alias("same"))


# -- streams


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS n FROM events) WHERE n = 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"stream_dedup_{uuid.uuid4().hex}"
    rows = streams.first_wins(streams.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts").select("event_id", "user_id")
    return streams.drained(rows, name, shared_path(spark, name))


@query(
    """
    WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type FROM events), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events)
    SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM e, m WHERE h + INTERVAL 1 HOUR <= mark GROUP BY ALL
    """
)
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours that the watermark has closed."""
    name = f"stream_counts_{uuid.uuid4().hex}"
    rows = streams.counts(streams.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return streams.drained(rows, name, shared_path(spark, name)).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


# -- parts as products: edited queries, views of attributes, fallbacks, sorted hits


@query(
    f"""
    SELECT p_partkey, array_to_string(range(0, len(w)), ' ') AS places,
      array_to_string([CASE WHEN i = 2 THEN 'bolted' ELSE w[i] END FOR i IN range(1, len(w) + 1)], ' ') AS edited
    FROM (SELECT p_partkey, {_WORDS.format('p_name')} AS w FROM part)
    """
)
def edited_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries made of the tokens of names, the second token replaced."""
    items = tokens.requery(tokens.tokens(tokens.DEFAULT.column(F.col("p_name"))))
    return _t(spark, sf_dir, "part").select("p_partkey", items.alias("q")).select(
        "p_partkey",
        F.array_join(F.transform("q", lambda x: x["pos"].cast("string")), " ").alias("places"),
        F.array_join(tokens.texts(tokens.replace_token(F.col("q"), F.lit(1), F.lit("bolted"))), " ").alias("edited"),
    )


@query(
    f"""
    SELECT p_partkey, w[1] AS first, list_min(w) AS least, array_to_string(w, ' + ') AS together, array_to_string(w, ' ') AS spaced
    FROM (SELECT p_partkey, {_WORDS.format("p_name || '|' || p_type")} AS w FROM part)
    """
)
def attribute_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar views of a list of values, and both renderings of a type."""
    w = text.words(F.concat_ws("|", "p_name", "p_type"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", text.any_item(w).alias("first"), text.any_item(w, least=True).alias("least"), text.type_text(w).alias("together"), text.type_text(w, spaced=True).alias("spaced")
    )


@query("SELECT doc_id, md5(replace(text, chr(160), ' ')) AS digest FROM documents")
def breaking_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.no_nbsp(F.col("text"))).alias("digest"))


@query("SELECT p_partkey, p_brand FROM part a WHERE p_size < 10 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = a.p_partkey AND b.p_type = 'PROMO')")
def fallback_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second attempt finds beyond the first."""
    part = _t(spark, sf_dir, "part")
    return dedup.not_returned(part.where("p_size < 10"), part.where("p_type = 'PROMO'"), "p_partkey").select("p_partkey", "p_brand")


@query(
    """
    SELECT 'score' AS sorted_by, doc_id FROM (SELECT p_partkey AS doc_id FROM part ORDER BY p_size DESC, p_partkey LIMIT 10)
    UNION ALL SELECT 'price', doc_id FROM (SELECT p_partkey AS doc_id FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)
    """
)
def sorted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten by score, and by a field that may be sorted by."""
    hits = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("score"), F.col("p_retailprice").alias("price"))
    by = {k: search.top(hits, sort_by=k, sortable=("score", "price")).select(F.lit(k).alias("sorted_by"), "doc_id") for k in ("score", "price")}
    return by["score"].unionByName(by["price"])


@query(f"WITH {_WIDE_EDGES} SELECT a, count(*) AS n FROM e GROUP BY a")
def contained_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many types each type contains, of the relations of one kind."""
    return relations.of_kinds(relations.containment(_wide_types(spark, sf_dir)), "contains").groupBy("a").agg(F.count("*").alias("n"))
