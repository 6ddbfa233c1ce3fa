"""What one task holds does not grow with the rows that it reads."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import morphology, text
from quern.operators import relations, search
from quern.plans import catalogue


def test_terms_of_many_long_texts(monkeypatch):
    monkeypatch.setattr(morphology.F, "arrow_udf", lambda _: lambda f: f)
    words = [f"слово{k}" for k in range(2000)]

    def batches():
        rng = random.Random(3)
        for _ in range(20):
            yield pa.array([None, *(" ".join(rng.sample(words, 800)) for _ in range(49))])

    tracemalloc.start()
    n = sum(sum(map(len, some.to_pylist())) for some in morphology.analyzed_column(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20 * 49 * 800 and peak < 20e6


def test_terms_of_any_words():
    text = "Молочные ЁЛКИ и the Straße " + "молочного" * 10
    assert morphology.analyzed(text) == [morphology.stem(t) for t in text.lower().split() if t != "и"]


def test_relations_are_found_by_type_before_ids_meet_them(spark):
    types = spark.createDataFrame([("красный мяч", ["красный мяч"]), ("красный меч", ["красный меч"])], "type_key string, forms array<string>")
    edges = relations.similar(types)
    parsed = spark.createDataFrame([(1, "красный мяч", ["красный мяч"]), (1, "красный мяч", ["красный мяч"]), (None, "красный мяч", ["красный мяч"])], "id int, type_key string, forms array<string>")
    found = relations.looked_up(parsed, types, edges)
    got = sorted((str(r["id"]), r["b"], r["rel"]) for r in found.collect())
    assert got == sorted((k, b, rel) for k in ("1", "None") for b, rel in (("красный мяч", "identical"), ("красный меч", "similar")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1  # distinct pairs of id and type


def test_postings_of_single_rows_are_not_shuffled(spark):
    docs = [(1, ["b", "a", "b", None, None]), (2, []), (3, None), (4, ["a"])]
    many = [*docs, (4, ["a", "c"]), (None, ["x"]), (None, ["x", "y"])]
    for rows, moved in ((docs, 0), (many, 1)):
        found = search.postings(spark.createDataFrame(rows, "id int, t array<string>"), "id", {"f": F.col("t"), "g": F.array(F.lit("a"))})
        due = Counter((k, f, x) for k, t in rows for f, terms in (("f", t or []), ("g", ["a"])) for x in terms)
        assert {(r["doc_id"], r["field"], r["term"]): r["tf"] for r in found.collect()} == due and found.count() == len(due)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == moved


def test_hits_of_a_term_are_not_gathered_by_it(spark):
    index = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("f").alias("field"), F.lit("a").alias("term"), F.lit(1).cast("long").alias("tf"), F.lit(1).alias("len"))
    asked = spark.createDataFrame([(0, "f", "a", 1.0)], "query_id int, field string, term string, boost double")
    plan = search.scored(index, asked)._jdf.queryExecution().sparkPlan().toString()
    assert search.scored(index, asked).count() == 50 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_a_search_prunes_postings_where_they_are_read(spark):
    index = spark.createDataFrame([(k, "f", t, 1, 2) for k in range(50) for t in ("ab", "b")], "doc_id int, field string, term string, tf long, len int")
    asked = spark.createDataFrame([(0, "f", "ab", 1.0)], "query_id int, field string, term string, boost double")
    prefixes = spark.createDataFrame([(0, "f", "a")], "query_id int, field string, prefix string")
    types = search.ProductQuery(types=(("ab", 1), ("c", 1)))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of unknown size
    try:
        for found, n in ((search.scored(index, asked), 50), (search.by_prefix(index, prefixes), 50), (search.known_types(types, index.withColumn("field", F.lit("types"))), 1)):
            assert found.count() == n and "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_any_type_counts_rows_that_share_an_id(spark, tmp_path):
    names = [(1, "red ring"), (1, "red ring"), (1, "red ring"), (2, "blue bolt"), (3, "cold red"), (4, "tin can")]
    spark.createDataFrame([(k, n, "Brand#1") for k, n in names], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["doc_id"]: r["score"] for r in catalogue.QUERIES["product_search_any_type"](spark, str(tmp_path)).collect()}
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == {k: score for k, _, score in duckdb.sql(catalogue.ORACLES["product_search_any_type"]).fetchall()} and set(got) == {1, 2, 3}


def test_words_end_at_the_separators_and_nowhere_else(spark):
    codes = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(F.col("id").alias("c"), F.expr("decode(unhex(concat(lpad(hex(id), 4, '0'))), 'UTF-16BE')").alias("t"))
    found = codes.select("c", F.size(text.words(F.concat(F.lit("a"), "t", "t", F.lit("b")))).alias("n"), F.col("t").rlike(f"[{text.SEPARATORS}]").alias("ends"))
    assert found.where((F.col("n") == 2) != F.col("ends")).count() == 0 and found.where("ends").count() == 39
