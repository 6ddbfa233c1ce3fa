"""Operators over trees, types and chains of any size, and the pieces that have no registered query."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import morphology
from quern.operators import brands, categories, dedup, relations, reports
from quern.plans.registry import Indexes, Waterfall


def test_a_chain_of_two_hundred_categories(spark):
    tree = spark.createDataFrame([(k, k - 1) for k in range(200)], "id int, parent_id int")
    found = categories.closure(tree)
    assert found.count() == 20_100 and found.agg(F.max("depth")).first()[0] == 199


def test_a_long_cycle_raises(spark):
    tree = spark.createDataFrame([(k, (k + 1) % 100) for k in range(100)], "id int, parent_id int")
    with pytest.raises(Exception, match="cycle"):
        categories.closure(tree).collect()


def test_types_of_many_forms(spark):
    forms = [f"f{k:02d}" for k in range(12)]
    rows = [(" + ".join(f), f) for f in (forms, forms[:11], forms[3:9], forms[:1], ["x", *forms[:2]])]
    types = spark.createDataFrame([(k, sorted(f)) for k, f in rows], "type_key string, forms array<string>")
    got = {(r["a"], r["b"]) for r in relations.containment(types).where("rel = 'contains'").collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if set(x) < set(y)}


def test_makers_over_many_others(spark, monkeypatch):
    pairs = spark.createDataFrame([(f"m{k:02d}", f"p{k + j}") for k in range(12) for j in (0, 1)] + [("z", "q")], "maker string, p string")
    monkeypatch.setattr(brands, "maker_patterns", lambda makers: pairs)
    got = dict(brands.manufacturer_groups(pairs.select("maker").distinct()).collect())
    assert got == {f"m{k:02d}": "m00" for k in range(12)} | {"z": "z"}


def test_a_maker_of_two_brands_raises(spark):
    rows = [("A", ["Рога"]), ("B", ["рога"])]
    registry = spark.createDataFrame([(n.lower(), n, s, []) for n, s in rows], "key string, name string, synonyms array<string>, manufacturers array<string>")
    with pytest.raises(Exception, match="several brands"):
        brands.makers_brands(spark.createDataFrame([('ООО "Рога"',)], "maker string"), registry).collect()


def test_tails_of_long_types(spark):
    names = spark.createDataFrame([("a b c d e tail",), ("a b c d e other",)], "sqn string")
    types = spark.createDataFrame([("a b c d e",), ("a b",)], "type_text string")
    assert {r["tail"] for r in reports.sqn_tails(names, types, 1).collect()} == {"tail", "other"}


def test_pages_and_limits_without_groups(spark):
    rows = spark.createDataFrame([(k, k * 7 % 23) for k in range(60)], "id int, score int")
    due = sorted(((k * 7 % 23, k) for k in range(60)), key=lambda x: (-x[0], x[1]))
    got = {r["id"]: r["page"] for r in dedup.in_chunks(rows, [F.desc("score"), F.col("id")], 7).collect()}
    assert got == {k: n // 7 for n, (_, k) in enumerate(due)}
    top = {(r["id"], r["rank"]) for r in dedup.group_limit(rows, 3, "score").collect()}
    assert top == {(k, 23 - s) for s, k in due if s >= 20}


def test_choice_of_a_parse(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        parses = [(rng.choice(["NOUN", "ADJF", "PRTF", "VERB"]), [t for t in ("Surn", "Geox", "Pltm") if rng.random() < 0.25], rng.choice([0.5, 0.9]), rng.choice(["w", "n"]), str(j)) for j in range(rng.randrange(1, 6))]
        rows.append((k, "w", parses))

    def plain(word, parses):
        held = None
        for p in parses:
            pos, tags, score, normal, _ = p
            if pos not in morphology.NOMINAL or "Surn" in tags:
                continue
            if held is None:
                held = p
            elif score >= held[2] and any([held[0] != "NOUN" and pos == "NOUN", "Geox" in held[1] and "Geox" not in tags, pos == "NOUN" and "Pltm" in tags, held[3] != word and normal == word]):
                held = p
        return (held or parses[0])[4]

    df = spark.createDataFrame(rows, f"id int, word string, parses {morphology.PARSES}")
    got = {r["id"]: r["i"] for r in df.select("id", morphology.chosen_parse(F.col("word"), F.col("parses"))["inflected"].alias("i")).collect()}
    assert got == {k: plain(w, p) for k, w, p in rows}


def test_registered_indexes(spark, tmp_path):
    calls = []

    def build(source):
        calls.append(1)
        return source.select("x")

    indexes = Indexes(spark, str(tmp_path))
    indexes.register("one", build)
    with pytest.raises(ValueError, match="there is an index"):
        indexes.register("one", build)
    source = spark.createDataFrame([(1,)], "x int")
    assert indexes.open("one", source).count() == 1 and indexes.open("one", source).count() == 1 and len(calls) == 1
    indexes.open("one", source.withColumn("y", F.lit(1)))
    assert len(calls) == 2
    with pytest.raises(ValueError, match="stale"):
        indexes.open("one", spark.createDataFrame([(9,)], "x int"), readonly=True)


def test_added_variants(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, score int")
    rare = Waterfall().added(lambda i, q: i.where(F.col("score") > q)).added(lambda i, q: i)
    assert {(r["doc_id"], r["variant"]) for r in rare.find(index, 1).collect()} == {("b", 0)}
    assert {(r["doc_id"], r["variant"]) for r in rare.find(index, 5).collect()} == {("a", 1), ("b", 1)}


def test_analyzer_with_a_dictionary():
    from quern.functions.terms import Terms

    assert morphology.analyzed("Молочные конфеты и ШОК. v2.0", Terms({"молочные": "молочный"})) == [morphology.stem(t) for t in ("молочные", "конфеты", "шок", "v2.0", "молочный", "шоколадный")]
