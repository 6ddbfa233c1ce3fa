"""Queries that hand on all rows of their operators."""

from __future__ import annotations

from quern.plans.catalogue import QUERIES


def test_words_only_referred_to_are_there(spark):
    assert ("котофей", "котофей") in {tuple(r) for r in QUERIES["lemma_chains_whole"](spark, "").select("word", "lemma").collect()}


def test_rows_of_every_page(spark):
    assert {r["page_id"] for r in QUERIES["html_nutrition_whole"](spark, "").collect()} == {2, 3}
