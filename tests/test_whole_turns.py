"""Edits of turns beyond their fourth word."""

from __future__ import annotations

from quern.plans.catalogue import QUERIES


def test_edits_beyond_the_fourth_word(spark, tmp_path):
    turns = ["a b c d e f", "a b c d e x", "a b c d e x y", "a b z d q q q", "a b r d s s s"]
    spark.createDataFrame([(1, k, t) for k, t in enumerate(turns)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["turn"]: r["edited"] for r in QUERIES["last_edited_token_whole"](spark, str(tmp_path)).collect()}
    assert found == {0: None, 1: "x", 2: "y", 3: None, 4: None}
