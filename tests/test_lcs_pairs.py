"""Likeness of different names, against a plain table of common lengths."""

from __future__ import annotations

import pytest

from quern.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_ratios_of_different_names(spark):
    names = sorted(r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct().collect())
    expected = {(a, b): 2 * plain_common(a, b) / (len(a) + len(b)) for a in names for b in names if a < b and set(a.split(" ")) & set(b.split(" "))}
    found = {(r["a"], r["b"]): r["ratio"] for r in QUERIES["lcs_ratio_pairs"](spark, SF).collect()}
    assert found == pytest.approx(expected)
    assert expected and max(expected.values()) < 1
