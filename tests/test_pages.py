"""Pages of every brand's list."""

from __future__ import annotations

from collections import defaultdict

from quern.plans.catalogue import QUERIES


def test_every_brand_is_paged(spark, tmp_path):
    rows = [(k, f"Brand#{k % 3}", float(k * 7 % 11)) for k in range(75)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lists = defaultdict(list)
    for k, brand, price in sorted(rows, key=lambda r: (-r[2], r[0])):
        lists[brand].append(k)
    expected = {k: (brand, n // 10) for brand, keys in lists.items() for n, k in enumerate(keys)}
    assert {r["p_partkey"]: (r["p_brand"], r["page"]) for r in QUERIES["result_pages_by_brand"](spark, str(tmp_path)).collect()} == expected
