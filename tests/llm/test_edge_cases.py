"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quern.llm import decontamination, fuzzy, lines, mixing, ngram_lm, pii, sharding, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, id string, fp string, score string, shard string, slot string, key string, n_hit string, copies string, tie string"


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "été", "ß", "idiot", "1234", "x@y.example.com"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(60))
    extra = ("r", 1, "i", "f", "s", "sh", "sl", "k", "h", "c", "t")
    nulls = (None,) * 11
    return [
        (1, base, "en", "a", 1, *extra),
        (1, base, "en", "a", 1, *extra),  # a repeated row
        (1, base + " other", "en", None, 1, *nulls),  # another text of the same id
        (2, base, None, "b", None, *nulls),
        (3, None, None, None, None, *nulls),
        (4, "", "en", "a", 0, *extra),
        (5, " \t\n ", "en", "a", 4, *extra),
        (None, base, "en", "b", 2, *extra),
        (None, None, None, None, None, *nulls),
        (6, long, "fr", "c", 5, *extra),
        (7, "x" * 200_000, "fr", "c", 5, *extra),
        (8, "one two", "fr", "c", 5, *extra),
        (9, "ein Wort\nein Wort\nzwei\n\nzwei", "de", "c", 5, *extra),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, 1, int(k % 3 == 0)) for k in range(1, 10)] + [(None, 1, 1), (2, None, None), (6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (None, "one two"), (2, None), (3, ""), (4, "!!")], "item_id long, text string")


N = len(odd_rows())


def test_sharding(docs, none):
    found = sharding.shard(docs, shards=4, vnodes=8, carry=True).collect()
    assert len(found) == N
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by_shard.get(k, [])) for k in range(4)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.shard(none, shards=4, vnodes=8).count() == 0


def test_toxicity(docs, none, labels):
    model = toxicity.fit(docs, labels)
    scores = [r["score"] for r in toxicity.score(docs, model).collect()]
    assert len(scores) == N and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels)[0] == {} and toxicity.fit(docs, labels.limit(0))[1] == 0.0


def test_decontamination(docs, none, items):
    found = {(r["row"]["doc_id"], r["row"]["text"]): r for r in decontamination.decontaminate(docs, items).collect()}
    hit = found[(8, "one two")]
    assert (hit["n_words"], hit["n_hit"], hit["item_ids"], [tuple(s) for s in hit["spans"]]) == (2, 2, [""], [(0, 7)])
    assert found[(3, None)]["n_words"] == 0
    assert decontamination.decontaminate(docs, items).count() == N
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks_agrees(docs, items):
    one = sorted(map(str, decontamination.decontaminate(docs, items).select("row.doc_id", "n_hit", "item_ids", "spans").collect()))
    many = sorted(map(str, decontamination.decontaminate(docs, items, block_words=20).select("row.doc_id", "n_hit", "item_ids", "spans").collect()))
    assert one == many


def test_mixing(docs, none):
    found = mixing.mix(docs, carry=True).collect()
    assert len(found) == N and all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in found)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(none).count() == 0


def test_language_model(docs, none):
    found = {r["id"]: r for r in ngram_lm.score(docs).collect()}
    assert ngram_lm.score(docs).count() == N
    assert found[4]["log2_score"] is None and found[4]["n_words"] == 0
    assert ngram_lm.score(none).count() == 0


def test_pii(docs, none):
    found = pii.detect(docs)
    assert found.count() == N and found.where("row.doc_id = 3 AND size(spans) > 0").count() == 0
    assert pii.detect(none).count() == 0


def test_fingerprints(docs, none):
    rows = fuzzy.with_next(docs).collect()
    assert len(rows) == N
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == 0}) == 1
    assert fuzzy.with_next(none).count() == 0
    assert fuzzy.with_next(docs.where("doc_id = 8")).first()["near_next"] == 1.0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs, carry=True).collect()
    assert len(rows) == N
    assert {r["component"] for r in rows if not (r["row"]["text"] or "").split()} == {3}
    assert {r["component"] for r in rows if r["row"]["text"] == rows[0]["row"]["text"]} == {rows[0]["component"]}
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
    texts = [r["row"]["text"] for r in simhash.one_of_each(docs).collect()]
    assert len([t for t in texts if not (t or "").split()]) == 1


def test_substrings(docs, none):
    rows = substrings.dedup(docs, carry=True).collect()
    assert len(rows) == N
    by_id = {r["id"]: r for r in rows if r["id"] not in (1, None)}
    assert by_id[2]["n_removed"] == by_id[2]["n_words"] == 60 and by_id[2]["kept"] == ""
    assert by_id[7]["n_removed"] == 0 and by_id[3]["n_words"] == 0
    assert [r["n_removed"] for r in rows if r["id"] == 1] == [0, 0, 0]  # of one id neither is earlier
    assert substrings.dedup(none).count() == 0


def test_lines(docs, none):
    rows = {r["id"]: r for r in lines.dedup(docs, carry=True).collect()}
    assert rows[9]["n_removed"] == 2 and rows[9]["kept"] == "ein Wort\nzwei\n"
    assert rows[2]["n_removed"] == 1 and rows[2]["kept"] == ""
    assert lines.dedup(docs).count() == N
    assert lines.dedup(none).count() == 0


def test_stages(spark, docs, none, labels, items, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            assert len(set(out.columns)) == len(out.columns), name
            assert set(table.columns) <= set(out.columns)
            assert len(rows) <= 2 * table.count()
