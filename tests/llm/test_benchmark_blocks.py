"""A benchmark of several blocks gives what one automaton gives, and each worker builds each automaton once."""

from __future__ import annotations

import random

import pyarrow as pa

from quern.llm import decontamination

ITEMS = "item_id string, text string"


def tables(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(60)]
    texts = [" ".join([*(rng.choice(words) for _ in range(5)), rng.choice(items)[1], rng.choice(words), rng.choice(items)[1][:40]]) for _ in range(80)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, ITEMS)


def test_blocks_find_what_one_automaton_finds(spark, monkeypatch):
    docs, items = tables(spark)

    def judged(**options):
        return sorted((r["row"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), tuple(map(tuple, r["spans"]))) for r in decontamination.decontaminate(docs, items, width=4, **options).collect())

    one = judged()
    assert sum(x[2] > 0 for x in one) > 40
    assert judged(block_words=800) == one
    monkeypatch.setattr(decontamination, "DIGITS", 3)
    assert judged() == one


def test_a_worker_builds_an_automaton_once(spark):
    docs, items = tables(spark)
    from quern.llm.common import Shelf, prepare

    prepare(spark)
    nodes = decontamination._table(items, 4, "item_id", "text").count() * 4
    blocks = list(decontamination._blocks(items, 4, "item_id", "text", -(-nodes // 3), Shelf(spark, "test")))
    assert len(blocks) == 3
    decontamination._automaton.cache_clear()
    batch = pa.array(["w1 w2 w3 w4 w5 w6"] * 10)
    for block, names in blocks:
        for _ in range(5):
            decontamination._scan(decontamination.utf8(batch), block, names)
    assert decontamination._automaton.cache_info().misses == 3
