"""The label model's and the classifier's steps against plain loops, and how many keys one more shard moves."""

from __future__ import annotations

import math

import numpy as np

from quern.llm import sharding, toxicity


def test_one_round_of_the_label_model():
    rng = np.random.default_rng(3)
    fires = rng.random((300, 6)) < 0.3
    fires[:, 1] = fires[:, 0] ^ (rng.random(300) < 0.1)
    start = rng.random(300)
    model = toxicity.LabelModel(fires, start, free=2, rounds=1)
    r = [min(0.95, max(0.05, x)) for x in start]
    prior = min(1 - 1e-4, max(1e-4, sum(r) / 300))
    # the parents are a tree over the four tied voters: one root, no circle; the free ones have none
    assert [model.parent[v] for v in (4, 5)] == [-1, -1] and sum(model.parent[v] == -1 for v in range(4)) == 1
    assert 0 in (model.parent[1], model.parent[model.parent[1]]) or model.parent[0] == 1
    for v in range(6):
        above = [model.parent[v] >= 0 and fires[k, model.parent[v]] for k in range(300)]
        on, off = (sum(w for k, w in enumerate(some) if fires[k, v] and not above[k]) for some in (r, [1 - x for x in r]))
        assert math.isclose(model.alone[v], math.log((on + 2 * prior) / (off + 2 * (1 - prior))) - math.log(prior / (1 - prior)))
        shares = []
        for some in (r, [1 - x for x in r]):
            both, parent = sum(w for k, w in enumerate(some) if fires[k, v] and above[k]), sum(w for k, w in enumerate(some) if above[k])
            shares.append((both + 1) / (parent + 2))
        assert math.isclose(model.beside[v], math.log(shares[0] / shares[1]))
    for k in range(300):
        odds = math.log(prior / (1 - prior))
        for v in range(6):
            if fires[k, v]:
                odds += model.beside[v] if model.parent[v] >= 0 and fires[k, model.parent[v]] else model.alone[v]
        assert math.isclose(model.posterior[k], 1 / (1 + math.exp(-odds)), rel_tol=1e-9)


def test_the_classifier_is_at_its_optimum():
    """Where the penalised likelihood is greatest, its slopes are nothing."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(400)]
    target = np.array([0.9 if 2 in x or (5 in x and 7 in x) else 0.1 for x in rows])
    weights, intercept = toxicity.logistic(rows, target, 12)
    p = [1 / (1 + math.exp(-(intercept + sum(weights[t] for t in x)))) for x in rows]
    assert abs(sum(a - b for a, b in zip(p, target, strict=True))) / 400 < 1e-3
    for t in range(12):
        slope = sum(a - b for a, b, x in zip(p, target, rows, strict=True) if t in x) + 0.3 * weights[t]
        assert abs(slope) < 0.5
    assert weights.argmax() == 2


def test_one_more_shard_moves_few_keys(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6_000)], "doc_id long, text string")

    def placed(shards, slack):
        return {r["id"]: r["shard"] for r in sharding.shard(docs, shards, slack=slack).collect()}

    for slack, most_moved, most_between in ((0.25, 0.08, 0.005), (0.0, 0.12, 0.05)):
        before, after = placed(16, slack), placed(17, slack)
        moved = [k for k in before if before[k] != after[k]]
        assert len(moved) <= most_moved * 6_000  # a 17th is the least
        assert sum(after[k] < 16 for k in moved) <= most_between * 6_000
