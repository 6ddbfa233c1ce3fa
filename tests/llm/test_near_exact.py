"""The pipeline's near-duplicate stage against exact Jaccard of five-word shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline
from quern.llm import simhash


def shingles(text, words=5):
    tokens = text.lower().split()
    n = min(words, len(tokens))
    return frozenset(" ".join(tokens[k : k + n]) for k in range(len(tokens) - n + 1)) if n else frozenset()


def kept_by_jaccard(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k for k in ids if root(k) == k}


def some_texts():
    """Texts of 1 to 400 words, each with neighbours just over and just under the similarity of 0.8."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3_000)]
    out = ["", "  \n ", "a b", "A  b", "a b c"]
    for size in (1, 4, 5, 7, 8, 9, 10, 12, 13, 16, 20, 24, 30, 50, 90, 200, 400) * 6:
        base = [rng.choice(words) for _ in range(size)]
        out += [" ".join(base), " ".join([*base, "tail"])]
        for share in (0.17, 0.2, 0.22, 0.24, 0.26, 0.3):
            out.append(" ".join([*base, *(rng.choice(words) for _ in range(max(1, round(share * (size - 4)))))]))
            cut = max(1, round(size * share / 2))
            out.append(" ".join([*base[cut:], *(rng.choice(words) for _ in range(cut))]))
    rng.shuffle(out)
    return dict(enumerate(out))


def kept_by_stage(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}


def test_stage_is_exact(spark):
    texts = some_texts()
    assert kept_by_stage(spark, texts) == kept_by_jaccard(texts)


def test_stage_is_exact_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_TILE", 16)
    monkeypatch.setattr(simhash, "BUCKET", 16)
    monkeypatch.setattr(simhash, "SETS", 3)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = some_texts() | {10_000 + k: " ".join([*base, f"x{k}", f"y{k}"]) for k in range(40)}
    assert kept_by_stage(spark, texts) == kept_by_jaccard(texts)


def test_pairs_at_the_threshold_meet():
    """Of a thousand pairs of sets just at 0.8, all share one of their least hashes."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (4, 5, 9, 20, 45, 90, 200, 900):
        for _ in range(125):
            union = np.unique(rng.integers(0, 2**63, 5 * n, np.uint64))[: 5 * (len(range(n)))]
            rng.shuffle(union)
            a, b = np.sort(union[: 9 * len(union) // 10]), np.sort(union[len(union) // 10 :])
            assert set(simhash._least(a).tolist()) & set(simhash._least(b).tolist())
