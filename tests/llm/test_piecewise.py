"""Fingerprints and likeness against plain loops over their definition, and ranges of ids of any type."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from quern.llm import fuzzy

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MASK = 2**32 - 1


def rolled(data, at):
    h = 0
    for k in range(at - 6, at + 1):
        h = (h * 0x01000193 + (data[k] + 1 if k >= 0 else 0)) & MASK
    h ^= h >> 15
    h = h * 0x2C1B3C6D & MASK
    return h ^ h >> 13


def letter(chunk):
    h, power = 0, 1
    for byte in chunk:
        h = (h + (byte + 1) * power) & MASK
        power = power * 0x9E3779B1 & MASK
    h ^= h >> 16
    return LETTERS[(h * 0x7FEB352D & MASK) >> 26]


def signature(data, ends):
    chunks, begin = [], 0
    for end in ends:
        chunks.append(data[begin : end + 1])
        begin = end + 1
    if begin < len(data):
        chunks.append(data[begin:])
    if len(chunks) > 64:
        chunks[63:] = [b"".join(chunks[63:])]
    return "".join(letter(c) for c in chunks)


def plain_fingerprint(data):
    roll = [rolled(data, k) for k in range(len(data))]
    block = 3
    while block * 64 < len(data):
        block *= 2
    while True:
        ends = [k for k, r in enumerate(roll) if r % block == block - 1]
        if block == 3 or len(ends) >= 32:
            break
        block //= 2
    return f"{block}:{signature(data, ends)}:{signature(data, [k for k in ends if roll[k] % (2 * block) == 2 * block - 1])}"


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] if x == y else 1 + min(last[j], row[-1]))
    return row[-1]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (x, *one), (y, *two) = a.split(":"), b.split(":")
    sizes = [{int(x): one[0], 2 * int(x): one[1]}, {int(y): two[0], 2 * int(y): two[1]}]
    best = 0.0
    for size in sizes[0].keys() & sizes[1].keys():
        p, q = sizes[0][size], sizes[1][size]
        run = min(7, len(p), len(q))
        if not run:
            continue
        if any(p[k : k + run] in q for k in range(len(p) - run + 1)):
            best = max(best, 1 - plain_edits(p, q) / (len(p) + len(q)))
    return best


def some_texts():
    rng = random.Random(11)
    out = [b"", b"a", b"abc" * 50, b"\n" * 900]
    for size in (5, 40, 200, 700, 3_000, 9_000):
        for _ in range(4):
            text = bytes(rng.choice(b"abcdefgh ,.\xc3\xa9") for _ in range(size))
            at = rng.randrange(size)
            out += [text, text[:at] + b"inserted" + text[at:], text[: size // 2] + bytes(rng.choice(b"xyz ") for _ in range(size // 2))]
    return out


def test_fingerprints_against_loops():
    assert [fuzzy.fingerprint(t) for t in some_texts()] == [plain_fingerprint(t) for t in some_texts()]


def test_likeness_against_a_table_of_edits():
    marks = [fuzzy.fingerprint(t) for t in some_texts()]
    found = [(fuzzy.likeness(a, b), plain_likeness(a, b)) for a in marks for b in marks]
    assert [x for x, _ in found] == pytest.approx([y for _, y in found])
    assert sum(0 < x < 1 for x, _ in found) > 40


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hot_and_null_ids_over_ranges(spark, monkeypatch, kind):
    """Every row meets the next of the order (falling id, then the text's hash), over many ranges."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fuzzy, "RANGE_ROWS", 7)
    rng = random.Random(5)
    ids = [None if rng.random() < 0.2 else 5 if rng.random() < 0.3 else rng.randrange(60) for _ in range(150)]
    rows = [(i if i is None or kind == "long" else f"k{i:02d}", f"text {k} " + rng.choice("abc") * 30) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    ties = dict(docs.select("text", F.xxhash64("text")).collect())
    order = sorted(rows, key=lambda r: ties[r[1]])
    order.sort(key=lambda r: (r[0] is not None, r[0] or type(r[0])()) if r[0] is not None else (False,), reverse=True)
    expected = Counter()
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        expected[(i, fuzzy.fingerprint(text.encode()), fuzzy.likeness(fuzzy.fingerprint(text.encode()), fuzzy.fingerprint(after.encode())))] += 1
    got = Counter((r["id"], r["fingerprint"], r["near_next"]) for r in fuzzy.with_next(docs).collect())
    assert got == expected
