"""Windows of words are told apart whatever their bytes, and ids may be of any type."""

from __future__ import annotations

import random

import pytest

from quern.llm import lines, substrings


def thue_morse(n, flip=0):
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


def kept(spark, rows, kind, **options):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    return sorted(((r["id"], r["kept"]) for r in substrings.dedup(docs, **options).collect()), key=lambda x: (x[0] is None, x))


def test_words_that_polynomials_modulo_powers_of_two_confuse(spark):
    same = " ".join(f"w{k}" for k in range(19))
    rows = [(k, f"{same} {thue_morse(n, flip)}") for k, (n, flip) in enumerate([(1024, 0), (1024, 1), (2048, 0), (2048, 1)])]
    assert kept(spark, rows, "long") == rows
    again = [*rows, (9, rows[1][1])]
    assert kept(spark, again, "long") == [*rows, (9, "")]


def plain(rows, width):
    """Words kept, with every window in a dictionary of word tuples; a null id comes last."""
    def rank(x):
        return (x is None, x if x is not None else 0)

    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - width + 1):
            key, at = tuple(w[k : k + width]), (rank(i), k)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        w = t.split()
        gone = {p for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < (rank(i), k) for p in range(k, k + width)}
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=lambda x: (x[0] is None, x))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_against_tuples_of_words(spark, kind):
    rng = random.Random(kind)
    passages = [[rng.choice("ab cd ef ghi".split()) for _ in range(rng.randrange(2, 14))] for _ in range(8)]
    rows = []
    for k in range(60):
        words = [w for _ in range(4) for w in (rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abcdefg") for _ in range(5)])]
        rows.append((k if kind == "long" else f"id {k % 7}/{k}", " ".join(words)))
    rows += [(2**63 - 1 if kind == "long" else "~", rows[3][1] + " tail"), (None, rows[3][1])]
    assert kept(spark, rows, kind, width=4) == plain(rows, 4)


def test_a_window_of_many_megabytes():
    points = substrings.drawn()
    long = b"q" * (substrings.MOST_BYTES + 5)
    texts = [b" ".join([b"z"] * n + [long, b"x"]) for n in (3, 9)]
    (a, b), (c, d) = (substrings.windows([t], 3, points)[0] for t in texts)
    assert a[-2:].tolist() == c[-2:].tolist() and b[-2:].tolist() == d[-2:].tolist()


def test_lines_of_string_ids(spark):
    docs = spark.createDataFrame([("b", "a line that is there twice\nother"), ("a", "a line that is there twice"), (None, "a line that is there twise\nmore")], "doc_id string, text string")
    got = {r["id"]: r["kept"] for r in lines.dedup(docs).collect()}
    assert got == {"a": "a line that is there twice", "b": "other", None: "more"}


def test_lines_of_a_null_id_come_after_the_largest(spark):
    docs = spark.createDataFrame([(None, "a line that is there twice"), (2**63 - 1, "a line that is there twice")], "doc_id long, text string")
    assert {r["id"]: r["kept"] for r in lines.dedup(docs).collect()} == {2**63 - 1: "a line that is there twice", None: ""}
