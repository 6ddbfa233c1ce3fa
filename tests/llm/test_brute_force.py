"""Queries that SQL cannot express, against plain versions over a whole small table; the others against DuckDB."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict, deque

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import fuzzy, lines, mixing, pii, queries, sharding, simhash, toxicity
from quern.llm.oracles import ORACLES
from tests.llm.test_near_exact import kept_by_jaccard

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    def plain(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    mine = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert mine == sorted(tuple(map(plain, r)) for r in found.select(*columns).fetchall())


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_ring_walk(spark, slack):
    """A queue that walks two laps of the ring key by key, each key to the next shard with room."""
    shards, vnodes = 5, 6
    rng = random.Random(2)
    rows = [(k, "hot" if rng.random() < 0.35 else f"text {rng.randrange(150)}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, shards, vnodes, slack).collect()}
    ring = sorted(sharding.ring(spark, shards, vnodes).collect(), key=lambda r: r["v"])
    salts = dict(docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.SALTS)).alias("s")).collect())

    def signed(text):
        h = xxhash.xxh64(text.encode(), seed=42).intdigest()
        return h - 2**64 if h >= 2**63 else h

    homes = defaultdict(list)
    for k, t in rows:
        h = signed(t)
        v = next((r["v"] for r in ring if r["pos"] >= h), 0)
        homes[v].append((salts[k], h, k))
    total = max(len(rows), int(len(rows) * (1 + slack)))
    capacity = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    load, expected, movers = Counter(), {}, defaultdict(list)
    for r in ring:
        for _, _, k in sorted(homes[r["v"]]):
            if load[r["shard"]] < capacity[r["shard"]]:
                expected[k] = (r["shard"], load[r["shard"]])
                load[r["shard"]] += 1
            else:
                movers[r["v"]].append(k)
    assert sum(len(m) for m in movers.values()) > 50
    queue = deque()
    for lap in (0, 1):
        for r in ring:
            queue.extend([] if lap else movers[r["v"]])
            while queue and load[r["shard"]] < capacity[r["shard"]]:
                expected[queue.popleft()] = (r["shard"], load[r["shard"]])
                load[r["shard"]] += 1
    assert not queue
    assert found == expected


def test_ring_query(spark, texts):
    got = by_id(queries.op1_ring_shards(spark, SF))
    assert got.keys() == texts.keys()
    counts = Counter(r["shard"] for r in got.values())
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(16))
    import zlib

    for k, r in got.items():
        raw = texts[k].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_toxicity_on_held_out_rows(spark):
    """Trained and scored on a larger table: held-out documents are told apart."""
    big = SF.replace("sf0.001", "sf0.1")
    got = queries.op2_weak_toxicity(spark, big)
    judged = got.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    right = Counter((r["toxic"], r["predicted"]) for r in judged)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.85
    assert right[0, 1] / (right[0, 0] + right[0, 1]) < 0.02


def test_toxicity_labels_of_held_out_rows_are_unseen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_label_model_finds_a_poor_voter():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    good = truth & (rng.random(4000) < 0.9)
    other = truth & (rng.random(4000) < 0.7)
    twin = other & (rng.random(4000) < 0.98)  # all but the same voter
    noise = rng.random(4000) < 0.2
    given = truth ^ (rng.random(4000) < 0.1)
    fires = np.column_stack([good, other, twin, noise, ~(good | other | twin | noise), given, ~given])
    model = toxicity.LabelModel(fires, 0.2 * given + 0.6 * (good | other), free=3)
    assert ((model.posterior > 0.5) == truth).mean() >= (given == truth).mean()
    assert abs(model.alone[3]) < 1 < model.alone[0]  # a voter that fires alike for both says little


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_pii_query(spark, texts):
    for k, r in by_id(queries.op6_shape_field_pii(spark, SF)).items():
        base = base_spans(texts[k])
        assert [r[f"n_{x}"] for x in BASE] == [sum(s[0] == x for s in base) for x in BASE]
        listed = ",".join(f"{a}:{b}:{c}" for a, b, c in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert not base or {f"{a}:{b}:{c}" for a, b, c in base} <= set(r["spans"].split(","))


def test_pii_patterns_on_odd_texts():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("1234567890.@+- ()ab%\n²") for _ in range(rng.randrange(60)))
        assert pii.patterns(text) == base_spans(text), text
    assert pii.patterns("1" * 200_000) == [] and pii.patterns("a" * 200_000 + "@") == []


def test_fingerprint_query(spark, texts):
    order = sorted(texts, reverse=True)
    got = by_id(queries.op7_piecewise_fingerprints(spark, SF))
    assert got.keys() == texts.keys()
    for at, k in enumerate(order):
        mine, following = texts[k], texts[order[(at + 1) % len(order)]]
        half = len(mine) // 2
        changed = mine[: len(mine) - half] + following[:half]
        a, b, c = (fuzzy.fingerprint(x.encode()) for x in (mine, changed, following))
        assert tuple(got[k])[1:] == (len(mine), hashlib.sha256(changed.encode()).hexdigest(), a, b, fuzzy.likeness(a, b), fuzzy.likeness(a, c))


def test_fingerprints_survive_edits():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(800))
    other = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(800))
    mark = fuzzy.fingerprint(text.encode())
    assert fuzzy.likeness(mark, fuzzy.fingerprint((text[:2000] + "inserted" + text[2000:]).encode())) > 0.9
    assert fuzzy.likeness(mark, fuzzy.fingerprint(other.encode())) < 0.3
    assert fuzzy.edits("abcd", "axcd") == 2 and fuzzy.edits("", "ab") == 2


def plain_simhash(text, words, repeats=True):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    n = min(words, len(tokens))
    shingles = [" ".join(tokens[k : k + n]) for k in range(len(tokens) - n + 1)] if n else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def test_simhash_query(spark, texts):
    marks = {k: plain_simhash(t, 3) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = by_id(queries.op8_simhash_tiles(spark, SF))
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{marks[k]:016x}", root(k)) for k in ids}


@pytest.mark.parametrize(("bits", "radius", "spread"), [(64, 2, 0), (64, 2, 1), (256, 39, 0)])
def test_tiles_lose_no_link(spark, monkeypatch, bits, radius, spread):
    """Random fingerprints and neighbours, over one block and over many, in tiles of a few."""
    import numpy as np

    from quern.llm.common import Shelf
    from quern.llm.components import components

    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "WIDE_TILE", 16)
    if spread:
        monkeypatch.setattr(simhash, "_blocks", lambda n, r: 8)
    rng = random.Random(bits)
    marks = {rng.getrandbits(bits) for _ in range(60)}
    for m in list(marks):
        x = m
        for _ in range(3):
            for _ in range(rng.randrange(1, radius + 2)):
                x ^= 1 << rng.randrange(bits)
            marks.add(x)
    ids = sorted(marks)
    parent = {k: k for k in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    raw = [m.to_bytes(bits // 8, "big") for m in ids]
    nodes = spark.createDataFrame([(x, np.bitwise_count(np.frombuffer(x, np.uint8)).tolist()) for x in raw], "fp binary, pops array<int>")
    shelf = Shelf(spark, "test")
    got = {bytes(r["node"]): bytes(r["root"]) for r in components(simhash.links(nodes, bits, radius, shelf), shelf).collect()}
    assert {x: got.get(x, x) for x in raw} == {m.to_bytes(bits // 8, "big"): root(m).to_bytes(bits // 8, "big") for m in ids}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, text, n, alphabet):
    out = list(text)
    for _ in range(n):
        at, what = rng.randrange(len(out) + 1), rng.randrange(3)
        if what == 0:
            out.insert(at, rng.choice(alphabet))
        elif at < len(out):
            out[at : at + 1] = [] if what == 1 else [rng.choice(alphabet)]
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_edit_distance(most):
    rng = random.Random(most)
    first = ["".join(rng.choice("abü") for _ in range(rng.randrange(30))) for _ in range(1500)]
    second = [edited(rng, x, rng.randrange(6), "abü") for x in first]
    assert lines.within(first, second, most).tolist() == [edit_distance(a, b) <= most for a, b in zip(first, second, strict=True)]


def test_edit_join_loses_no_line(spark, monkeypatch):
    """Chains of edits, and a bucket of many alike lines that is cut in tiles."""
    monkeypatch.setattr(lines, "BUCKET", 8)
    rng = random.Random(9)
    pool = []
    for _ in range(25):
        line = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 60))).strip() or "x"
        for _ in range(6):
            pool.append(line)
            line = edited(rng, line, rng.randrange(0, 4), "abcdefgh").strip() or "y"
    pool += [f"the one very common line number {k:04d}" for k in range(40)] + ["short", "shor", "buy it now!", "buy it now?", "twelve chars", "twelve ch"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(4))) for k in range(120)]
    distinct = sorted({x for _, t in rows for x in t.split("\n")})
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if edit_distance(a, b) <= min(2, min(len(a), len(b)) // 6):
                parent[root(a)] = root(b)
    seen, expected = set(), {}
    for k, t in rows:
        kept = []
        for x in t.split("\n"):
            if root(x) not in seen:
                seen.add(root(x))
                kept.append(x)
        expected[k] = "\n".join(kept)
    got = {r["id"]: r["kept"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), most=2).collect()}
    assert got == expected


def test_pipeline(spark, texts):
    """Each stage over what the one before kept, against the plain rule of its decision."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["row"]["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.5}

    unique = kept_by_jaccard({k: texts[k] for k in clean})

    items = [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    item_words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER)) for t in items]
    wins = {" ".join(["", *w[i : i + 10], ""]) for w in item_words for i in range(max(1, len(w) - 9)) if w}
    fold = {k: " ".join(["", *re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[k].translate(LOWER)), ""]) for k in unique}
    free = {k for k in unique if not any(w in fold[k] for w in wins)}
    kept = spark.createDataFrame([(k,) for k in sorted(free)], "doc_id long").join(docs, "doc_id")
    copies = {r["id"]: r["copies"] for r in mixing.mix(kept, share=1.0).collect()}

    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({k: n for k, n in copies.items() if n})
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
