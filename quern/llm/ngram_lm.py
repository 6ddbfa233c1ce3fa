"""Stupid-backoff scores of every document under the n-gram counts of all other documents.

The relation (document, n-gram, occurrences) is joined to count tables that are partitioned by the n-gram's hash, and
the logarithms are summed per document.  Rows are packed: documents are dealt into blocks, and a record holds all
n-grams that a block has in one hash partition, sorted, with their occurrences.  Each hash partition merges the
records of its n-grams to its part of the count table and joins it to them: it answers each record with the totals in
the record's order.  The answers meet the block's documents again, where each position is scored.  An n-gram takes
part once a block, so a word that every document has is no heavier than any other, and 7 bytes an n-gram are moved
out and about one back.  Rows of the DataFrame, one an n-gram, would move over 20 bytes each: at three orders more than
ten times the text.

The score of a word w after the words u is c(u w) / c(u), or, if no other document has "u w", 0.4 times the score of w
after u less its first word; without words before it, it is c(w) / N.  ``order`` is the length of the longest n-gram.
A word that no other document has counts as half an occurrence.  All counts leave out the scored document's own.
Documents are rows: copies of a text score one another.

An n-gram stands for itself by the low 56 bits of a hash and its partition (see ``substrings``): of 10**10 distinct
n-grams in 256 partitions or more some twenty share their count with another.

Edge cases: a null or wordless text has no score (null) and 0 words; repeated rows are documents of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Shelf, prepare
from quern.llm.substrings import Points, _in_parts, drawn, windows
from quern.llm.text import LOWERED, utf8

BACKOFF = 0.4
UNSEEN = 0.5
#: Bytes of text of a block, and of the text whose n-grams make one hash partition, about.
BLOCK_BYTES = 4_000_000
PART_BYTES = 8_000_000
OUT = "n_words long, n_seen long, log2_score double"


def grams(texts: list[bytes], n: int, points: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of the text and position of each n-gram."""
    parts = [(h, who + begin, start) for begin, some in _in_parts(texts) for (h,), who, start in [windows(some, n, points[:1])]]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition: rising with the hash, so that sorted n-grams are in the order of partitions."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _seven(hashes: np.ndarray) -> bytes:
    """The low seven bytes of each hash; the partition stands for the eighth."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _eight(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(packed, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _bytes(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, and those of 255 and more in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<u8").tobytes()


def _counts(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<u8").astype(np.int64)
    return out


def score(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_seen`` (n-grams of ``order`` words that other documents have) and ``log2_score`` (mean over the
    words)."""
    spark = docs.sparkSession
    prepare(spark)
    shelf, points = Shelf(spark, "lm"), drawn()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_parts = 1 + size // BLOCK_BYTES, 1 + size // PART_BYTES
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))

    def packing(n: int) -> Callable[[pa.Table], pa.Table]:
        def pack(table: pa.Table) -> pa.Table:
            texts = [t.translate(LOWERED) for t in utf8(table.column("text"))]
            block = table.column("block")[0].as_py()
            out: dict[str, list] = {k: [] for k in ("part", "n", "block", "grams", "counts", "large")}
            hashes, counts = np.unique(grams(texts, n, points)[0], return_counts=True)
            cuts = np.searchsorted(_part_of(hashes, n_parts), np.arange(n_parts + 1))
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    for k, v in zip(out, (p, n, block, _seven(hashes[a:b]), *_bytes(counts[a:b])), strict=True):
                        out[k].append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

        return pack

    def total(table: pa.Table) -> pa.Table:
        held = [_eight(x) for x in table.column("grams").to_pylist()]
        counts = np.concatenate([_counts(x, y) for x, y in zip(table.column("counts").to_pylist(), table.column("large").to_pylist(), strict=True)])
        names, where = np.unique(np.concatenate(held), return_inverse=True)
        totals = np.bincount(where, counts, minlength=len(names)).astype(np.int64)[where]
        cuts = np.cumsum([0, *map(len, held)])
        answers = [_bytes(totals[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        words = [int(counts[a:b].sum()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({**{c: table.column(c) for c in ("part", "n", "block")}, "totals": pa.array([x[0] for x in answers], pa.binary()), "large": pa.array([x[1] for x in answers], pa.binary()), "words": pa.array(words, pa.int64())})

    def answered(n: int) -> DataFrame:
        packed = blocked.groupBy("block").applyInArrow(packing(n), "part int, n int, block int, grams binary, counts binary, large binary")
        return shelf.put(packed.groupBy("part").applyInArrow(total, "part int, n int, block int, totals binary, large binary, words long"), f"answers{n}")

    orders = range(1, order + 1)
    answers = answered(1)
    for n in orders[1:]:  # one after the other: only one order's n-grams are on the move at a time
        answers = answers.unionByName(answered(n))
    n_words = answers.where("n = 1").agg(F.sum("words")).first()[0] or 0
    kind = dict(rows.dtypes)["id"]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [t.translate(LOWERED) for t in utf8(left.column("text"))]
        columns = (right.column(c).to_pylist() for c in ("n", "part", "totals", "large"))
        by_part = sorted(zip(*columns, strict=True), key=lambda x: x[:2])
        rest, who, at = [], [], []
        for n in orders:
            hashes, text, start = grams(texts, n, points)
            names, where = np.unique(hashes, return_inverse=True)
            totals = np.concatenate([np.zeros(0, np.int64), *(_counts(x[2], x[3]) for x in by_part if x[0] == n)])
            _, own, times = np.unique(text * max(1, len(names)) + where, return_inverse=True, return_counts=True)
            rest.append(totals[where] - times[own] if len(hashes) else np.zeros(0, np.int64))
            who.append(text)
            at.append(start)
        return pa.table(_scored(left.column("id"), rest, who, at, len(texts), n_words))

    scored = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, f"id {kind}, {OUT}")
    return scored


def _scored(ids: pa.ChunkedArray, rest: list[np.ndarray], who: list[np.ndarray], at: list[np.ndarray], n: int, n_words: int) -> dict:
    """rest: for each n-gram of each order its count in other documents; who and at: its text and place."""
    words = np.bincount(who[0], minlength=n)
    begin = np.cumsum(words) - words
    others = np.maximum(1, n_words - words).astype(float)
    value = np.log2(np.maximum(rest[0], UNSEEN)) - np.log2(others)[who[0]]
    shorter = begin
    for k in range(1, len(rest)):
        last = begin[who[k]] + at[k] + k  # place of the n-gram's last word
        context = rest[k - 1][shorter[who[k]] + at[k]]  # count of the n-gram without it
        seen = rest[k] > 0
        value[last] = np.where(seen, np.log2(np.maximum(rest[k], 1)) - np.log2(np.maximum(context, 1)), np.log2(BACKOFF) + value[last])
        many = np.bincount(who[k], minlength=n)
        shorter = np.cumsum(many) - many
    sums = np.bincount(who[0], value, minlength=n)
    return {
        "id": ids,
        "n_words": pa.array(words, pa.int64()),
        "n_seen": pa.array(np.bincount(who[-1], rest[-1] > 0, minlength=n).astype(np.int64), pa.int64()),
        "log2_score": pa.array([s / w if w else None for s, w in zip(sums.tolist(), words.tolist(), strict=True)], pa.float64()),
    }
