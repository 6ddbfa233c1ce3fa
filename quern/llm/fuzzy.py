"""Context-triggered piecewise hashing: fingerprints of texts that survive local edits.

A rolling hash of the last seven bytes decides where a chunk ends: where it leaves the remainder block - 1 modulo the
block size.  Each chunk gives one character of a signature; a fingerprint has the signatures at the block size and at
its double, as ``block:signature:signature``.  The block size starts where the text has about SIGNATURE chunks and is
halved while the signature is under half of that.  What exceeds SIGNATURE chunks joins the last one.

Two fingerprints compare at a block size that both have: the likeness is 1 - edits / characters, where an edit inserts
or deletes a character (a change is both), and 0 if the signatures share no run of seven characters (of all, for
shorter ones).  Equal signatures at a shared block size have likeness 1.

Edge cases: a null text is empty; equal texts have equal fingerprints; repeated rows and rows that share an id follow
one another by text; a single row's next document is itself; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Shelf, prepare

SIGNATURE = 64
LEAST_BLOCK = 3
WINDOW = 7
SHARED_RUN = 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL, _CHUNK = np.uint32(0x01000193), 0x9E3779B1


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a 32-bit hash of the last WINDOW bytes."""
    wide = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)))
    out = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        out *= _ROLL
        out += wide[k : k + len(data)]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


@functools.cache
def _chunk_powers(bits: int) -> np.ndarray:
    steps = np.full(1 << bits, _CHUNK, np.uint32)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint32)


def _signature(data: np.ndarray, cuts: np.ndarray) -> bytes:
    """One character a chunk; ``cuts`` are the chunks' last bytes."""
    starts = np.concatenate(([0], cuts + 1))
    if starts[-1] == len(data):
        starts = starts[:-1]
    starts = starts[:SIGNATURE]
    if not len(starts):
        return b""
    lengths = np.diff(np.append(starts, len(data)))
    within = np.arange(len(data)) - np.repeat(starts, lengths)
    power = _chunk_powers(max(16, int(lengths.max() - 1).bit_length()))
    with np.errstate(over="ignore"):
        h = np.add.reduceat((data.astype(np.uint32) + np.uint32(1)) * power[within], starts, dtype=np.uint32)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
    return _ALPHABET[h >> np.uint32(26)].tobytes()


def fingerprint(text: bytes) -> str:
    data = np.frombuffer(text, np.uint8)
    block = LEAST_BLOCK
    while block * SIGNATURE < len(data):
        block *= 2
    rolled = _rolling(data)
    while True:
        cuts = np.flatnonzero(rolled % np.uint32(block) == block - 1)
        if block == LEAST_BLOCK or len(cuts) >= SIGNATURE // 2:
            break
        block //= 2
    double = cuts[rolled[cuts] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, cuts).decode()}:{_signature(data, double).decode()}"


def edits(a: str, b: str) -> int:
    """Insertions and deletions from a to b: len(a) + len(b) - 2 LCS, the LCS by bit-parallel rows."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def likeness(a: str, b: str) -> float:
    """0 to 1; fingerprints without a common block size are unlike."""
    if a == b:
        return 1.0
    block_a, one_a, two_a = a.split(":")
    block_b, one_b, two_b = b.split(":")
    x, y = int(block_a), int(block_b)
    pairs = [(one_a, one_b), (two_a, two_b)] if x == y else [(two_a, one_b)] if 2 * x == y else [(one_a, two_b)] if x == 2 * y else []
    return max((_alike(p, q) for p, q in pairs), default=0.0)


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    run = min(SHARED_RUN, len(a), len(b))
    if not {a[k : k + run] for k in range(len(a) - run + 1)} & {b[k : k + run] for k in range(len(b) - run + 1)}:
        return 0.0
    return 1 - edits(a, b) / (len(a) + len(b))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judge(text: str, mark: str, following: str, following_mark: str) -> tuple:
    changed = _edited(text, following)
    raw = changed.encode()
    changed_mark = mark if changed == text else fingerprint(raw)
    return len(text), hashlib.sha256(raw).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, following_mark)


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in OUT.split(", ")]
#: Rows of a range of ids, about: a range is sorted and read in order by one task.
RANGE_ROWS = 4_000
#: Ranges at most: beyond it they hold more rows.
MOST_RANGES = 5_000


def _apart(spark: SparkSession, parts: int) -> list[int]:
    """For each range a number that hash partitioning puts into a partition of its own."""
    tried = spark.range(24 * parts + 64).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    found = dict(tried.groupBy("p").agg(F.min("v")).collect())  # one row a range
    return [found.get(p, p) for p in range(parts)]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (of any type that has an order) and, for each document, what its fingerprint shows against its half-replaced text and the next document
    (by falling id; after the last the first).

    Rows are cut by id and text into ranges of about RANGE_ROWS rows, so that rows of one id, or of none, spread over as
    many as they need.  Each range is one task's work, in order; the first row of the
    next range is sent along, so that texts are dealt out once and no task sees more than a range and one row."""
    spark = docs.sparkSession
    prepare(spark)
    shelf = Shelf(spark, "fuzzy")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    keys = shelf.put(rows.select("id", F.xxhash64("text").alias("tie")), "keys")
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    parts = min(MOST_RANGES, max(1, -(-keys.count() // RANGE_ROWS)))
    ranged = keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    first = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where("nth = 1")
    heads = [(r["id"], r["tie"]) for r in first.select("part", "id", "tie").orderBy("part").collect()]  # one row a range
    if not heads:
        return spark.createDataFrame([], f"id {kind}, {OUT}")
    parts = len(heads)
    step = max(1, int(parts**0.5))

    def bounds(some: list[tuple]) -> Column:
        ids = F.array(*[F.lit(i) for i, _ in some]).cast(f"array<{kind}>")
        ties = F.array(*[F.lit(t).cast("long") for _, t in some]).cast("array<bigint>")
        return F.zip_with(ids, ties, lambda i, t: F.struct(i.alias("id"), t.alias("tie")))

    def reached(head: Column) -> Column:
        """Whether a row comes at or after the head."""
        after = head["id"].isNotNull() & (F.col("id").isNull() | (head["id"] > F.col("id")))
        return F.coalesce(after, F.lit(False)) | (head["id"].eqNullSafe(F.col("id")) & (head["tie"] <= F.col("tie")))

    def part_of(frame: DataFrame) -> DataFrame:
        """The number of the row's range: each step-th head first, then those between."""
        coarse = F.size(F.filter(bounds(heads[step - 1 :: step]), reached)) * step
        return frame.withColumn("part", (coarse + F.size(F.filter(F.slice(bounds(heads), coarse + 1, F.lit(step)), reached)) - 1).cast("int"))

    schema = f"id {kind}, tie long, to int"
    # a range's head is sent to the range before it, the first to the last
    tail = F.array(F.struct(F.col("to").alias("part"), F.lit(1).alias("tail")))
    sent = spark.createDataFrame([(i, tie, (k - 1) % parts) for k, (i, tie) in enumerate(heads)], schema).select("id", "tie", F.explode(tail).alias("at"))
    marked = rows.withColumn("tie", F.xxhash64("text"))
    own = part_of(marked).withColumn("tail", F.lit(0))
    # repeated rows of a head are alike: one of them is enough
    tails = marked.join(F.broadcast(sent), marked["id"].eqNullSafe(sent["id"]) & (marked["tie"] == sent["tie"])).select(marked["id"], "text", marked["tie"], F.col("at.part").alias("part"), F.col("at.tail").alias("tail"))
    slots = F.array(*[F.lit(v) for v in _apart(spark, parts)])
    both = own.unionByName(tails.dropDuplicates(["part"])).withColumn("slot", F.get(slots, F.col("part")))
    dealt = both.repartition(parts, "slot").sortWithinPartitions("part", "tail", *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        last: tuple | None = None
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            ids, out = [], []
            for i, text, part, tail in zip(batch.column("id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist(), batch.column("part").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                if text not in known:
                    if len(known) > 2:
                        known.clear()
                        if last:
                            known[last[1]] = last[2]
                    known[text] = fingerprint(text.encode())
                mark = known[text]
                if last and last[3] == part:
                    ids.append(last[0])
                    out.append(_judge(last[1], last[2], text, mark))
                last = None if tail else (i, text, mark, part)
            columns = zip(*out, strict=True) if out else [[]] * len(_NAMES)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["id", *_NAMES])

    return dealt.select("id", "text", "part", "tail").mapInArrow(walk, f"id {kind}, {OUT}")
