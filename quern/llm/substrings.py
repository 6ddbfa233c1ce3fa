"""Substring dedup with a count-min prefilter.

A window is ``width`` consecutive words of one document.  Pass one hashes every window and counts it in a count-min
sketch of two rows: each task sketches the windows it reads, and the partial sketches are merged by cell range on the
executors.  A count only ever overestimates, so a window whose smaller count is 1 occurs once.  What is kept of the
merged sketch is one bit a cell, "counted more than once".  Pass two hashes the windows again, and only those
estimated to be repeated are grouped by two hashes.  No repeated window is lost, however full the sketch is: a fuller
one lets more windows through to the exact grouping, and no more than that.

A hash is the window's text, its words one space apart, as a polynomial modulo the prime 2**61 - 1 at a point that is
drawn anew for each call.  Whatever the texts, two different windows of up to L bytes agree at both points with a
chance of at most (L / 2**61)**2, so that of 10**13 windows of 200 bytes no two are taken for one another but with a
chance under 10**-6.  The draw doesn't show in the result.

The rows of the sketch grow with the text, to ``most_cells`` each, which bounds what is sent to the workers to a
quarter byte per cell.  The least id of each group comes from a map-side minimum.  Windows of several rows are then
joined back: a bit array of the windows now known to be shared spares the join all others; hot windows are skewed join
keys, which adaptive execution splits.  Repeats within one text are found where the text is read.

Edge cases: null and empty texts have no words; texts shorter than a window keep all words; a null id comes after all
others; of rows that share an id neither is earlier than the other, and each is judged by its own repeats and by
smaller ids.  Ids may be of any type that has an order.
"""

from __future__ import annotations

import functools
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Shelf, bits_of_power, packed, prepare
from quern.llm.text import utf8

ROWS = 2
#: log2 of the cells of a sketch row that merge as one unit.
UNIT_BITS = 16
#: Units that one merged record holds.
GROUP_BITS = 5
#: Cells of a sketch row at most: 2**28 cells of two rows are 64 MB of bits.
MOST_CELLS = 2**28
#: Windows that a task sketches before it hands on what it has.
FLUSH = 2_000_000
PRIME = 2**61 - 1
_P, _LOW32, _LOW29 = np.uint64(PRIME), np.uint64(2**32 - 1), np.uint64(2**29 - 1)
_29, _32, _61 = np.uint64(29), np.uint64(32), np.uint64(61)

#: Bytes whose products with halves of 32 bits fit a sum of 64.
MOST_BYTES = 2**23
#: Two points at which window polynomials are taken.
Points = tuple[int, int]


def drawn() -> Points:
    """Points for one call; every task of it takes the same."""
    return 2**60 + secrets.randbelow(2**59), 2**60 + secrets.randbelow(2**59)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _at_32(x: np.ndarray) -> np.ndarray:
    """x * 2**32 modulo the prime, not fully reduced."""
    return (x >> _29) + ((x & _LOW29) << _32)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 32 bits."""
    high_a, low_a, high_b, low_b = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    low = low_a * low_b
    return _reduced(np.uint64(8) * (high_a * high_b) + _at_32(high_a * low_b + low_a * high_b) + (low & _P) + (low >> _61))


@functools.lru_cache(maxsize=2)
def _powers(point: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 2**bits powers of the point in halves of 32 bits, and those of its inverse, modulo the prime."""
    out = []
    for b in (point, pow(point, -1, PRIME)):
        powers = np.ones(1, np.uint64)
        for k in range(bits):
            powers = np.concatenate((powers, _times(powers, np.uint64(pow(b, 1 << k, PRIME)))))
        out.append(powers)
    return out[0] & _LOW32, out[0] >> _32, out[1]


def _spread(h: np.ndarray) -> np.ndarray:
    """One to one, to all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _between(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Modulo the prime what was summed from begin to end, of products with the low and the high halves of powers.  The
    sums may run over; their differences don't, over MOST_BYTES."""
    return _reduced(_reduced(sums[0, end] - sums[0, begin]) + _at_32(sums[1, end] - sums[1, begin]))


def _run(texts: list[bytes], width: int, points: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``windows`` of texts that are short enough to be hashed at once."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    after_space = np.concatenate(([True], space[:-1]))
    keep = ~(space & after_space)  # of each run of spaces the first, and none at the start
    first = np.flatnonzero(~space & after_space)
    ends = np.cumsum([len(t) + 1 for t in texts])
    n_words = np.diff(np.searchsorted(first, ends), prepend=0)
    flat = np.where(space, np.uint8(0x20), raw)[keep].astype(np.uint64) + np.uint64(1)
    n = len(first) - width + 1
    if n <= 0:
        return [np.zeros(0, np.uint64) for _ in points], np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = (np.cumsum(keep) - 1)[first]
    who = np.repeat(np.arange(len(texts)), n_words)
    start = np.arange(len(first)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    inside = np.flatnonzero(who[:n] == who[width - 1 :])
    begin = at[inside]
    end = np.append(at[1:], len(flat))[inside + width - 1] - 1
    hashes = []
    sums = np.zeros((2, len(flat) + 1), np.uint64)
    for point in points:
        low, high, inverse = _powers(point, bits_of_power(max(1 << 20, len(flat))))
        np.cumsum(flat * low[: len(flat)], out=sums[0, 1:])
        np.cumsum(flat * high[: len(flat)], out=sums[1, 1:])
        value = _between(sums, begin, end)
        for k in np.flatnonzero(end - begin > MOST_BYTES).tolist():
            cuts = np.append(np.arange(begin[k], end[k], MOST_BYTES), end[k])
            value[k] = sum(_between(sums, cuts[:-1], cuts[1:]).tolist()) % PRIME
        hashes.append(_spread(_times(value, inverse[begin])))
    return hashes, who[inside], start[inside]


def windows(texts: list[bytes], width: int, points: tuple[int, ...], long: int = 1 << 20) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """All windows of the texts: a 64-bit hash at each of the points, number of the text, start.  A text of more than
    ``long`` bytes is hashed in pieces that overlap by a window less one word."""
    if len(texts) != 1 or len(texts[0]) <= long:
        return _run(texts, width, points)
    words = texts[0].split()
    step = 1 << 18
    parts, starts = [], []
    sizes = np.cumsum([0, *(len(w) + 1 for w in words)])
    k = 0
    while k <= max(0, len(words) - width):
        more = max(1, min(step, int(np.searchsorted(sizes, sizes[k] + long // 2)) - k))
        parts.append(_run([b" ".join(words[k : k + more + width - 1])], width, points))
        starts.append(parts[-1][2] + k)
        k += more
    return [np.concatenate([p[0][i] for p in parts]) for i in range(len(points))], np.concatenate([p[1] for p in parts]), np.concatenate(starts)


def _in_parts(texts: list[bytes], most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes (a longer text is a run of its own)."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size + len(text) > most and k > begin:
            yield begin, texts[begin:k]
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def _cells(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], cell_bits: int, leasts: tuple[int, ...], shelf: Shelf) -> list[list[np.ndarray]]:
    """For each of ``leasts`` (1 or 2), and each sketch row, a bit array: the cells that the hashes of ``df`` count as
    often as that or more."""
    unit_bits = min(UNIT_BITS, cell_bits)
    partial = "row int, unit int, once binary, more binary"

    def hand_on(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            cells = np.concatenate([h[row] for h in held]) >> np.uint64(64 - cell_bits)
            cells = np.sort(cells.astype(np.uint32))
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            several = np.diff(np.concatenate((first, [len(cells)]))) > 1
            cells = cells[first]
            unit = (cells >> np.uint32(unit_bits)).astype(np.int64)
            low = (cells & np.uint32((1 << unit_bits) - 1)).astype(np.uint16)
            cuts = np.flatnonzero(np.diff(np.concatenate(([-1], unit, [-1]))))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row] * len(spans), pa.int32()),
                    pa.array([int(unit[a]) for a, _ in spans], pa.int32()),
                    pa.array([low[a:b][~several[a:b]].tobytes() for a, b in spans], pa.binary()),
                    pa.array([low[a:b][several[a:b]].tobytes() for a, b in spans], pa.binary()),
                ],
                ["row", "unit", "once", "more"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for pair in hashes(batch):
                held.append(pair)
                n += len(pair[0])
                if n >= FLUSH:
                    yield from hand_on(held)
                    held, n = [], 0
        if n:
            yield from hand_on(held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << (unit_bits + GROUP_BITS), np.uint8)
        for batch in batches:
            for unit, once, more in zip(*(batch.column(c).to_pylist() for c in ("unit", "once", "more")), strict=True):
                part = counts[(unit & ((1 << GROUP_BITS) - 1)) << unit_bits :][: 1 << unit_bits]
                cells = np.frombuffer(once, np.uint16)  # a cell is there once
                part[cells] = np.minimum(part[cells] + 1, 2)
                part[np.frombuffer(more, np.uint16)] = 2
        bits = [np.packbits(counts >= least, bitorder="little").tobytes() for least in leasts]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([bits], pa.list_(pa.binary()))], ["row", "part", "bits"])

    merged = df.mapInArrow(count, partial).withColumn("part", F.shiftright("unit", GROUP_BITS)).groupBy("row", "part").applyInArrow(merge, "row int, part int, bits array<binary>")
    step = (1 << (unit_bits + GROUP_BITS)) // 8
    out = [[np.zeros(max(step, (1 << cell_bits) // 8), np.uint8) for _ in range(ROWS)] for _ in leasts]
    for row, part, bits in shelf.put(merged, "cells").toLocalIterator():  # a bounded table, a record at a time
        for k, some in enumerate(bits):
            out[k][row][part * step : (part + 1) * step] = np.frombuffer(some, np.uint8)
    return out


def _in_cells(bits: list[np.ndarray], h1: np.ndarray, h2: np.ndarray, cell_bits: int) -> np.ndarray:
    """Positions of the hashes whose cells are set in every row."""
    left = np.arange(len(h1))
    for row, h in zip(bits, (h1, h2), strict=True):
        cell = (h[left] >> np.uint64(64 - cell_bits)).astype(np.int64)
        left = left[(row[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
    return left


def _first_in_text(h1: np.ndarray, h2: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Whether each window (in the order of texts and starts) is the first of its kind in its text."""
    order = np.lexsort((h2, h1, who))
    a, b, c = h1[order], h2[order], who[order]
    out = np.ones(len(h1), bool)
    out[order[1:]] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    return out


def dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", most_cells: int = MOST_CELLS, carry: bool = False) -> DataFrame:
    """``id, n_words, n_removed, kept`` (the kept words joined by one space); with ``carry`` the input row comes
    first, as struct ``row``.

    A word goes if a window covers it whose word sequence also starts earlier in the input."""
    spark = docs.sparkSession
    prepare(spark)
    shelf = Shelf(spark, "substrings")
    points = drawn()
    key = F.col(id_col).alias("doc")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    seen = docs.select(key, F.octet_length(text).alias("size")).agg(F.sum("size"), F.count("*"), F.countDistinct("doc"), F.count_if(F.col("doc").isNull())).first()
    # where an id names one row, nothing else needs to
    mark = F.lit(0).cast("long") if seen[1] == seen[2] + min(1, seen[3]) else F.xxhash64("text")
    texts = docs.select(key, text).withColumn("mark", mark)
    kind = texts.schema["doc"].dataType.simpleString()
    cell_bits = min(bits_of_power(most_cells), max(UNIT_BITS, bits_of_power((seen[0] or 0) // 3)))

    def text_hashes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, part in _in_parts(utf8(batch.column("text"))):
            h = windows(part, width, points[:1])[0][0]
            yield h, h << _32

    def key_hashes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = batch.column("h1").to_numpy().view(np.uint64)
        yield h, h << _32

    several = spark.sparkContext.broadcast(_cells(texts.select("text"), text_hashes, cell_bits, (2,), shelf)[0])

    def occurrences(bits, more) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The windows in set cells of ``bits`` that are first in their text; with ``more``, those of its cells that
        are not, as well."""

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, part in _in_parts(utf8(batch.column("text"))):
                    (h1, h2), who, start = windows(part, width, points)
                    left = _in_cells((more or bits).value, h1, h1 << _32, cell_bits)
                    own = _first_in_text(h1[left], h2[left], who[left])
                    met = np.zeros(len(left), bool)
                    met[_in_cells(bits.value, h1[left], h1[left] << _32, cell_bits) if more else slice(None)] = True
                    pick = (met & own) | (~own if more else False)
                    left, own = left[pick], own[pick]
                    at = pa.array(begin + who[left])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1[left].view(np.int64)), pa.array(h2[left].view(np.int64)), batch.column("doc").take(at), batch.column("mark").take(at), pa.array(start[left].astype(np.int32)), pa.array(own)],
                        ["h1", "h2", "doc", "mark", "start", "own"],
                    )

        return found

    record = f"h1 long, h2 long, doc {kind}, mark long, start int, own boolean"
    # a least id is null only where all are
    firsts = texts.mapInArrow(occurrences(several, None), record).groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    shared = shelf.put(firsts.where("n > 1").drop("n"), "shared")
    known = spark.sparkContext.broadcast(_cells(shared.select("h1"), key_hashes, cell_bits, (1,), shelf)[0])
    later = texts.mapInArrow(occurrences(known, several), record).join(shared, ["h1", "h2"], "left").where("NOT own OR doc > first OR (doc IS NULL AND first IS NOT NULL)")
    gone = shelf.put(later.groupBy("doc", "mark").agg(F.collect_list("start").alias("starts")), "gone").withColumnsRenamed({"doc": "_doc", "mark": "_mark"})

    rows = docs.select(
        *([packed(docs)] if carry else []),
        F.col(id_col).alias("id"),
        key,
        text,
    ).withColumn("mark", mark)
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    kept = rows.join(gone, same, "left").select(*(["row"] if carry else []), "id", "text", "starts")
    front = kept.schema.fields[:-2]
    names = [f.name for f in front]
    schema = T.StructType([*front, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cut(text, starts, width) for text, starts in zip(utf8(batch.column("text")), batch.column("starts"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].decode() for x in out], pa.string())],
                [*names, "n_words", "n_removed", "kept"],
            )

    return kept.mapInArrow(cut, schema)


def _cut(text: bytes, starts: pa.ListScalar, width: int) -> tuple[int, int, bytes]:
    words = text.split()
    if not starts.is_valid:
        return len(words), 0, b" ".join(words)
    at = starts.values.to_numpy()
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    left = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return len(words), len(words) - len(left), b" ".join(left)


