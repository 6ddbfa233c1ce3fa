"""Line dedup by a segment-partition edit join.

Two lines are alike if they differ by at most ``most`` edits (insertions, deletions, changes of code points) and by no
more than one edit for each ``chars_per_edit`` code points of the shorter line: so lines of under 6 code points must be
equal, those of under 12 may differ by one edit and longer ones by two.  Without such a scale all lines of two letters
would be alike.

Two lines within ``most`` edits share one of the ``most`` + 1 even segments of the shorter line, at nearly the same
place.  Each distinct line is indexed by its segments, keyed by
(length, segment, hash); it probes the segments of all lengths from its own down to its own less ``most``, at the
places that the multi-match-aware bounds leave.  Bit arrays of the indexed keys keep probes at home that cannot meet
another line.  Lines that meet under a key are a bucket; a bucket is verified by a banded bit-parallel edit distance,
thousands of pairs a step, until all its lines are reached or ruled out.  Large buckets are cut in tiles.

Lines within reach of one another, directly or over others, are one class; the first
line of a class (least id, then line number) stays and its others go.

Edge cases: blank lines always stay and are no members; a null text is empty and has one blank line; a null id comes after all others; rows that share an id count as
one document, so that neither is earlier at equal line numbers; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Shelf, bits_of_power, packed, prepare
from quern.llm.components import components
from quern.llm.substrings import UNIT_BITS, _cells, _in_cells

_BASE = 0x9E3779B97F4A7C15
#: Cells of a sketch row at most: each bit array is 32 MB then.
MOST_CELLS = 2**27
#: Code points of lines that are hashed at once; a longer line is hashed alone.
RUN_CHARS = 500_000
#: Lines of a bucket that are compared at a time.
BUCKET = 1024
#: Lines of a bucket whose pairs are all listed.
SMALL = 64


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of the base and of its inverse, modulo 2**64: pieces that collide are told apart later."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(1 << bits, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Lines:
    """Lines with a hash of any piece of them at hand."""

    def __init__(self, lines: list[str]):
        self.size = np.array([len(x) for x in lines], np.int64)
        self.at = np.cumsum(self.size) - self.size
        points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        power, self.inverse = _powers(bits_of_power(max(1 << 20, len(points) + 1)))
        self.upto = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * power[: len(points)], out=self.upto[1:])

    def keys(self, who: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
        """Of the piece of each line ``who``: the key under which it is segment ``segment`` of a line of ``length``."""
        a = self.at[who] + start
        piece = (self.upto[a + size] - self.upto[a]) * self.inverse[a]
        return _mixed(_mixed(piece) ^ _mixed(length.astype(np.uint64) * np.uint64(64) + np.uint64(segment)))

    def indexed(self, most: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(line, key) of each segment."""
        who = np.flatnonzero(self.size >= least)
        for k in range(most + 1):
            start, size = segment(self.size[who], k, most)
            yield who, self.keys(who, start, size, self.size[who], k)

    def probes(self, most: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(line, key, whether the line itself is indexed under it) of each piece that may meet a segment."""
        for less in range(most + 1):
            long = np.flatnonzero(self.size - less >= least)
            length = self.size[long] - less
            for k in range(most + 1):
                start, size = segment(length, k, most)
                low = np.maximum(0, np.maximum(start - k, start + less - (most - k)))
                high = np.minimum(self.size[long] - size, np.minimum(start + k, start + less + (most - k)))
                for shift in range(-most, 2 * most + 1):
                    fits = np.flatnonzero((start + shift >= low) & (start + shift <= high))
                    if len(fits):
                        yield long[fits], self.keys(long[fits], start[fits] + shift, size[fits], length[fits], k), less == 0 and shift == 0


def segment(length: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the k-th of ``most`` + 1 even segments; the last ones are the longer."""
    parts = most + 1
    base, longer = length // parts, length % parts
    before = np.maximum(0, k - (parts - longer))
    return k * base + before, base + (k >= parts - longer)


def _runs(lines: list[str]) -> Iterator[tuple[int, _Lines]]:
    begin, size = 0, 0
    for k, line in enumerate(lines):
        if size + len(line) > RUN_CHARS and k > begin:
            yield begin, _Lines(lines[begin:k])
            begin, size = k, 0
        size += len(line)
    if begin < len(lines):
        yield begin, _Lines(lines[begin:])


def allowed(first: list[str], second: list[str], most: int, scale: int) -> np.ndarray:
    """Edits that each pair may differ by."""
    return np.array([min(most, min(len(a), len(b)) // scale) for a, b in zip(first, second, strict=True)], np.int64)


def within(first: list[str], second: list[str], most: int, scale: int = 0) -> np.ndarray:
    """Whether each pair is within ``most`` edits, and one edit for each ``scale`` code points of the shorter (if given):
    bit-parallel columns of a band of 2 * most + 1 rows, all pairs a step.

    Bit k of a column j is row j - most + k.  Rows above the first are those of an endless prefix, |row| + j edits."""
    out = np.zeros(len(first), bool)
    order = np.argsort([max(len(a), len(b)) for a, b in zip(first, second, strict=True)], kind="stable")
    for begin in range(0, len(order), 2048):
        some = order[begin : begin + 2048]
        a, b = [first[k] for k in some], [second[k] for k in some]
        out[some] = _band(a, b, most) <= (allowed(a, b, most, scale) if scale else most)
    return out


def _band(first: list[str], second: list[str], most: int) -> np.ndarray:
    """The edits of each pair, or more than ``most`` where there are more."""
    rows, columns = np.array([len(x) for x in first]), np.array([len(x) for x in second])
    apart, width = rows - columns, int(columns.max(initial=0))
    full, one = np.uint64((1 << (2 * most + 1)) - 1), np.uint64(1)
    top = np.uint64(1 << (2 * most))
    a = np.zeros((width + 2 * most + 2, len(first)), np.uint32)
    b = np.zeros((width + 1, len(first)), np.uint32)
    for k, (x, y) in enumerate(zip(first, second, strict=True)):
        p, q = np.frombuffer(x.encode("utf-32-le"), np.uint32), np.frombuffer(y.encode("utf-32-le"), np.uint32)
        p = p[: width + most + 1]
        a[most + 1 : most + 1 + len(p), k] = p + 1  # row i is at most + i
        b[1 : 1 + len(q), k] = q + 1
    bit = np.clip(most + apart, 0, 2 * most).astype(np.uint64)  # of the diagonal that ends in the last cell
    score = np.abs(apart)
    up = np.full(len(first), int(full) ^ ((1 << (most + 1)) - 1), np.uint64)
    down = np.full(len(first), (1 << (most + 1)) - 1, np.uint64)
    begin = np.maximum(0, -apart)
    for j in range(1, width + 1):
        up, down = (up >> one) | top, down >> one
        same = np.zeros(len(first), np.uint64)
        for k in range(2 * most + 1):
            same |= (a[j + k] == b[j]).astype(np.uint64) << np.uint64(k)
        x = same | down
        level = (((up + (x & up)) ^ up) | x) & full
        plus, minus = (down | ~(level | up)) & full, level & up
        plus, minus = (plus << one) | one, minus << one
        up, down = (minus | ~(level | plus)) & full, level & plus & full
        live = (j > begin) & (j <= columns)
        score = score + (live & ((level >> bit) & one == 0))
        if j % 64 == 0 and (score > most).all():
            break
    return np.where(np.abs(apart) <= most, score, most + 1)


def _letters(texts: list[str]) -> np.ndarray:
    """How often code points of each of 64 classes stand in each text."""
    out = np.zeros((len(texts), 64), np.int32)
    for k, text in enumerate(texts):
        out[k] = np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) & 63, minlength=64)
    return out


def _stars(names: list[bytes], texts: list[str], letters: np.ndarray, most: int, scale: int) -> list[tuple[bytes, bytes]]:
    """A star for each set of lines of a large bucket that edits connect.  Each line reached is compared with those not
    yet reached, so that a bucket of alike lines takes one round, not all pairs."""
    out, left = [], np.arange(len(names))
    while len(left) > 1:
        center, at = int(left[0]), 0
        reached, left = [center], left[1:]
        while at < len(reached) and len(left):
            close = np.flatnonzero(np.abs(letters[left] - letters[reached[at]]).sum(axis=1) <= 2 * most)
            near = np.zeros(len(left), bool)
            if len(close):
                near[close] = within([texts[reached[at]]] * len(close), [texts[k] for k in left[close]], most, scale)
            out += [(names[center], names[k]) for k in left[near]]
            reached += left[near].tolist()
            left = left[~near]
            at += 1
    return out


def _connected(buckets: Iterator[tuple[list[bytes], list[str]]], most: int, scale: int) -> list[tuple[bytes, bytes]]:
    """Links that connect the lines of each bucket.  An edit changes the counts of letters by two at most, which rules
    out most pairs before any edit distance; what is left of small buckets is verified together."""
    out, pairs = [], []
    for names, texts in buckets:
        letters = _letters(texts)
        if len(names) > SMALL:
            out += _stars(names, texts, letters, most, scale)
            continue
        near = np.abs(letters[:, None] - letters[None]).sum(axis=2) <= 2 * most
        pairs += [(names[i], names[j], texts[i], texts[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    if pairs:
        near = within([p[2] for p in pairs], [p[3] for p in pairs], most, scale)
        out += [p[:2] for p, x in zip(pairs, near, strict=True) if x]
    return out


def _split(text: str) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines that aren't blank."""
    return ((no, line) for no, line in enumerate(text.split("\n")) if line.strip(" "))


def _line_id(line: str) -> bytes:
    return hashlib.md5(line.encode(), usedforsecurity=False).digest()


def _short(ids: list[bytes]) -> np.ndarray:
    """The first half of each line id, as a number."""
    return np.frombuffer(b"".join(x[:8] for x in ids), np.int64)


def _distinct_lines(batch: pa.RecordBatch) -> list[str]:
    return list(dict.fromkeys(line for text in batch.column("text").to_pylist() for _, line in _split(text)))


def _line_links(texts: DataFrame, n_lines: int, most: int, scale: int, shelf: Shelf) -> DataFrame:
    """Texts to links (a, b) of line ids that connect all lines that are alike."""
    least = scale  # shorter lines are alike only if equal
    spark = texts.sparkSession
    cell_bits = min(bits_of_power(MOST_CELLS), max(UNIT_BITS, bits_of_power(8 * n_lines * (most + 1))))

    def indexed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, run in _runs(_distinct_lines(batch)):
            keys = np.concatenate([k for _, k in run.indexed(most, least)])
            yield keys, _mixed(keys)

    some, several = map(spark.sparkContext.broadcast, _cells(texts, indexed, cell_bits, (1, 2), shelf))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = _distinct_lines(batch)
            names = _short([_line_id(x) for x in lines])
            for begin, run in _runs(lines):
                out = [(who, keys, False) for who, keys in run.indexed(most, least)]
                for who, keys, own in run.probes(most, least):
                    met = _in_cells((several if own else some).value, keys, _mixed(keys), cell_bits)
                    out.append((who[met], keys[met], True))
                who, keys = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
                probe = np.repeat([x[2] for x in out], [len(x[0]) for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(names[begin + who]), pa.array(probe)], ["key", "h", "probe"])

    rows = shelf.put(texts.mapInArrow(emit, "key long, h long, probe boolean"), "segments")
    # buckets in which a line that probes meets another; a line counts as often as batches have it
    buckets = rows.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.max("probe").alias("met"), F.count("*").alias("n")).where("met AND x <> y")
    met = rows.select("key", "h").join(buckets.select("key", F.ceil(F.col("n") / BUCKET).alias("parts")), "key")
    members = shelf.put(met.distinct(), "members")

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = _mixed(batch.column("h").to_numpy().view(np.uint64))
        yield h, _mixed(h)

    wanted = spark.sparkContext.broadcast(_cells(members.select("h"), keys_of, cell_bits, (1,), shelf)[0])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = _distinct_lines(batch)
            ids = [_line_id(x) for x in lines]
            h = _mixed(_short(ids).view(np.uint64))
            here = _in_cells(wanted.value, h, _mixed(h), cell_bits).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(_short([ids[k] for k in here])), pa.array([ids[k] for k in here], pa.binary()), pa.array([lines[k] for k in here], pa.string())], ["h", "line_id", "line"])

    fetched = shelf.put(texts.mapInArrow(fetch, "h long, line_id binary, line string").dropDuplicates(["line_id"]), "texts")
    dealt = members.join(fetched, "h").withColumn("part", F.pmod(F.xxhash64("h"), "parts"))
    tiles = shelf.put(dealt.groupBy("key", "parts", "part").agg(F.collect_list("line_id").alias("ids"), F.collect_list("line").alias("texts")), "tiles")
    # a bucket of several tiles is compared tile by tile
    alone = tiles.select("ids", "texts")
    left, right = (tiles.where("parts > 1").select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("part", "ids", "texts")]) for k in "ab")
    paired = left.join(right, "key").where("part_a < part_b").select(F.concat("ids_a", "ids_b").alias("ids"), F.concat("texts_a", "texts_b").alias("texts"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _connected(((ids.as_py(), some.as_py()) for ids, some in zip(batch.column("ids"), batch.column("texts"), strict=True)), most, scale)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return shelf.put(alone.unionByName(paired).mapInArrow(verify, "a binary, b binary").distinct(), "links")


def dedup(docs: DataFrame, most: int = 2, chars_per_edit: int = 6, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``id, n_lines, n_removed`` and ``kept`` (the kept lines joined by line feeds); with ``carry`` the input row comes
    first, as struct ``row``."""
    if chars_per_edit <= most:
        raise ValueError("lines need a code point for each of most + 1 segments")
    spark = docs.sparkSession
    prepare(spark)
    shelf = Shelf(spark, "lines")
    key = F.col(id_col).alias("doc")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    seen = docs.select(key, text).agg(F.count("*"), F.countDistinct("doc"), F.sum(n_lines), F.count_if(F.col("doc").isNull())).first()
    mark = F.lit(0).cast("long") if seen[0] == seen[1] + min(1, seen[3]) else F.xxhash64("text")
    texts = docs.select(key, text).withColumn("mark", mark)

    kind = texts.schema["doc"].dataType.simpleString()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, no, _line_id(line)) for k, whole in enumerate(batch.column("text").to_pylist()) for no, line in _split(whole)]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(at), batch.column("mark").take(at), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())], ["doc", "mark", "no", "line_id"])

    placed = shelf.put(texts.mapInArrow(occurrences, f"doc {kind}, mark long, no int, line_id binary"), "occurrences")
    links = _line_links(texts.select("text"), int(seen[2] or 0), most, chars_per_edit, shelf)
    roots = components(links, shelf).select(F.col("node").alias("line_id"), F.col("root").alias("class"))
    # lines that occur again or have links; all others are out of it
    again = placed.groupBy("line_id").agg(F.count("*").alias("n")).where("n > 1").select("line_id", F.col("line_id").alias("class"))
    classes = shelf.put(roots.unionByName(again.join(roots.select("line_id"), "line_id", "left_anti")), "classes")
    there = shelf.put(placed.join(classes, "line_id"), "there")
    place = F.struct(F.col("doc").isNull(), "doc", "no")  # a null id comes last
    first = shelf.put(there.groupBy("class").agg(F.min(place).alias("first")), "first")
    gone = there.join(first, "class").where(place > F.col("first"))
    marks = shelf.put(gone.groupBy("doc", "mark").agg(F.collect_list("no").alias("gone")), "gone")

    def row_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h = batch.column("h").to_numpy().view(np.uint64)
        return h, _mixed(h)

    row_hash = F.xxhash64("doc", "mark").alias("h")
    # a bit array of the documents that lose lines: the texts of all others aren't dealt out
    bits = min(bits_of_power(MOST_CELLS), max(UNIT_BITS, bits_of_power(8 * int(seen[0]))))
    losing = spark.sparkContext.broadcast(_cells(marks.select(row_hash), lambda batch: iter([row_hashes(batch)]), bits, (1,), shelf)[0])
    rows = docs.select(*([packed(docs)] if carry else []), F.col(id_col).alias("id"), key, text).withColumn("mark", mark).withColumn("h", row_hash)
    front = rows.schema.fields[:-4]
    names = [f.name for f in front]
    schema = T.StructType([*front, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
        out = []
        for whole, off in zip(batch.column("text").to_pylist(), gone, strict=True):
            parts, off = whole.split("\n"), set(off or ())
            out.append((len(parts), len(off), "\n".join(x for k, x in enumerate(parts) if k not in off)))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
            [*names, "n_lines", "n_removed", "kept"],
        )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ones(batch.num_rows, bool)
            out[_in_cells(losing.value, *row_hashes(batch), bits)] = False
            yield cut(batch.filter(pa.array(out)), [None] * int(out.sum()))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(_in_cells(losing.value, *row_hashes(batch), bits)))

    def cut_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch, batch.column("gone").to_pylist())

    # the lists of lines have no size bound: never broadcast, and one plan at every size
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    marks = marks.withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    changed = rows.mapInArrow(touched, rows.schema).join(marks.hint("merge"), same, "left").mapInArrow(cut_marked, schema)
    return rows.mapInArrow(untouched, schema).unionByName(changed)
