"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

Texts and items are normalised alike: A-Z lower-cased, words of ASCII letters, digits and non-ASCII characters.  Each
item gives its windows of ``width`` consecutive words (one window if it has fewer), which executors build.  The
automaton reads words: each word of the benchmark is a number of a few digits, all others are one that no window has.
Digits are symbols, those of each place a set of their own, so that no match begins inside a word and no node has more
than DIGITS children.  A text is scanned once, some two steps a word; word positions are then mapped back to offsets of
the original text.

The windows are measured before they are gathered.  Up to ``block_words`` words of windows (about 150 bytes of a worker
each) make one automaton and one scan.  A larger benchmark is dealt into blocks by a hash of the window; texts are then scanned
block by block, each scan a written pass over the texts, in which a worker builds its one automaton once.

Edge cases: null and empty texts and items have no words; an item without words has no window; repeated items count
once per item id; a null item id is written as an empty string; a repeated document is judged again; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Shelf, packed, prepare
from quern.llm.text import FOLDED, utf8

#: Words of all windows of one automaton at most.
BLOCK_WORDS = 2_000_000
DIGITS = 64

RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]


Window = tuple[bytes, tuple[int, ...]]


def windows(item: bytes, width: int) -> set[bytes]:
    """The windows of an item, words one space apart."""
    words = item.translate(FOLDED).split()
    size = min(width, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def _table(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(window, items): the distinct windows with the sorted ids of the items that have them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name or "", w) for name, text in zip(batch.column("i").to_pylist(), utf8(batch.column("t")), strict=True) for w in windows(text, width)]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in found], pa.binary()), pa.array([x[0] for x in found], pa.string())], ["window", "item"])

    cuts = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInArrow(cut, "window binary, item string")
    return cuts.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(items: DataFrame, width: int, id_col: str, text_col: str, block_words: int, shelf: Shelf) -> Iterator[tuple]:
    """Broadcasts of each block's windows, and of the item ids that they refer to by number."""
    table = shelf.put(_table(items, width, id_col, text_col), "windows")
    words = table.agg(F.sum(F.size(F.split(F.col("window").cast("string"), " ")))).first()[0] or 0
    n_blocks = max(1, -(-int(words) // block_words))
    context = items.sparkSession.sparkContext
    for k in range(n_blocks):
        ids: dict[str, int] = {}
        part = table.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k)
        found = [(bytes(text), tuple(ids.setdefault(i, len(ids)) for i in who)) for text, who in part.toLocalIterator()]  # a block is bounded
        yield context.broadcast(found), context.broadcast(list(ids))


@functools.lru_cache(maxsize=1)
def _automaton(block) -> tuple[dict[bytes, str], int, ahocorasick.Automaton]:
    """block: a broadcast of windows.  The digits of each of their words, how many they are, and the automaton."""
    split = [text.split() for text, _ in block.value]
    words = dict.fromkeys(w for some in split for w in some)
    places = 1
    while DIGITS**places < len(words):
        places += 1
    digits = {w: "".join(chr(1 + p * DIGITS + n // DIGITS**p % DIGITS) for p in range(places)) for n, w in enumerate(words)}
    out = ahocorasick.Automaton()
    for some, (_, who) in zip(split, block.value, strict=True):
        out.add_word("".join([digits[w] for w in some]), (len(some), who))
    if split:
        out.make_automaton()
    return digits, places, out


def _scan(texts: list[bytes], block, names) -> list[tuple[list[bytes], list[tuple[int, int]], set[str]]]:
    """Words of each text, the hits (first word, words) in it and the items hit."""
    digits, places, machine = _automaton(block)
    other, out = "\0" * places, []
    for text in texts:
        words = text.translate(FOLDED).split()
        hits, items = [], set()
        if digits and words:
            for end, (size, who) in machine.iter("".join([digits.get(w, other) for w in words])):
                hits.append((end // places - size + 1, size))
                items.update([names.value[i] for i in who])
        out.append((words, hits, items))
    return out


def _judged(text: bytes, n_words: int, hits: list[tuple[int, int]], items: set[str]) -> tuple:
    if not hits:
        return n_words, 0, [], []
    change = np.zeros(n_words + 1, np.int32)
    at = np.array(sorted(set(hits)), np.int64)
    np.add.at(change, at[:, 0], 1)
    np.add.at(change, at[:, 0] + at[:, 1], -1)
    hit = np.cumsum(change[:-1]) > 0
    return n_words, int(hit.sum()), sorted(items), _spans(text, text.translate(FOLDED), hit)


def _spans(text: bytes, folded: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of hit words as code point offsets of the original text."""
    inside = np.frombuffer(folded, np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    flips = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(points[edge[2 * a]]), int(points[edge[2 * b - 1]])) for a, b in zip(flips[::2], flips[1::2], strict=True)]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Each input row as struct ``row``, with ``n_words, n_hit, item_ids`` (sorted strings) and ``spans`` (start, end:
    stretches of hit words in the original text)."""
    prepare(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "benchmark")
    pair = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())])
    frame = docs.select(packed(docs), F.col(text_col).alias("text"), F.lit(None).cast(T.ArrayType(pair)).alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    schema = T.StructType([frame.schema["row"], *RESULT])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    held = [pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])), pa.list_(pa.string())]

    def found(batch: pa.RecordBatch, block, names) -> Iterator[tuple[list[bytes], list, set[str]]]:
        for (words, hits, items), before, some in zip(_scan(utf8(batch.column("text")), block, names), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
            yield words, [*((x["first"], x["words"]) for x in before or ()), *hits], {*(some or ()), *items}

    def gathering(block, names):
        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                all_ = list(found(batch, block, names))
                hits = [[{"first": a, "words": n} for a, n in dict.fromkeys(x[1])] for x in all_]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(hits, held[0]), pa.array([sorted(x[2]) for x in all_], held[1])], ["row", "text", "hits", "items"])

        return gather

    def judging(block, names):
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [_judged(text, len(words), hits, items) for text, (words, hits, items) in zip(utf8(batch.column("text")), found(batch, block, names), strict=True)]
                columns = [pa.array([x[k] for x in out], kinds[k]) for k in range(3)]
                spans = pa.array([[{"start": a, "end": b} for a, b in x[3]] for x in out], kinds[3])
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns, spans], ["row", "n_words", "n_hit", "item_ids", "spans"])

        return judge

    last = None
    for block in _blocks(items, width, item_id_col, item_text_col, block_words, shelf):
        if last:  # a block that others follow: its hits go with the texts to the next scan
            frame = shelf.put(frame.mapInArrow(gathering(*last), frame.schema), "scanned")
        last = block
    return frame.mapInArrow(judging(*last), schema)
