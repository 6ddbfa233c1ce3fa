"""SimHash near-duplicates by tiled exact comparison.

Each text becomes one fingerprint of 64 or more bits; equal fingerprints are merged first.  The distinct ones are laid
out in tiles by the population counts of equal blocks of their bits.  Two fingerprints within the radius cannot differ
by more than the radius in the sum of their blocks' population counts, so only tile pairs within it are met; each such
pair is compared exactly, all against all, with numpy's exclusive or and bit counts.  The number of blocks rises with
the number of fingerprints, which thins the tile pairs: one block skips few, eight blocks skip all but one in 2,700.

A tile pair hands on a star per component that it finds, at most one row per fingerprint, never all pairs of a group.
Components over all tiles come from ``components``.

``one_of_each`` decides by the sets of shingles themselves.  Texts of equal sets are one node.  Only nodes that share
one of their least shingle hashes are compared at all: of the least LEAST hashes of two sets' union each is in both with
a chance of 0.8 or more, so that a pair as alike as asked shares none with a chance of 0.2 ** LEAST, under 1e-9, and
with none at all where LEAST reaches the sets' prefix.  So comparisons grow with the number of documents, not with its
square.  The nodes of a shared hash are met in tiles of 256-bit fingerprints, within a radius that such a pair exceeds
with a chance under 1e-9 (tiles of a very common hash are laid out by the number of shingles, and tiles of sizes that
are too far apart are skipped).  Each component of candidates is then cut into tiles of sets, and two nodes link if
their exact similarity (Jaccard, of 64-bit hashes of the shingles) is 0.8 or more.

Edge cases: a null, empty or wordless text has fingerprint zero, which links like any other; fewer words than the
shingle's length make one shingle of them all; repeated rows share everything; a component of only null ids has a
null id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Shelf, bits_of_power, packed, prepare
from quern.llm.components import components
from quern.llm.substrings import MOST_CELLS, UNIT_BITS, _cells, _in_cells
from quern.llm.text import LOWERED, utf8

#: Fingerprints of a tile: with a wide radius, under which most tiles meet, larger ones are sent about less.
TILE, WIDE_TILE, WIDE_RADIUS = 2048, 8192, 4
#: Shingles whose bits are counted at a time: bounds the memory of very long texts.
BIT_ROWS = 500_000
#: Blocks of bits, and about how many tiles' worth of population counts 64 random bits have with them.
SPREAD = {1: 14, 2: 100, 4: 2_500, 8: 390_000}
#: Near duplicates share this much of the union of their shingles: 4 / 5.
ALIKE, OF = 4, 5
#: Bits of a candidate's fingerprint, and those that may differ.  Each bit differs with the same chance, whatever the
#: texts: at a similarity of 0.8 it is 0.1875 for 4 and 5 shingles and at most 0.1611 beyond.  Unlike sets of under 4
#: shingles are never as alike.
MARK_BITS, FEWEST, RADIUS, SHORT_RADIUS = 256, 4, 80, 89
#: Candidates' sizes differ by 5 / 4 at most: bands of sizes, of which each meets itself and so many next ones.
NEXT_BANDS = 4
#: Least shingle hashes of a set by which it meets others.
LEAST = 13
#: Nodes of a bucket whose pairs are all compared at once with those of other such buckets.
FEW = 16
#: Nodes of a bucket that is one record; larger ones are laid out by sizes.
BUCKET = 256
#: Pairs of fingerprints that a task compares, about.
TASK_PAIRS = 2e8
#: Sets of a tile, and shingles of all its sets, about.
SETS, SET_SHINGLES = 512, 500_000


def shingle_hashes(text: bytes, words: int, repeats: bool) -> np.ndarray:
    """XXH64 (seed 42) of each shingle."""
    tokens = text.translate(LOWERED).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    pieces = [joined[a:b] for a, b in zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in (pieces if repeats else set(pieces))], np.uint64)
    return hashes if repeats else np.sort(hashes)


def _widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash and, for wider fingerprints, more 64-bit words drawn from it."""
    out = [hashes]
    for k in range(1, words):
        h = hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(h ^ (h >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(text: bytes, words: int = 3, bits: int = 64, repeats: bool = True) -> np.ndarray:
    """The fingerprint as uint64 words: a bit is 1 if it is set in over half the shingles' hashes."""
    return _majority(shingle_hashes(text, words, repeats), bits)


def _majority(hashes: np.ndarray, bits: int) -> np.ndarray:
    n = len(hashes)
    count = np.zeros(bits, np.int64)
    for k in range(0, n, BIT_ROWS * 64 // bits):
        part = _widened(hashes[k : k + BIT_ROWS * 64 // bits], bits // 64).view(np.uint8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int, repeats: bool, carry: bool) -> DataFrame:
    """(id, fp, pops): fp is big-endian, a 64-bit word at a time; pops has the population count of each byte."""
    prepare(docs.sparkSession)
    frame = docs.select(*([packed(docs)] if carry else []), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = frame.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("fp", T.BinaryType()), T.StructField("pops", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kept]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, bytes] = {}  # copies are often neighbours
            out = []
            for text in utf8(batch.column("text")):
                if text not in known:
                    known[text] = fingerprint(text, words, bits, repeats).astype(">u8").tobytes()
                out.append(known[text])
            pops = [np.bitwise_count(np.frombuffer(x, np.uint8)).tolist() for x in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary()), pa.array(pops, pa.list_(pa.int32()))], [*names, "fp", "pops"])

    return frame.mapInArrow(scan, schema)


def _blocks(n: int, radius: int) -> int:
    """Blocks of bits: the most with some hundred fingerprints to a tile; wide radii leave nothing to skip by blocks."""
    return max([k for k, spread in SPREAD.items() if k == 1 or radius <= WIDE_RADIUS and n >= 256 * spread])


def _offsets(blocks: int, radius: int) -> list[list[int]]:
    """Differences of population counts within the radius, one of each opposite two."""
    found, frontier = set(), {(0,) * blocks}
    for _ in range(radius + 1):
        found |= frontier
        frontier = {(*x[:i], x[i] + s, *x[i + 1 :]) for x in frontier for i in range(blocks) for s in (-1, 1)} - found
    return sorted([list(x) for x in found if x >= (0,) * blocks])


def _tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the joined list of a and b (a alone if same) that lie within the radius."""
    left, right = [], []
    for k in range(0, len(a), 256):
        far = np.zeros((len(a[k : k + 256]), len(b)), np.uint8)
        for w in range(min(2, a.shape[1])):  # the first 128 bits alone rule out nearly all
            far += np.bitwise_count(a[k : k + 256, w, None] ^ b[None, :, w])
        i, j = np.nonzero(far <= radius)
        i = i + k
        if same:
            i, j = i[i < j], j[i < j]
        for m in range(0, len(i), 1 << 20):
            x, y = i[m : m + (1 << 20)], j[m : m + (1 << 20)]
            near = np.bitwise_count(a[x] ^ b[y]).sum(axis=1, dtype=np.int64) <= radius
            left.append(x[near])
            right.append(y[near] if same else y[near] + len(a))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that links lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def links(nodes: DataFrame, bits: int, radius: int, shelf: Shelf) -> DataFrame:
    """Distinct (fp, pops) to links (a, b) that connect all fingerprints within the radius."""
    blocks = _blocks(nodes.count(), radius)
    per = bits // 8 // blocks
    sums = [sum((F.col("pops")[k * per + i] for i in range(1, per)), F.col("pops")[k * per]) for k in range(blocks)]
    signed = nodes.select("fp", F.array(*sums).alias("sig"))
    tile = TILE if radius <= WIDE_RADIUS else WIDE_TILE
    sizes = signed.groupBy("sig").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = shelf.put(
        signed.join(shelf.put(sizes, "sizes"), "sig").withColumn("part", F.pmod(F.xxhash64("fp"), "parts")).groupBy("sig", "part").agg(F.collect_list("fp").alias("fps")), "tiles"
    )
    steps = F.array(*[F.array(*map(F.lit, x)) for x in _offsets(blocks, radius)])
    near = tiles.select(F.col("sig").alias("from"), F.col("part").alias("part_a"), F.col("fps").alias("fps_a"), F.explode(steps).alias("step")).select(
        "part_a", "fps_a", F.zip_with("from", "step", lambda x, y: x + y).alias("sig"), F.exists("step", lambda x: x != 0).alias("apart")
    )
    pairs = near.join(tiles, "sig").where("apart OR part_a <= part").select("fps_a", "fps", (F.expr("NOT apart AND part_a = part")).alias("same"))
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    width = bits // 64

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(batch.column("fps_a"), batch.column("fps"), batch.column("same").to_pylist(), strict=True):
                first, second = x.as_py(), y.as_py()
                a = np.frombuffer(b"".join(first), ">u8").astype(np.uint64).reshape(-1, width)
                b = np.frombuffer(b"".join(second), ">u8").astype(np.uint64).reshape(-1, width)
                i, j = _tile_links(a, b, same, radius)
                if not len(i):
                    continue
                names = first if same else first + second
                root = stars(i, j, len(names))
                moved = np.flatnonzero(root != np.arange(len(names))).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([names[root[k]] for k in moved], pa.binary()), pa.array([names[k] for k in moved], pa.binary())], ["a", "b"])

    # tile pairs differ in size and number with the data: deal them out evenly
    return pairs.repartition(_tasks(tiles)).mapInArrow(compare, schema)


def _tasks(tiles: DataFrame) -> int:
    n = tiles.count()
    return int(min(20_000, max(tiles.sparkSession.sparkContext.defaultParallelism, n * 2)))


def near_duplicates(
    docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 2, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """``id, fp, component, root``: the least id reachable over links of at most ``radius`` differing bits, and the least
    fingerprint; with ``carry`` the input row comes first, as struct ``row``."""
    shelf = Shelf(docs.sparkSession, "simhash")
    marked = shelf.put(fingerprints(docs, id_col, text_col, words, bits, repeats, carry), "marked")
    nodes = shelf.put(marked.groupBy("fp").agg(F.min("id").alias("least"), F.first("pops").alias("pops")), "nodes")
    roots = components(links(nodes, bits, radius, shelf), shelf)
    classes = _classes(nodes, "fp", roots, shelf)
    return marked.drop("pops").join(classes, "fp").select(*(["row"] if carry else []), "id", "fp", "component", "root")


def _classes(nodes: DataFrame, name: str, roots: DataFrame, shelf: Shelf) -> DataFrame:
    """Of each node its root, itself without links, and the least id of the root's nodes."""
    linked = roots.join(nodes.select(F.col(name).alias("node"), "least"), "node")
    named = shelf.put(linked.groupBy("root").agg(F.min("least").alias("component")), "named")
    return shelf.put(
        nodes.join(roots, nodes[name] == roots["node"], "left").join(named, "root", "left").select(name, F.coalesce("root", name).alias("root"), F.coalesce("component", "least").alias("component")),
        "classes",
    )


def _least(hashes: np.ndarray) -> np.ndarray:
    """The hashes, given in order, by which a set meets others: those of its prefix, of which sets as alike as asked
    share one, up to LEAST.  Sets of under FEWEST shingles are alike only if equal."""
    n = len(hashes)
    return hashes[: min(LEAST, n - -(-ALIKE * n // OF) + 1)] if n >= FEWEST else hashes[:0]


def _set_marks(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(row, id, key, n, fp, low): key and size of the text's set of shingles, its fingerprint and least hashes."""
    prepare(docs.sparkSession)
    frame = docs.select(packed(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("low", T.ArrayType(T.LongType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, tuple] = {}  # copies are often neighbours
            out = []
            for text in utf8(batch.column("text")):
                if text not in known:
                    hashes = shingle_hashes(text, words, repeats=False)
                    known[text] = (xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), _majority(hashes, MARK_BITS).tobytes(), _least(hashes).view(np.int64))
                out.append(known[text])
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *columns], ["row", "id", "key", "n", "fp", "low"])

    return frame.mapInArrow(scan, schema)


def _wide_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within a wide radius, by positions in the joined list of a and b (a alone if same)."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = len(a) if same else len(a) + len(b)
    columns = [np.ascontiguousarray(b[:, w]) for w in range(b.shape[1])]
    rows = max(1, 65_536 // max(1, len(b)))
    for k in range(0, len(a), rows):
        begin = k if same else 0
        far = np.zeros((len(a[k : k + rows]), len(b) - begin), np.uint8)  # 256 becomes 0, a candidate too many
        for w, column in enumerate(columns):
            far += np.bitwise_count(a[k : k + rows, w, None] ^ column[None, begin:])
        i, j = np.nonzero(far <= radius)
        i, j = i + k, j + begin
        if same:
            i, j = i[i < j], j[i < j]
        else:
            j = j + len(a)
        if len(i) > total:  # a large group: a star of each component
            label = stars(i, j, total)
            j = np.flatnonzero(label != np.arange(total))
            i = label[j]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _few_links(buckets: list[np.ndarray], radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, i, j) of all pairs within the radius in small buckets, those of one size a step."""
    by_size: dict[int, list[int]] = {}
    for k, some in enumerate(buckets):
        if len(some) > 1:
            by_size.setdefault(len(some), []).append(k)
    for size, which in by_size.items():
        i, j = np.triu_indices(size, 1)
        for begin in range(0, len(which), max(1, 200_000 // len(i))):
            ks = which[begin : begin + max(1, 200_000 // len(i))]
            marks = np.stack([buckets[k] for k in ks])
            far = np.bitwise_count(marks[:, i] ^ marks[:, j]).sum(axis=2, dtype=np.int64)
            for at in np.flatnonzero((far <= radius).any(axis=1)).tolist():
                near = far[at] <= radius
                yield ks[at], i[near], j[near]


def candidates(nodes: DataFrame, shelf: Shelf) -> DataFrame:
    """Distinct (key, n, fp, low) to links (a, b) of keys that connect all pairs that may be alike."""
    marked = F.concat("key", F.when(F.col("n") <= FEWEST, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), "fp").alias("mark")
    # bands a hair narrower than sizes allow, lest rounding puts sizes of 4 and 5 further apart
    band = F.floor(F.log(F.col("n").cast("double")) * F.lit((NEXT_BANDS - 1e-6) / float(np.log(OF / ALIKE)))).cast("int")
    met = nodes.select("key", F.explode("low").alias("t"))
    counts = shelf.put(met.groupBy("t").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    shared = nodes.select(band.alias("band"), marked, F.explode("low").alias("t")).join(counts, "t")
    few = shared.where(F.col("m") <= BUCKET).groupBy("t").agg(F.collect_list("mark").alias("marks"))
    few = few.select(F.col("marks").alias("marks_a"), F.array().cast("array<binary>").alias("marks"), F.lit(True).alias("same"))
    # a hash that many sets have: tiles by sizes, of which each meets itself and those of sizes within reach
    hot = shared.where(F.col("m") > BUCKET)
    sizes = shelf.put(hot.groupBy("t", "band").agg(F.ceil(F.count("*") / WIDE_TILE).alias("parts")), "sizes")
    dealt = hot.join(sizes, ["t", "band"]).withColumn("part", F.pmod(F.xxhash64("mark"), "parts"))
    tiles = shelf.put(dealt.groupBy("t", "band", "part").agg(F.collect_list("mark").alias("marks")), "tiles")
    steps = F.explode(F.sequence(F.lit(0), F.lit(NEXT_BANDS))).alias("step")
    near = tiles.select("t", F.col("band").alias("from"), F.col("part").alias("part_a"), F.col("marks").alias("marks_a"), steps)
    near = near.withColumn("band", F.col("from") + F.col("step")).drop("from")
    pairs = near.join(tiles, ["t", "band"]).where("step > 0 OR part_a <= part").select("marks_a", "marks", F.expr("step = 0 AND part_a = part").alias("same"))

    def radius(marks: list[bytes]) -> int:
        return SHORT_RADIUS if any(x[16] for x in marks) else RADIUS

    def bits(marks: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join([x[17:] for x in marks]), np.uint64).reshape(-1, MARK_BITS // 64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small: dict[int, list[list[bytes]]] = {RADIUS: [], SHORT_RADIUS: []}
            found: list[tuple[bytes, bytes]] = []
            for x, y, same in zip(batch.column("marks_a"), batch.column("marks"), batch.column("same").to_pylist(), strict=True):
                first, second = x.as_py(), y.as_py()
                reach = radius(first)
                if same and len(first) <= FEW:
                    small[reach].append(first)
                    continue
                i, j = _wide_links(bits(first), bits(second), same, reach)
                if not len(i):
                    continue
                names = first if same else first + second
                root = stars(i, j, len(names))
                found += [(names[root[k]][:16], names[k][:16]) for k in np.flatnonzero(root != np.arange(len(names))).tolist()]
            for reach, buckets in small.items():
                for k, i, j in _few_links([bits(b) for b in buckets], reach):
                    found += [(buckets[k][a][:16], buckets[k][b][:16]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            found = list(dict.fromkeys(found))  # a pair often shares several hashes
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    links = few.mapInArrow(compare, "a binary, b binary")
    # tile pairs differ in size and number with the data: deal them out evenly
    squares = tiles.agg(F.sum(F.size("marks").cast("double") ** 2)).first()[0] or 0.0
    tasks = int(min(20_000, max(nodes.sparkSession.sparkContext.defaultParallelism, (NEXT_BANDS + 1) * squares / TASK_PAIRS)))
    return links.unionByName(pairs.repartition(tasks).mapInArrow(compare, "a binary, b binary"))


def alike(names: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """A star for each group of sets that exact similarities of 0.8 or more connect.  Each set reached is compared with
    those not yet reached, so that a group of near copies takes one round, not all pairs."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes).tolist()
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = [place[e - len(x) : e] for x, e in zip(sets, ends, strict=True)]
    here = np.zeros(len(place), bool)
    out, left = [], np.arange(len(names))
    while len(left) > 1:
        center = int(left[0])
        reached, left, at = [center], left[1:], 0
        while at < len(reached) and len(left):
            k = reached[at]
            here[held[k]] = True
            fits = np.flatnonzero((OF * np.minimum(sizes[left], sizes[k]) >= ALIKE * np.maximum(sizes[left], sizes[k])))
            shared = np.array([np.count_nonzero(here[held[m]]) for m in left[fits].tolist()], np.int64)
            here[held[k]] = False
            near = np.zeros(len(left), bool)
            near[fits] = OF * shared >= ALIKE * (sizes[left[fits]] + sizes[k] - shared)
            out += [(names[center], names[m]) for m in left[near].tolist()]
            reached += left[near].tolist()
            left = left[~near]
            at += 1
    return out


def _verified(roots: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, shelf: Shelf) -> DataFrame:
    """Components of candidates (node, root) and all (key, text) to links (a, b) of keys that connect what is alike."""
    spark = nodes.sparkSession
    members = shelf.put(roots.join(nodes, roots["node"] == nodes["key"]).select("key", "root", "n"), "members")
    parts = F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / SET_SHINGLES)).alias("parts")
    sizes = shelf.put(members.groupBy("root").agg(parts), "parts")
    cell_bits = min(bits_of_power(MOST_CELLS), max(UNIT_BITS, bits_of_power(8 * members.count())))

    def hashed(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    # a bit array of the keys wanted: the texts of all others aren't dealt out
    wanted = spark.sparkContext.broadcast(_cells(members.select("key"), lambda batch: iter([hashed(batch.column("key"))]), cell_bits, (1,), shelf)[0])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = batch.take(pa.array(_in_cells(wanted.value, *hashed(batch.column("key")), cell_bits)))
            first = dict(zip(here.column("key").to_pylist(), utf8(here.column("text")), strict=True))
            found = [shingle_hashes(text, words, repeats=False).tobytes() for text in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), pa.array(found, pa.binary())], ["key", "shingles"])

    fetched = shelf.put(texts.mapInArrow(fetch, "key binary, shingles binary").dropDuplicates(["key"]), "shingles")
    dealt = fetched.join(members.join(sizes, "root"), "key").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))
    tiles = shelf.put(dealt.groupBy("root", "parts", "part").agg(F.collect_list(F.struct("key", "shingles")).alias("sets")), "sets")
    # a component of several tiles is compared tile by tile
    left, right = (tiles.where("parts > 1").select("root", F.col("part").alias(f"part_{k}"), F.col("sets").alias(f"sets_{k}")) for k in "ab")
    paired = left.join(right, "root").where("part_a < part_b").select(F.concat("sets_a", "sets_b").alias("sets"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for sets in batch.column("sets"):
                some = sets.as_py()
                found += alike([x["key"] for x in some], [np.frombuffer(x["shingles"], np.uint64) for x in some])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return shelf.put(tiles.select("sets").unionByName(paired).mapInArrow(verify, "a binary, b binary").distinct(), "alike")


def one_of_each(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each near-duplicate group's row of least id, as struct ``row``.

    Texts link if the Jaccard similarity of their sets of shingles of ``words`` words is 0.8 or more; groups are the
    components of these links.  Repeated rows are one row."""
    shelf = Shelf(docs.sparkSession, "simhash")
    marked = shelf.put(_set_marks(docs, id_col, text_col, words), "marked")
    nodes = shelf.put(marked.groupBy("key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("low").alias("low")), "nodes")
    maybe = components(candidates(nodes, shelf), shelf)
    texts = marked.select("key", F.col("row").getField(text_col).alias("text"))
    roots = components(_verified(maybe, nodes, texts, words, shelf), shelf)
    found = marked.select("row", "id", "key").join(_classes(nodes.select("key", "least"), "key", roots, shelf), "key")
    kept = found.where(F.col("id").eqNullSafe(F.col("component")))
    seen = docs.agg(F.count("*"), F.countDistinct(id_col)).first()
    return (kept if seen[0] == seen[1] else kept.dropDuplicates(["root"])).select("row")
