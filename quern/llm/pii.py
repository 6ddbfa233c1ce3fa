"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns find emails, addresses, card and phone numbers in their usual forms; these spans always stay.  The field
adds spans in other forms (local phone numbers, 15-digit cards, spelled-out or defanged emails and addresses).  It is
trained on the driver by gradient ascent of the conditional likelihood, from a small labelled table of texts and spans
(an argument; ``pii_examples`` has the default), and its weights go to the workers.  Every token of every text is
decoded by Viterbi over padded numpy batches.  Line breaks are outside and part sequences; a line of more than PIECE
tokens is decoded in pieces that see MARGIN tokens of their neighbours.  A decoded span is added only if it touches no
pattern span and has the digits that its kind needs.

Offsets are code points, the end exclusive.  Edge cases: a null text is empty and has no span; repeated rows give
the same spans; an empty table gives an empty result; without labelled rows the field adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import pii_examples
from quern.llm.common import packed, prepare

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
#: Labelled rows that the field is trained from at most, those of least hash.
TRAIN_ROWS = 5_000
#: Tokens of a piece, and tokens on either side of it that are decoded with it.
PIECE, MARGIN = 120, 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# maximal runs of digits, so that a failing start is not tried again inside its run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_|\n")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


_TLDS = frozenset("com org net edu gov info io de fr es uk ru it".split())
_CUES = frozenset(
    "at dot tel phone telephone call fax mobile cell mail email visa amex card credit karte tarjeta number ring dial token password key order id isbn version year page ip host server "
    "address telefon téléphone tél teléfono llame whatsapp contact write reach".split()
)
#: Shapes that have no letter of their own: beyond the text's ends and at line breaks; never seen in training.
NONE, UNSEEN = 0, 1


def shape(token: str) -> str:
    """The token's word shape: digits by count, letters by case, punctuation as it is, cue words as they are."""
    low = token.lower()
    if low in _CUES:
        return low
    if low in _TLDS:
        return "tld"
    if token.isascii() and token.isdigit():
        return f"9x{min(len(token), 20)}{'z' if token[0] == '0' else ''}"
    if token.isalpha():
        return "A" if token.isupper() else "Aa" if token[0].isupper() else "a"
    return "a9" if any(c.isdigit() for c in token) else token if len(token) == 1 else "a_"


class Field:
    """Weights by (feature, tag) and (tag, tag).  The features of a token are the shapes in a window around it."""

    OFFSETS = (-3, -2, -1, 0, 1, 2, 3)

    def __init__(self, examples: list[tuple[str, list[Span]]], rounds: int = 40, rate: float = 0.25, penalty: float = 3e-4, batch: int = 32):
        data = [_tagged(text, spans) for text, spans in examples]
        self.shapes = {s: k + 2 for k, s in enumerate(sorted({shape(t) for tokens, _ in data for t in tokens if t != "\n"}))}
        n, tags = len(self.shapes) + 2, len(TAGS)
        self.emit = np.zeros((len(self.OFFSETS), n, tags))
        self.step = np.zeros((tags, tags))
        self._known: dict[str, int] = {}
        seen = [np.full_like(self.emit, 1e-2), np.full_like(self.step, 1e-2)]
        coded = [(self.codes(tokens), np.array(gold, np.int64)) for tokens, gold in data if tokens]
        # sequences of like lengths, in an order of their own
        coded = [coded[k] for k in sorted(range(len(coded)), key=lambda k: (len(coded[k][0]), k))]
        batches = [_padded(coded[k : k + batch]) for k in range(0, len(coded), batch)]
        order = np.random.default_rng(5)
        for _ in range(rounds):  # adaptive gradient steps
            for k in order.permutation(len(batches)):
                d_emit, d_step = self.gradient(*batches[k])
                d_emit -= penalty * self.emit
                seen[0] += d_emit**2
                self.emit += rate * d_emit / np.sqrt(seen[0])
                seen[1] += d_step**2
                self.step += rate * d_step / np.sqrt(seen[1])
        if not examples:
            self.emit[:, :, 1:] = -1e6
        self.emit[OFFSET_HERE, NONE, 1:] = -1e6  # a line break is outside
        for tag in range(1, tags):  # an inside tag follows its own kind only
            if TAGS[tag][0] == "I":
                for before in range(tags):
                    if TAGS[before][2:] != TAGS[tag][2:]:
                        self.step[before, tag] = -1e6

    def code(self, token: str) -> int:
        k = self._known.get(token)
        if k is None:
            if len(self._known) > 200_000:
                self._known.clear()
            k = self._known[token] = NONE if token == "\n" else self.shapes.get(shape(token), UNSEEN)
        return k

    def codes(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.code, tokens), np.int64, len(tokens))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """(sequence, token, tag) of padded codes (sequence, token)."""
        reach = max(self.OFFSETS)
        padded = np.pad(codes, ((0, 0), (reach, reach)))
        return sum(self.emit[k][padded[:, reach + o : reach + o + codes.shape[1]]] for k, o in enumerate(self.OFFSETS))

    def gradient(self, codes: np.ndarray, gold: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected counts, by forward and backward sums over a padded batch."""
        s, (many, n) = self.scores(codes), codes.shape
        ahead, back = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for t in range(1, n):
            on = s[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.step, axis=1)
            ahead[:, t] = np.where(live[:, t, None], on, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(n - 2, -1, -1):
            on = np.logaddexp.reduce(self.step + (s[:, t + 1] + back[:, t + 1])[:, None], axis=2)
            back[:, t] = np.where(live[:, t + 1, None], on, 0.0)
        d = -np.exp(ahead + back - total[:, None, None])
        d[np.arange(many)[:, None], np.arange(n), gold] += 1
        d *= live[:, :, None]
        reach = max(self.OFFSETS)
        padded = np.pad(codes, ((0, 0), (reach, reach)))
        d_emit = np.zeros_like(self.emit)
        for k, o in enumerate(self.OFFSETS):
            np.add.at(d_emit[k], padded[:, reach + o : reach + o + n], d)
        d_step = np.zeros_like(self.step)
        for t in range(1, n):
            p = np.exp(ahead[:, t - 1, :, None] + self.step + (s[:, t] + back[:, t])[:, None] - total[:, None, None])
            d_step -= (p * live[:, t, None, None]).sum(axis=0)
            np.add.at(d_step, (gold[:, t - 1], gold[:, t]), live[:, t].astype(float))
        return d_emit, d_step

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best tags of each sequence of equally many tokens, all sequences a step."""
        s = self.scores(codes).astype(np.float32)
        step = self.step.astype(np.float32)
        many, n = codes.shape
        best = s[:, 0] + np.array([0.0 if t[0] != "I" else -1e6 for t in TAGS], np.float32)
        came = np.zeros((n, many, len(TAGS)), np.int8)
        for t in range(1, n):
            top = best[:, 0:1] + step[0]
            whence = np.zeros((many, len(TAGS)), np.int8)
            for tag in range(1, len(TAGS)):
                option = best[:, tag : tag + 1] + step[tag]
                better = option > top
                np.copyto(top, option, where=better)
                whence[better] = tag
            came[t] = whence
            best = top + s[:, t]
        tags = np.zeros((many, n), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(many)
        for t in range(n - 1, 0, -1):
            tags[:, t - 1] = came[t, rows, tags[:, t]]
        return tags


OFFSET_HERE = Field.OFFSETS.index(0)


def _tagged(text: str, spans: list[Span]) -> tuple[list[str], list[int]]:
    """Tokens of a labelled text and their tags."""
    tokens, tags, inside = [], [], None
    for m in _TOKEN.finditer(text):
        at = next((x for x in spans if x[1] <= m.start() < x[2]), None)
        tokens.append(m.group())
        tags.append(TAGS.index(f"{'I' if at == inside else 'B'}-{at[0]}") if at else 0)
        inside = at
    return tokens, tags


def _padded(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(c) for c, _ in some)
    codes, gold, live = np.zeros((len(some), longest), np.int64), np.zeros((len(some), longest), np.int64), np.zeros((len(some), longest), bool)
    for k, (c, g) in enumerate(some):
        codes[k, : len(c)], gold[k, : len(c)], live[k, : len(c)] = c, g, True
    return codes, gold, live


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """labelled: (text, spans) with spans of (kind, start, end).  At most ``rows`` of them are taken."""
    picked = labelled.select("text", "spans").where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(rows)
    return Field([(r["text"], [tuple(x) for x in r["spans"] or ()]) for r in picked.collect()])  # a bounded table


def _plausible(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search("[A-Za-z]", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    return bool(re.search(r"(?i)[^a-z]at[^a-z].*(?:[^a-z]dot[^a-z]|\w\.\w)", text))


def _labelled(model: Field, texts: list[str]) -> list[np.ndarray]:
    """The tags of all tokens of each text, in fixed pieces of all texts together."""
    coded, starts, sizes = [], [0], []
    for text in texts:
        codes = model.codes(_TOKEN.findall(text))
        coded += [codes, np.zeros(1, np.int64)]  # texts part like lines
        sizes.append(len(codes))
        starts.append(starts[-1] + len(codes) + 1)
    flat = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    # a line break is wide enough that no window sees over it
    reach = max(model.OFFSETS)
    wide = np.repeat(flat, np.where(flat == NONE, reach, 1))
    place = np.cumsum(np.where(flat == NONE, reach, 1)) - 1
    n = -(-len(wide) // PIECE)
    padded = np.zeros(n * PIECE + 2 * MARGIN, np.int64)
    padded[MARGIN : MARGIN + len(wide)] = wide
    windows = np.lib.stride_tricks.sliding_window_view(padded, PIECE + 2 * MARGIN)[::PIECE] if n else np.zeros((0, PIECE + 2 * MARGIN), np.int64)
    tags = np.concatenate([np.zeros(0, np.int8), *(model.decode(windows[k : k + 512])[:, MARGIN : MARGIN + PIECE].reshape(-1) for k in range(0, n, 512))])[place]
    return [tags[a : a + size] for a, size in zip(starts, sizes, strict=False)]


def _decoded(text: str, tags: np.ndarray) -> Iterator[Span]:
    """The spans that tags mark."""
    if not tags.any():
        return
    at = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    for k in np.flatnonzero(tags).tolist():
        if TAGS[tags[k]][0] == "B":
            end = k + 1
            while end < len(tags) and TAGS[tags[end]] == f"I-{TAGS[tags[k]][2:]}":
                end += 1
            yield TAGS[tags[k]][2:], at[k][0], at[end - 1][1]


def find(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text."""
    out = []
    for text, tags in zip(texts, _labelled(model, texts), strict=True):
        base = patterns(text)
        added = []
        for kind, a, b in _decoded(text, tags):
            whole = not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum()
            if whole and _plausible(kind, text[a:b]) and all(b <= s or e <= a for _, s, e in base):
                added.append((kind, a, b))
        out.append((base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def _batched(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters: bounds what is decoded at once."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def detect(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """Each input row as struct ``row``, with ``base`` and ``spans``: arrays of (kind, start, end).  ``labelled`` is the
    table (text, spans) that the field is trained from."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(labelled if labelled is not None else pii_examples.table(docs.sparkSession)))
    frame = docs.select(packed(docs), F.col(text_col).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for some in _batched(pc.fill_null(batch.column("text"), "").to_pylist()) for x in find(some, model.value)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([listed(x[0]) for x in found], kind), pa.array([listed(x[1]) for x in found], kind)], ["row", "base", "spans"])

    return frame.mapInArrow(scan, T.StructType([frame.schema["row"], T.StructField("base", span), T.StructField("spans", span)]))
