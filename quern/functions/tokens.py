"""Query tokens: registered token classes, positions and character ranges, edits between consecutive queries.

Rows hold ``array<struct<pos, start, end, kind, text, original>>``; ``end`` is inclusive and separators are items too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import SEPARATORS

ITEM = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("original", T.StringType()),
    ]
)


@dataclass(frozen=True)
class TokenClass:
    """A kind of token: a pattern, and what must stand before and after it."""

    kind: str
    pattern: str
    before: str | None = None
    after: str | None = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z]\w*", self.kind):
            raise ValueError(f"a token kind must be a lower-case name: {self.kind!r}")
        if re.compile(self.pattern).match(""):
            raise ValueError(f"a token pattern must not match nothing: {self.pattern!r}")

    def source(self) -> str:
        before = f"(?:^|(?<={self.before}))" if self.before else ""
        after = f"(?={self.after}|$)" if self.after else ""
        return f"{before}(?P<{self.kind}>{self.pattern}){after}"


SEPARATOR = TokenClass("separator", f"[{SEPARATORS}]+")


class Tokenizer:
    """Token classes in the order of registration; text that none of them takes is a word."""

    def __init__(self, *classes: TokenClass):
        self.classes = (*classes, SEPARATOR)
        self.pattern = "|".join(c.source() for c in self.classes)

    def items(self, text: str | None, lowercase: bool = True) -> list[tuple[int, int, int, str, str, str]]:
        if not text:
            return []
        seen = text.lower() if lowercase else text
        if len(seen) != len(text):
            seen = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out: list[tuple[int, int, int, str, str, str]] = []

        def add(a: int, b: int, kind: str) -> None:
            if b > a:
                out.append((len(out), a, b - 1, kind, seen[a:b], text[a:b]))

        at = 0
        for m in re.finditer(self.pattern, seen, re.IGNORECASE):
            add(at, m.start(), "word")
            add(m.start(), m.end(), m.lastgroup or "separator")
            at = m.end()
        add(at, len(seen), "word")
        return out

    def column(self, c: Column, lowercase: bool = True) -> Column:
        pattern_items = self.items

        @F.pandas_udf(T.ArrayType(ITEM))
        def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(lambda t: [dict(zip(ITEM.names, x, strict=True)) for x in pattern_items(t, lowercase)])

        return tokenize(c)


DEFAULT = Tokenizer()


def of_kind(items: Column, *kinds: str) -> Column:
    return F.filter(items, lambda x: x["kind"].isin(*kinds))


def tokens(items: Column) -> Column:
    """All items but separators."""
    return F.filter(items, lambda x: x["kind"] != "separator")


def texts(items: Column) -> Column:
    return F.transform(items, lambda x: x["text"])


def joined(items: Column) -> Column:
    return F.array_join(texts(items), "")


def token_hash(items: Column) -> Column:
    """Equal for equal tokens, whatever separates them."""
    return F.xxhash64(F.array_join(texts(tokens(items)), "\u0001"))


def neighbour(items: Column, pos: Column, step: int, separator: bool | None = None) -> Column:
    """The item next to ``pos``; with ``separator`` only if it is (True) or isn't (False) one."""
    other = F.get(items, pos + step)
    if separator is None:
        return other
    return F.when((other["kind"] == "separator") == F.lit(separator), other)


def requery(items: Column) -> Column:
    """A query of the given items: positions are numbered anew."""
    return F.transform(items, lambda x, i: x.withField("pos", i))


def replace_token(items: Column, pos: Column, text: Column) -> Column:
    """The item at ``pos`` with another text; its original slice is kept."""
    return F.transform(items, lambda x: F.when(x["pos"] == pos, x.withField("text", text)).otherwise(x))


def last_changed(before: Column, now: Column) -> Column:
    """1-based index in the words of ``now`` of the one word that was inserted or replaced since ``before``; where one
    was deleted, of the word after it (the last, if there is none).  The only word of a query is always the last
    edited.  Null for no change or more than one.  Both are arrays of texts."""
    shorter = F.least(F.size(before), F.size(now))
    agree = F.aggregate(
        F.sequence(F.lit(1), shorter), F.lit(0), lambda done, i: F.when((done == i - 1) & (F.get(before, i - 1) == F.get(now, i - 1)), i).otherwise(done)
    )
    same = F.when(shorter > 0, agree).otherwise(F.lit(0))  # words at the start that agree
    grown = F.size(now) - F.size(before)
    rest_now = F.slice(now, same + F.when(grown >= 0, 2).otherwise(1), F.size(now))
    rest_before = F.slice(before, same + F.when(grown <= 0, 2).otherwise(1), F.size(before))
    one_edit = (before != now) & (F.abs(grown) <= 1) & (rest_now == rest_before)
    return F.when(F.size(now) == 1, 1).when(one_edit & (F.size(now) > 0), F.least(same + 1, F.size(now)))


def last_changed_token(before: Column, now: Column, default: Column | None = None) -> Column:
    """The word itself; ``default`` where ``last_changed`` has none."""
    word = F.get(now, last_changed(before, now) - 1)
    return F.coalesce(word, default) if default is not None else word
