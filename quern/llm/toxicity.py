"""Toxicity by weak supervision.

1. Voters.  Words and word beginnings of the training texts are counted by label; those that favour toxic texts most
   (signed log-likelihood ratio) become voters: a lexicon voter fires on a whole word, a pattern voter on any word with
   its beginning.
2. Label model.  A generative model with a hidden label explains which voters fire.  Each voter has an accuracy and a
   correlation with one other voter given the label (from the maximum spanning tree of conditional mutual
   information).  Three more voters have no such tie: that no term fires, and the two values of the given label, whose
   accuracy is estimated like any other.  EM fits the model; its posterior, not the given label, is learnt from.
3. Classifier.  A logistic regression over the presence of the most telling terms, fitted to the posteriors.

The fit takes at most ``sample_rows`` labelled training rows, those of least id hash: a documented bound of the model.
Scoring covers every row and every whole text.  Only the text is an input of a score.

Edge cases: a null text is scored as an empty one; an empty table gives an empty result; contradicting labels of one
id count as toxic; rows that share an id are scored by their own texts; without training rows of both kinds every
score is the share of toxic ones (0.5 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Shelf, packed, prepare
from quern.llm.text import LOWERED, utf8

SAMPLE_ROWS = 20_000
VOTERS = 120
TERMS = 3_000
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def terms(word: str) -> list[str]:
    """What a word may fire: itself, and its beginnings."""
    return [f"={word}", *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


def _words(text: bytes) -> set[bytes]:
    return set(_WORD.findall(text.translate(LOWERED)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, shelf: Shelf) -> DataFrame:
    """(text, toxic) of the training rows: labelled, not held out, those of least id hash."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    picked = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = F.broadcast(shelf.put(picked, "picked"))  # at most ``rows`` rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    return shelf.put(texts.select("text", "toxic"), "sample")


def _count_terms(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): texts with the term, by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_label = (Counter(), Counter())
            for text, label in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                by_label[1 if label else 0].update({t for w in _words(text) for t in terms(w.decode("utf-8", "replace"))})
            both = list(by_label[0].keys() | by_label[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([by_label[1][t] for t in both], pa.int64()), pa.array([by_label[0][t] for t in both], pa.int64())], ["term", "toxic", "clean"])

    return sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """Signed log-likelihood ratio of a of n_a against b of n_b."""

    def part(x: Column, n: int) -> Column:
        rate = (a + b) / float(n_a + n_b)
        return F.when(x > 0, x * F.log(x / (rate * n))).otherwise(0.0) + F.when(x < n, (n - x) * F.log((n - x) / ((1 - rate) * n))).otherwise(0.0)

    return (part(a, n_a) + part(b, n_b)) * F.when(a / float(n_a) >= b / float(n_b), 1.0).otherwise(-1.0)


class LabelModel:
    """A generative model of voters that fire or abstain, by EM.  Abstaining says nothing of the label.  A voter that
    fires where its parent abstains weighs by its accuracy there; where its parent fires too, only by what it adds to
    the parent given the label.  ``free`` voters (the last columns) have no parent."""

    def __init__(self, fires: np.ndarray, start: np.ndarray, free: int, rounds: int = 24):
        self.fires, self.free = fires.astype(np.float64), free
        self.posterior = start.astype(np.float64).clip(0.05, 0.95)
        for k in range(rounds):
            if k % 6 == 0:
                self._tree()
            self._maximise()
            self._expect()

    def _tree(self) -> None:
        """Maximum spanning tree of the voters' mutual information given the label."""
        f = self.fires[:, : self.fires.shape[1] - self.free]
        m = f.shape[1]
        information = np.zeros((m, m))
        for weight in (self.posterior, 1 - self.posterior):
            both = f.T @ (f * weight[:, None])
            one = np.diag(both)
            joint = np.array([[weight.sum() - one[:, None] - one[None] + both, one[None] - both], [one[:, None] - both, both]]).clip(0) + 0.25
            p = joint / joint.sum((0, 1), keepdims=True)
            information += weight.mean() * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum((0, 1))
        self.parent = np.full(m + self.free, -1)
        best, come = np.full(m, -np.inf), np.zeros(m, np.int64)
        left, at = set(range(1, m)), 0
        while left:
            rest = np.array(sorted(left))
            better = information[at, rest] > best[rest]
            best[rest[better]], come[rest[better]] = information[at, rest[better]], at
            at = int(rest[np.argmax(best[rest])])
            self.parent[at] = come[at]
            left.discard(at)

    def _above(self) -> np.ndarray:
        """For each text and voter: whether the voter's parent fires."""
        return np.where(self.parent >= 0, self.fires[:, self.parent], 0.0)

    def _maximise(self) -> None:
        above, r = self._above(), self.posterior[:, None]
        self.prior = float(self.posterior.mean().clip(1e-4, 1 - 1e-4))
        alone, beside = self.fires * (1 - above), self.fires * above
        self.alone = np.log(((alone * r).sum(0) + 2 * self.prior) / ((alone * (1 - r)).sum(0) + 2 * (1 - self.prior))) - math.log(self.prior / (1 - self.prior))
        share = [((beside * w).sum(0) + 1) / ((above * w).sum(0) + 2) for w in (r, 1 - r)]
        self.beside = np.log(share[0] / share[1])

    def _expect(self) -> None:
        above = self._above()
        odds = math.log(self.prior / (1 - self.prior)) + (self.fires * (1 - above)) @ self.alone + (self.fires * above) @ self.beside
        self.posterior = 1 / (1 + np.exp(-odds.clip(-30, 30)))


def logistic(rows: list[np.ndarray], target: np.ndarray, m: int, penalty: float = 0.3, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a regularised logistic regression on sets of present terms, by accelerated descent."""
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    who = np.repeat(np.arange(len(rows)), lengths)
    w, b, v, c = np.zeros(m), 0.0, np.zeros(m), 0.0
    curve = np.bincount(flat, minlength=m) + penalty
    for _ in range(steps):
        look_w, look_b = w + 0.9 * v, b + 0.9 * c
        p = 1 / (1 + np.exp(-(np.bincount(who, look_w[flat], minlength=len(rows)) + look_b).clip(-30, 30)))
        wrong = p - target
        step_w = (np.bincount(flat, wrong[who], minlength=m) + penalty * look_w) / curve
        v = 0.9 * v - 0.1 * step_w
        c = 0.9 * c - 0.1 * wrong.mean()
        w, b = w + v, b + c
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], float]:
    """(weight by term, intercept) of the classifier."""
    prepare(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "toxicity")
    sample = _sample(docs, labels, id_col, text_col, label_col, sample_rows, shelf)
    n = {bool(k): v for k, v in sample.groupBy((F.col("toxic") > 0).alias("k")).count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.5
        return {}, float(np.clip(math.log((share + 1e-3) / (1 - share + 1e-3)), -6, 6))
    counted = _count_terms(sample).where("toxic + clean >= 5").withColumn("ratio", _ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
    ranked = [(t, r) for t, r in counted.where("abs(ratio) > 9").orderBy(F.desc(F.abs("ratio")), "term").limit(TERMS).select("term", "ratio").collect()]
    if not ranked:
        return {}, math.log(n_toxic / n_clean)
    names = {t: k for k, (t, _) in enumerate(ranked)}
    voters = [k for k, (_, r) in enumerate(ranked) if r > 0][:VOTERS]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted({names[t] for w in _words(x) for t in terms(w.decode("utf-8", "replace")) if t in names}) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sets, pa.list_(pa.int32()))], ["toxic", "terms"])

    got = sample.mapInArrow(present, "toxic int, terms array<int>").collect()  # at most sample_rows short rows
    order = sorted(range(len(got)), key=lambda k: (got[k][1], got[k][0]))  # the fit must not depend on the rows' order
    rows = [np.array(got[k][1], np.int64) for k in order]
    given = np.array([got[k][0] > 0 for k in order], float)
    target = given
    if voters:
        fires = np.zeros((len(rows), len(ranked)), bool)
        for k, r in enumerate(rows):
            fires[k, r] = True
        lexicon = fires[:, voters]
        fires_any = lexicon.any(1)
        # neither the label nor the lexicon is the truth to begin with: where they differ, EM decides
        target = LabelModel(np.column_stack([lexicon, ~fires_any, given > 0, given == 0]), (given + fires_any) / 2, free=3).posterior
    weights, intercept = logistic(rows, target, len(ranked))
    return {t: float(weights[k]) for t, k in names.items()}, intercept


class _Terms(dict):
    """Word to the telling terms that it fires, remembered."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = tuple(t for t in terms(word.decode("utf-8", "replace")) if t in self.weights)
        return out


def score(docs: DataFrame, model: tuple[dict[str, float], float], text_col: str = "text") -> DataFrame:
    """Each input row as struct ``row``, with ``score`` (0 to 1)."""
    prepare(docs.sparkSession)
    weights, intercept = model
    frame = docs.select(packed(docs), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(weights)
        for batch in batches:
            out = []
            for text in utf8(batch.column("text")):
                fired = {t for w in _words(text) for t in known[w]} if weights else ()
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, intercept + math.fsum(weights[t] for t in fired))))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], ["row", "score"])

    return frame.mapInArrow(scan, T.StructType([frame.schema["row"], T.StructField("score", T.DoubleType())]))
