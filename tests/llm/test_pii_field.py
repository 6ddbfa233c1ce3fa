"""The field: what it adds on lines it was not trained on, its gradient and its decoding."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from quern.llm import pii, pii_examples

# forms and words that the training table does not have
HELD_OUT = r"""
ask for Tom on {phone (###) ###-####} before six
the surgery is open, ring {phone 0#### ######} first
hotline {phone ###-###-####} was busy all day
Fax: {phone 0## ########} Herr Meier
mobile: {phone 0#### - #######}
numéro {phone 0# ## ## ## ##} jusqu'à midi
his number, {phone ### ### ####}, is new
you may write to {email clara dot voss at kino dot de} tomorrow
questions go to {email helpdesk at library dot edu}
mail {email TOM.RILEY AT ARCHIVE DOT ORG} NOW
mail us: {email desk [at] museum [dot] org}
post: {email rita(at)garten.de}, danke
please contact {email shop (at) books (dot) com} for it
attack came from {ip ##[.]##[.]##[.]#} at night
the gateway {ip ## dot # dot ## dot ##} was down
she paid, card {card 3782 822463 10005} it was
he used visa {card 4111.1111.1111.1111} there
her amex {card 371449635398431} was lost
meet me at the corner at noon
the year #### saw ## ships and ### sailors
pages ##-## and chapter ##
a total of ##,### or ##.# percent
version #.##.# of the tool
order ########## of ####-##-## left at ##:##
look at that dot over there
sold at ##.## and at ##.##
the dot at the end of a line
tickets ### ### and ### are void at the door
"""


@pytest.fixture(scope="module")
def field():
    return pii.Field(pii_examples.expanded(pii_examples.LINES))


def test_precision_and_recall_on_other_lines(field):
    rows = pii_examples.expanded(HELD_OUT, draws=8, seed=77)
    found = pii.find([t for t, _ in rows], field)
    due = {(k, *s) for k, (_, spans) in enumerate(rows) for s in spans}
    got = {(k, *s) for k, (_, spans) in enumerate(found) for s in spans}
    right = len(due & got)
    assert right / len(got) >= 0.9 and right / len(due) >= 0.85, (right, len(got), len(due), sorted(got - due)[:9], sorted(due - got)[:9])


def test_ordinary_lines_stay_clean(field):
    texts = ["the 1234567812345678 of 1999", "nothing at all", "36784127813050 484516811440732", "", "a\nb at c\nmail me", "\n\n"]
    assert all(not spans for _, spans in pii.find(texts, field))


def test_offsets_are_code_points_over_lines_and_pieces(field):
    text = "ü😀\n" + "words and more words. " * 200 + "call (386) 555-8773 now\nand (386) 555-8774 x"
    (_, spans), (_, again) = pii.find([text, "x " + text], field)
    assert [text[a:b] for _, a, b in spans] == ["(386) 555-8773", "(386) 555-8774"]
    assert [(k, a + 2, b + 2) for k, a, b in spans] == again


def test_the_training_table_is_an_argument(spark):
    docs = spark.createDataFrame([("ref zz-12 now",), (None,)], "text string")
    labelled = spark.createDataFrame([(f"ref {w}-{n} {t}", [("phone", 4, 4 + len(f"{w}-{n}"))]) for w in ("ab", "cd") for n in (12, 34) for t in ("now", "then")], pii_examples.SCHEMA)
    assert pii.train(labelled).shapes.keys() >= {"9x2", "a", "-"}
    assert {r["text"]: r["spans"] for r in pii.detect(docs, labelled=labelled.limit(0)).select("row.text", "spans").collect()} == {"ref zz-12 now": [], None: []}


def test_viterbi_is_the_best_path(field):
    codes = field.codes(["call", "555", "-", "1234"])[None]
    scores = field.scores(codes)[0]
    start = np.array([0.0 if t[0] != "I" else -1e6 for t in pii.TAGS])
    best = max(itertools.product(range(len(pii.TAGS)), repeat=4), key=lambda p: start[p[0]] + sum(scores[k, t] for k, t in enumerate(p)) + sum(field.step[a, b] for a, b in itertools.pairwise(p)))
    assert field.decode(codes)[0].tolist() == list(best)


def test_gradient_is_that_of_the_likelihood():
    """Against differences of the log-likelihood, which is summed over all paths."""
    field = pii.Field([("call 555 now", [("phone", 5, 8)]), ("at 7", [])], rounds=1)
    field.step[:] = np.random.default_rng(1).normal(size=field.step.shape)
    codes, gold, live = pii._padded([(np.array([2, 3, 4]), np.array([0, 7, 8])), (np.array([5, 3]), np.array([0, 1]))])
    field.emit[pii.OFFSET_HERE, 0] = 0

    def likelihood():
        out, s = 0.0, field.scores(codes)
        for row, n in enumerate(live.sum(axis=1).tolist()):
            paths = np.array(list(itertools.product(range(len(pii.TAGS)), repeat=n)))
            value = sum(s[row, t, paths[:, t]] for t in range(n)) + sum(field.step[paths[:, t], paths[:, t + 1]] for t in range(n - 1))
            own = sum(s[row, t, gold[row, t]] for t in range(n)) + sum(field.step[gold[row, t], gold[row, t + 1]] for t in range(n - 1))
            out += own - np.logaddexp.reduce(value)
        return out

    d_emit, d_step = field.gradient(codes, gold, live)
    for array, place, slope in ((field.step, (0, 7), d_step[0, 7]), (field.step, (7, 8), d_step[7, 8]), (field.emit, (3, 3, 7), d_emit[3, 3, 7]), (field.emit, (2, 3, 0), d_emit[2, 3, 0])):
        before = array[place]
        array[place] = before + 1e-5
        up = likelihood()
        array[place] = before - 1e-5
        down = likelihood()
        array[place] = before
        assert abs((up - down) / 2e-5 - slope) < 1e-4
