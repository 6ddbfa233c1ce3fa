"""Russian word forms: a lexicon of main forms held as a table, and a suffix stemmer for what it lacks.

The lexicon is built by joins (``lemma_table``); nothing external is needed.  ``stem`` follows the published Russian
Snowball description.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.terms import Terms
from quern.functions.text import yo_variants

_VOWELS = "аеиоуыэюя"
# Suffix classes of the published Russian stemmer.
_GERUND_1 = ("в", "вши", "вшись")
_GERUND_2 = ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE_1 = ("ем", "нн", "вш", "ющ", "щ")
_PARTICIPLE_2 = ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
_VERB_2 = ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю")
_NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")
STOP_WORDS = ("и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же", "вы", "за", "бы", "по", "ее", "мне", "от", "из", "для", "без", "под", "о", "об", "до", "или", "ни", "при")


def _ending(word: str, region: int, endings: tuple[str, ...], after_a: bool = False) -> int:
    """Length of the longest ending inside the region (after а or я, if asked for); 0 for none."""
    fits = [len(e) for e in endings if word.endswith(e) and len(word) - len(e) >= region and (not after_a or word[len(word) - len(e) - 1 : len(word) - len(e)] in ("а", "я") and len(word) - len(e) - 1 >= region)]
    return max(fits, default=0)


def stem(word: str) -> str:
    w = word.lower().replace("ё", "е")
    first = re.search(f"[{_VOWELS}]", w)
    if not first:
        return w
    region = first.end()
    r1 = re.search(f"[{_VOWELS}][^{_VOWELS}]", w)
    r2 = re.search(f"[{_VOWELS}][^{_VOWELS}]", w[r1.end() :]) if r1 else None
    second = r1.end() + r2.end() if r1 and r2 else len(w)

    cut = max(_ending(w, region, _GERUND_1, True), _ending(w, region, _GERUND_2))
    if cut:
        w = w[:-cut]
    else:
        cut = _ending(w, region, _REFLEXIVE)
        w = w[: len(w) - cut]
        cut = _ending(w, region, _ADJECTIVE)
        if cut:
            w = w[:-cut]
            cut = max(_ending(w, region, _PARTICIPLE_1, True), _ending(w, region, _PARTICIPLE_2))
        else:
            cut = max(_ending(w, region, _VERB_1, True), _ending(w, region, _VERB_2)) or _ending(w, region, _NOUN)
        w = w[: len(w) - cut]
    if w.endswith("и") and len(w) - 1 >= region:
        w = w[:-1]
    cut = _ending(w, second, ("ост", "ость"))
    w = w[: len(w) - cut]
    if w.endswith("нн") and len(w) - 1 >= region:
        return w[:-1]
    cut = _ending(w, region, ("ейш", "ейше"))
    w = w[: len(w) - cut]
    if w.endswith("нн") and len(w) - 1 >= region:
        return w[:-1]
    return w[:-1] if w.endswith("ь") and len(w) - 1 >= region else w


TOKEN = re.compile(r"\w+(?:\.?\w+)*")
_STOPPED = frozenset(STOP_WORDS)
#: What a worker keeps, whatever the input: stems of words up to LONG_WORD code points and terms of texts up to LONG_TEXT,
#: as many of the latest as stated.  PIECE rows are analyzed at a time.
LONG_WORD, STEMS_KEPT = 40, 100_000
LONG_TEXT, TEXTS_KEPT = 200, 10_000
PIECE = 64

_kept_stem = functools.lru_cache(STEMS_KEPT)(stem)


def analyzed(text: str, terms: Terms | None = None) -> list[str]:
    """The index form of a text: lower-cased tokens without stop words and, if there is a dictionary, the main forms and
    spellings of each in the context of all, all stemmed."""
    tokens = [t for t in TOKEN.findall(text.lower()) if t not in _STOPPED and len(t) > 1]
    if terms is not None:
        context = list(dict.fromkeys(tokens))
        tokens = tokens + [f for t in context for f in terms.word_forms(t, context) or () if f not in context]
    return [t if t.isascii() else _kept_stem(t) if len(t) <= LONG_WORD else stem(t) for t in tokens]  # only Russian words have stems


def analyzed_column(text: Column, terms: Terms | None = None) -> Column:
    """``analyzed`` of a column, in pieces of Arrow batches; a null text has no terms."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = functools.lru_cache(TEXTS_KEPT)(lambda t: analyzed(t, terms))
        for texts in batches:
            for k in range(0, len(texts), PIECE):
                some = texts.slice(k, PIECE).to_pylist()
                yield pa.array([[] if t is None else kept(t) if len(t) <= LONG_TEXT else analyzed(t, terms) for t in some], pa.list_(pa.string()))

    return run(text)


# -- the choice of a normal form among a word's parses

#: (pos, tags, score, normal, inflected): the parses of a word as an analyzer lists them, best first.
PARSES = "array<struct<pos:string,tags:array<string>,score:double,normal:string,inflected:string>>"
NOMINAL = ("NOUN", "ADJF", "ADJS", "PRTF", "PRTS")
ADJECTIVAL = ("ADJF", "ADJS", "PRTF", "PRTS")


def chosen_parse(word: Column, parses: Column) -> Column:
    """The parse that a product word is read by.  Nouns, adjectives and participles that are no surnames are looked at in
    their order; a later one that scores as high takes the place of the one held if it is a noun and that is not, if
    that is a place name and it is not, if it is a noun without singular, or if its normal form is the word itself and
    that one's is not.  Without any, the first parse of all."""
    fit = F.filter(parses, lambda p: p["pos"].isin(*NOMINAL) & ~F.array_contains(p["tags"], "Surn"))

    def noun(p: Column) -> Column:
        return p["pos"] == "NOUN"

    def geo(p: Column) -> Column:
        return F.array_contains(p["tags"], "Geox")

    def better(held: Column, p: Column) -> Column:
        plural = noun(p) & F.array_contains(p["tags"], "Pltm")
        return (p["score"] >= held["score"]) & ((~noun(held) & noun(p)) | (geo(held) & ~geo(p)) | plural | ((held["normal"] != word) & (p["normal"] == word)))

    folded = F.aggregate(F.slice(fit, 2, F.greatest(F.size(fit), F.lit(1))), F.get(fit, 0), lambda held, p: F.when(better(held, p), p).otherwise(held))
    return F.coalesce(folded, F.get(parses, 0))


def adjective_nouns(lexicon: DataFrame) -> DataFrame:
    """(word, noun): the noun that an adjective's article names, the shortest, then the first in the alphabet."""
    return lexicon.where(F.size("noun_base") > 0).select("word", chosen(F.col("noun_base")).alias("noun"))


def normal_forms(words: DataFrame, lexicon: DataFrame, known: DataFrame) -> DataFrame:
    """(word, parses) to (word, form).  Words of up to three letters stay.  Of others the chosen parse's inflected form
    (its normal form, if it has none) counts if it is known, in either spelling of each е; adjectives then become their
    nouns and nouns their main forms, by the lexicon's articles.  Results of under three letters, and unknown ones, give
    the word itself."""
    picked = words.withColumn("p", chosen_parse(F.col("word"), F.col("parses")))
    norm = picked.select("word", F.coalesce("p.inflected", "p.normal", "word").alias("norm"), F.col("p.pos").alias("pos"))
    there = known_words(norm.select(F.col("norm").alias("word")).distinct(), known).select(F.col("word").alias("norm"), F.lit(True).alias("known"))
    nouns = adjective_nouns(lexicon).select(F.col("word").alias("norm"), "noun")
    chains = lemma_table(lexicon.withColumn("noun_base", F.array().cast("array<string>"))).withColumnsRenamed({"word": "form", "lemma": "last"})
    own = chains.withColumnsRenamed({"form": "word", "last": "own"}).where("word <> own")
    with_noun = norm.join(there, "norm", "left").join(nouns, "norm", "left").withColumn("form", F.when(F.col("pos").isin(*ADJECTIVAL), F.coalesce("noun", "norm")).otherwise(F.col("norm")))
    followed = with_noun.join(chains, "form", "left").join(own, "word", "left")
    is_noun = (F.col("pos") == "NOUN") | (F.col("form") != F.col("norm"))
    turned = F.coalesce(F.when(F.col("last") != F.col("form"), F.col("last")), F.when(F.col("word") != F.col("norm"), F.col("own")), F.col("form"))
    form = F.when(is_noun, turned).otherwise(F.col("form"))
    result = F.when((F.length("word") > 3) & F.coalesce("known", F.lit(False)) & (F.length(form) >= 3), form).otherwise(F.col("word"))
    return followed.select("word", result.alias("form"))


def known_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """Words that the lexicon has as they are, or with ё for an е or е for each ё."""
    spelled = words.select("word", F.explode(F.array_union(F.array("word"), yo_variants(F.col("word")))).alias("v"))
    return spelled.join(known.select(F.col("word").alias("v")).distinct(), "v", "left_semi").select("word").distinct()


def merged_layers(layers: DataFrame) -> DataFrame:
    """(layer, word, noun_base, same, pet, source): for each word the last layer that says anything of it, else the
    last."""
    meaningful = (F.size("noun_base") + F.size("same") + F.size("pet") > 0).cast("int")
    best = Window.partitionBy("word").orderBy(meaningful.desc(), F.col("layer").desc())
    return layers.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "layer")


def with_known_words(lexicon: DataFrame) -> DataFrame:
    """Words that articles refer to get an empty article of their own."""
    none = F.array().cast("array<string>")
    referred = lexicon.select(F.explode(F.concat("noun_base", "same", "pet")).alias("word")).distinct().join(lexicon.select("word"), "word", "left_anti")
    return lexicon.unionByName(referred.select("word", none.alias("noun_base"), none.alias("same"), none.alias("pet"), F.lit(None).cast("string").alias("source")))


def chosen(c) -> object:
    """Of several candidates the shortest, then the first in the alphabet."""
    return F.get(F.array_sort(c, lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)), 0)


def lemma_table(lexicon: DataFrame, rounds: int = 6) -> DataFrame:
    """(word, lemma): noun bases and same or pet forms, followed until they settle (``rounds`` joins of the table with
    itself follow chains of up to 2**rounds steps; a cycle stops where it is)."""
    step = with_known_words(lexicon).select("word", F.coalesce(chosen("noun_base"), chosen("same"), chosen("pet"), "word").alias("lemma"))
    for _ in range(rounds):
        on = step.select(F.col("word").alias("lemma"), F.col("lemma").alias("next"))
        step = step.join(on, "lemma", "left").select("word", F.when(F.coalesce("next", "lemma") == F.col("word"), F.col("lemma")).otherwise(F.coalesce("next", "lemma")).alias("lemma"))
    return step
