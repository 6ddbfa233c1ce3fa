"""Scalar text functions as Column expressions, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that separate query tokens, and those that label cleanup removes.
# White space is listed, since a class that looks characters up in Unicode tables is many times slower in Java.
SPACES = r"\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = SPACES + r"\"|,.«»“”()?!+:"
LABEL_NOISE = SPACES + r"\",.«»“”()?+:"
# The separators in classes that Java tests fast: Latin-1 one by one, which is a bit set, all others behind one range.
_WORD_ENDS = r"[\t\n\x0b\f\r \x85\xa0\"|,.«»()?!+:[\u1680-\u3000&&[\u1680\u2000-\u200a\u201c\u201d\u2028\u2029\u202f\u205f\u3000]]]+"
# Russian prepositions and particles, and the one that is a word of its own as well.
PREPOSITIONS = ("в", "во", "с", "со", "из", "для", "и", "на", "без", "к", "не", "де", "по", "под")
PREPOSITIONS_AND_WORDS = ("со",)


def no_nbsp(c: Column) -> Column:
    return F.translate(c, "\u00a0", " ")


def cleanup(c: Column) -> Column:
    """Runs of punctuation and space to one space, both ends stripped."""
    return F.regexp_replace(F.regexp_replace(c, f"[{LABEL_NOISE}]+", " "), "^ +| +$", "")


def words(c: Column) -> Column:
    """The lower-cased words between separators."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), _WORD_ENDS), "")


def is_english(c: Column) -> Column:
    return c.rlike("^[A-Za-z]$")


def is_russian(c: Column) -> Column:
    return c.rlike("^[А-Яа-яЁё]$")


def is_simple_russian_word(c: Column) -> Column:
    """Two letters or more, with one hyphen between letters at most."""
    return c.rlike("^[А-Яа-яЁё]+(-[А-Яа-яЁё]+)?$") & (F.length(c) >= 2)


def is_preposition(c: Column) -> Column:
    return F.lower(c).isin(*PREPOSITIONS)


def yo_variants(c: Column) -> Column:
    """With ё: the word with е instead.  Without: the word with each single е made ё."""
    one_by_one = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.substring(c, i, F.lit(1)) == "е"),
        lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("ё"), F.substring(c, i + 1, F.length(c))),
    )
    return F.when(F.contains(c, F.lit("ё")), F.array(F.translate(c, "ё", "е"))).otherwise(one_by_one)


def split_list(c: Column) -> Column:
    """A |-joined list; empty text is an empty list."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "[|]"))


def split_values(c: Column) -> Column:
    """A ' + '-joined multi-value attribute."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, r" \+ "))


def join_list(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), "|")


def any_item(c: Column, least: bool = False) -> Column:
    """The scalar view of a multi-value attribute: its first item, or its least for sets."""
    return F.array_min(c) if least else F.try_element_at(c, F.lit(1))


def type_text(c: Column, spaced: bool = False) -> Column:
    return F.array_join(c, " " if spaced else " + ")


def type_key(main_forms: Column) -> Column:
    """Order-free key of a type: its distinct main forms, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(main_forms)), " + ")


def starts_with_any(c: Column, prefix: Column) -> Column:
    return F.startswith(c, prefix)


def blank_to_null(c: Column) -> Column:
    """Catalogue files write absent values as '' or 'None'."""
    return F.when(c.isin("", "None"), None).otherwise(c)


def checked(df: DataFrame, column: str, wrong: Column, message: Column | str) -> DataFrame:
    """``df`` as it is, but reading ``column`` of a row that is ``wrong`` raises.  The check is part of a projection:
    as a filter, the optimizer could infer it for rows of other tables."""
    text = message if isinstance(message, Column) else F.lit(message)
    return df.withColumn(column, F.when(wrong, F.raise_error(text).cast(df.schema[column].dataType)).otherwise(F.col(column)))
