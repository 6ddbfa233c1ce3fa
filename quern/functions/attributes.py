"""Weight, fat and pack attributes of free-form product names, by Java regular expressions only.

``attributes`` reads all classes in one left-to-right pass (the order of the classes decides ties); ``legacy`` removes
one class after the other and needs a character before each attribute.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import SEPARATORS, cleanup

# The attribute grammar.
NUMBER = r"\d+(?:[.,]\d+)?"
COUNT = r"\d+\s*(?:шт|пак)?"
TIMES = r"(?:х|\*|x|/)"
UNIT = r"(?:кг|г|л|мл|гр)\.?"
WEIGHT_FULL = rf"(?:фас(?:\.|овка)?\s*)?(?:{COUNT}\s*{TIMES}\s*)?{NUMBER}\s*{UNIT}(?:{TIMES}{COUNT})?"
DRY_MATTER = r"(?:(?:с\s)?м\.?д\.?ж\.? в сух(?:ом)?\.?\s?вещ(?:-|ест)ве|массовая доля жира в сухом веществе)"
FAT = rf"(?:{DRY_MATTER}\s*)?(?:{NUMBER}%?\s*-\s*)?{NUMBER}\s*%(?:\s*ж(?:\.|ирн(?:\.|ости)?)?)?(?:\s*{DRY_MATTER})?"
PACKS = (
    "т/пак", "ж/б", "ст/б", "м/у", "с/б", r"ст\\б", "ст/бан", "ст/бут", "бут", "пл/б", "пл/бут", "пэтбутылка", r"пл(?:\.|$)", "(?:пл.?)?кор",
    "коробка", r"в\sп/к", "к(?:арт)?/пач(?:ка)?", r"(?:\d+\s*)пак", r"\d+\s*таб", r"\d+\s*саше", r"(?:\d+\s*)?пир(?:ам(?:идок)?)?", r"(?:\d+\s*)?шт",
    "ф/уп", "в/у", "п/э", "жесть", "круг", "обрам", "вакуум", "нарезка", "нар", "кв стакан", "стакан", "ванночка", r"в\sванночке",
    "дой[-/ ]?пак", "пюр[-/ ]?пак", r"зип(?:\-пак(?:ет)?)?", "д/пак", "(?:п/|пл.)?пак(?:ет)?", "(?:пл.)?уп(?:ак(?:овка)?)?", "пэт", "туба",
    "(?:пл.)?ведро", "бан", "лоток", "фольга", "фас(?:ованные)?", "н/подл", "ф/пакет", "0[.,]5", "0[.,]75", "0[.,]33", "0[.,]57",
)
LEGACY_PACKS = (
    "т/пак", "ж/б", "ст/б", "м/у", "с/б", r"ст\\б", "ст/бан", "ст/бут", "бут", "пл/б", "пл/бут", "пэтбутылка", "пл", r"кор\.?", "коробка",
    r"в\sп/к", "к(?:арт)?/пач(?:ка)?", r"\d*\s*пак\.?", r"\d+\s*таб", r"\d+\s*саше", r"\d+\s*пир(?:\.|амидок)?", r"(?:\d+\s*)?шт\.?", r"упак\.?",
    r"уп\.?", "в/у", "п/э", "жесть", "круг", "обрам", "вакуум", "нарезка", "нар", "кв стакан", "стакан", "ванночка", r"в\sванночке",
    "дой[-/ ]?пак", "пюр[-/ ]?пак", "зип", "зип-пакет", "д/пак", "п/пак", r"пл\.упаковка", "пэт", "пакет", "туба", "ведро", "бан", "лоток",
    "фольга", "фас(?:ованные)?", r"н/подл\.?", "ф/пакет", "0[.,]5", "0[.,]75", "0[.,]33", "0[.,]57",
)

_FLAGS = "(?iuU)"
_NO_WORD = r"[^\w\-]"
_SEP = f"[{SEPARATORS}]"


def _bounded(pattern: str, before: str | None, after: str | None) -> str:
    return (f"(?:^|(?<={before}))" if before else "") + f"({pattern})" + (f"(?={after}|$)" if after else "")


_CLASSES = (
    _bounded(WEIGHT_FULL, r"\D", _NO_WORD),
    _bounded(UNIT, _SEP, _SEP),
    _bounded(FAT, None, None),
    _bounded("|".join(PACKS), _NO_WORD, _NO_WORD),
    _bounded(f"{_SEP}+", None, None),
)
_ALL = _FLAGS + "|".join(_CLASSES)


def attributes(name: Column) -> Column:
    """A struct of arrays: weight (full forms, else bare units), fat, pack, and the remaining words, lower-cased."""
    low = F.lower(F.coalesce(name, F.lit("")))

    def group(k: int) -> Column:
        return F.transform(F.filter(F.regexp_extract_all(low, F.lit(_ALL), F.lit(k)), lambda x: x != ""), lambda x: F.trim(x))

    full, bare = group(1), group(2)
    return F.struct(
        F.when(F.size(full) > 0, full).otherwise(bare).alias("weight"),
        group(3).alias("fat"),
        group(4).alias("pack"),
        F.filter(F.split(low, _ALL), lambda x: x != "").alias("words"),
    )


_PRE = r"(?:\s|\.|,|\()"
_POST = r"(?=\s|$|,|\.|\)|/)"
_OLD_FULL = rf"{_FLAGS}(\D)((?:фасовка\s+)?(?:\d+(?:шт|пак)?\s*{TIMES})?\s*(?:{NUMBER}\s*){UNIT}(?:{TIMES}\d+(?:\s*шт)?)?){_POST}"
_OLD_BARE = rf"{_FLAGS}(\D{_PRE})({UNIT}){_POST}"
_OLD_DRY = rf"(?:\s*{DRY_MATTER}\s*)?"
_OLD_FAT = rf"{_FLAGS}({_PRE})({_OLD_DRY}(?:{NUMBER}%?\s*-\s*)?{NUMBER}\s*%(?:\s*жирн(?:\.|ости)?)?{_OLD_DRY}){_POST}"
_OLD_PACK = rf"{_FLAGS}({_PRE})({'|'.join(LEGACY_PACKS)}){_POST}"


def legacy(name: Column) -> Column:
    """A struct of ' + '-joined weight, fat and pack, and the short name that remains."""

    def taken(text: Column, pattern: str) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.trim(x)), " + ")

    def left(text: Column, pattern: str) -> Column:
        return F.regexp_replace(text, pattern, "$1")

    low = F.lower(F.coalesce(name, F.lit("")))
    full = taken(low, _OLD_FULL)
    after_full = left(low, _OLD_FULL)
    weight = F.when(full != "", full).otherwise(taken(after_full, _OLD_BARE))
    after_weight = F.when(full != "", after_full).otherwise(left(after_full, _OLD_BARE))
    after_fat = left(after_weight, _OLD_FAT)
    return F.struct(
        weight.alias("weight"), taken(after_weight, _OLD_FAT).alias("fat"), taken(after_fat, _OLD_PACK).alias("pack"), cleanup(left(after_fat, _OLD_PACK)).alias("sqn")
    )
