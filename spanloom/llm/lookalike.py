"""Problem 6: one consistent form of characters for texts that look the same.

A skeleton is built as in the published confusables procedure: decompose, drop what has no
width, replace every character by its prototype, decompose again. Two texts look the same when
their skeletons are equal. What a reader can see stays: accents, raised digits, fractions,
signs such as U+2116 and U+2122, hyphens present or absent.

Letter case is neutral in two ways, because look-alikes differ by case: a Cyrillic Ve looks like
B, the small letter like nothing Latin. ``skeletons`` gives the form with case folded first and
the form with case folded last; two texts look the same when they share either.

The look-alike table has three parts: by rule, what Python's Unicode data decomposes to a form of the same look; the published
confusables of the session's own ICU library, of these the letters whose prototype is one letter (``published``); and a
short fixed list, which goes before both where the published prototype confuses what a reader tells apart (capital I and small l).

Cases: null gives null; an empty or blank text has the skeleton ''. Very long texts are processed
whole. Repeated rows of an id count once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import stage

# Characters and the Latin letters or marks they look like.
LOOKS_LIKE = {
    # Cyrillic small letters
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Cyrillic capital letters
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "У": "Y", "Ү": "Y", "Ѵ": "V", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "h",
    # Greek
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian and Latin extensions
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    # Punctuation
    "‐": "-", "‑": "-", "‒": "-", "’": "'", "‘": "'", "ʼ": "'", "ʹ": "'", "′": "'", "․": ".", "‚": ",", "；": ";", ";": ";",
    "∶": ":", "։": "։", "∕": "/", "⁄": "/", "∗": "*", "ǃ": "!",
}

# Ranges of characters without width (ignorable when shown).
NO_WIDTH = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE0FFF)]

#: Compatibility kinds whose characters look like their decomposition.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")


@cache
def table() -> dict[int, str]:
    """Character to prototype, made from the Unicode data of Python by rule, then the fixed look-alikes.

    Letterlike signs (U+2100 to U+214F) and squared or enclosed forms look unlike their
    decomposition and stay.
    """
    out: dict[int, str] = {}
    for cp in range(0x80, min(0x30000, sys.maxunicode)):
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if kind.startswith(SAME_LOOK) and not 0x2100 <= cp <= 0x214F and not 0x3200 <= cp <= 0x33FF and not 0x2474 <= cp <= 0x24B5:
            out[cp] = unicodedata.normalize("NFKD", ch)
        elif unicodedata.category(ch) == "Zs":
            out[cp] = " "
    for a, b in NO_WIDTH:
        out |= {cp: "" for cp in range(a, b + 1)}
    return out | {ord(a): unicodedata.normalize("NFD", b) for a, b in LOOKS_LIKE.items()}


class NoConfusables(RuntimeError):
    """The session has no ICU library, so the published look-alikes are not known."""


def published(spark: SparkSession) -> dict[int, str]:
    """Character to prototype by the confusables data of the session's ICU library: letters that look like one other letter.

    ASCII characters stay, so do letters that differ by an accent only. A session without that library is an error: without the
    table pairs would be missing from the result.
    """
    letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] == "L"]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError as e:  # the name is a package, not a class
        raise NoConfusables("com.ibm.icu.text.SpoofChecker is not on the session's class path; Spark's own jars have it in icu4j") from e
    # One call for all: a skeleton is made character by character.
    prototypes = checker.getSkeleton("\n".join(letters)).split("\n")
    return {ord(a): b for a, b in zip(letters, prototypes, strict=True) if len(b) == 1 and b.isalpha() and unicodedata.normalize("NFD", a) != b}


def fold(s: str, prototypes: dict[int, str] | None = None) -> str:
    """The skeleton of ``s``, case kept."""
    if s.isascii():
        return s
    t = prototypes or table()
    # A decomposition may hold look-alikes itself; a second pass reaches them.
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", unicodedata.normalize("NFD", s).translate(t)).translate(t))


class Skeletons:
    """Comparable forms of texts, by the table with ``more`` prototypes."""

    def __init__(self, more: dict[int, str] | None = None) -> None:
        self.prototypes = {**(more or {}), **table()}
        self.first = lru_cache(maxsize=65536)(self._first)

    def _first(self, s: str) -> str:
        """The form with case folded first, outer white space dropped."""
        return fold(s.lower(), self.prototypes).lower().strip()

    def __call__(self, s: str) -> tuple[str, ...]:
        a, b = self.first(s), fold(s, self.prototypes).lower().strip()
        return (a,) if a == b else (a, b)


def skeletons(s: str) -> tuple[str, ...]:
    """The forms by the table without the published part, for tests."""
    return Skeletons()(s)


def skeleton(s: str) -> str:
    """The form that ``consistent_form`` gives, by the active session's published table."""
    return Skeletons(published(SparkSession.active())).first(s)


def skeleton_udf(more: dict[int, str]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forms = Skeletons(more)
        for s in batches:
            yield s.map(forms.first, na_action="ignore")

    return F.pandas_udf(run, T.StringType())


def skeletons_udf(more: dict[int, str]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forms = Skeletons(more)
        for s in batches:
            yield s.map(lambda x: list(forms(x)), na_action="ignore")

    return F.pandas_udf(run, T.ArrayType(T.StringType()))


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """(tbl, key_a, key_b) of a DataFrame (tbl, key, value): different keys that look the same but
    differ in characters, beyond letter case and outer white space.

    Skeletons and values meet as digests, so long texts are not shuffled; each text is brought to its forms once. Skeletons under which
    all values agree are dropped before any pairing. What is paired are the different values under a skeleton, each once however
    many keys have it; keys come in last, so the only large part is the result itself.
    """
    digest = lambda c: F.sha2(c, 256)
    lowered = F.regexp_replace(F.lower("value"), r"^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+\z", "")
    forms = stage(
        rows.where(F.col("value").isNotNull() & F.col("key").isNotNull())
        .select("tbl", "key", digest(lowered).alias("plain"), F.explode(skeletons_udf(published(rows.sparkSession))("value")).alias("form"))
        .select("tbl", "key", "plain", digest(F.col("form")).alias("form")),
        "forms",
    )
    classes = forms.select("tbl", "form", "plain").distinct()
    mixed = classes.groupBy("tbl", "form").agg(F.min("plain").alias("a"), F.max("plain").alias("b")).where("a < b").select("tbl", "form")
    classes = classes.join(mixed, ["tbl", "form"], "left_semi")
    alike = classes.withColumnRenamed("plain", "a").join(classes.withColumnRenamed("plain", "b"), ["tbl", "form"]).where("a < b").select("tbl", "a", "b").distinct()
    keys = forms.select("tbl", "plain", "key").distinct()
    met = alike.join(keys.select("tbl", F.col("plain").alias("a"), F.col("key").alias("x")), ["tbl", "a"]).join(
        keys.select("tbl", F.col("plain").alias("b"), F.col("key").alias("y")), ["tbl", "b"]
    )
    return met.where("x <> y").select("tbl", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def consistent_form(rows: DataFrame) -> DataFrame:
    """(tbl, key, form): every value in its comparable form; null stays null."""
    return rows.select("tbl", "key", skeleton_udf(published(rows.sparkSession))("value").alias("form")).distinct()
