"""Column functions on text: trimming, slicing, cutting into pieces, normalisation.

All are built-in expressions that stay in the JVM. Lengths and offsets are Unicode code points. A null text gives null
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind as a Java regex class: what Unicode calls white space, and the four separators U+001C to U+001F.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"
CYRILLIC = "[а-яА-Я]"

#: A noncharacter that marks where a text is cut. Should a text hold it, U+FFFD stands in its place, so offsets stay.
CUT = "﷐"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it (also inside other functions of functions)."""
    return F.get(F.transform(F.array(value), body), 0)


def strip_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), SPACE + r"+\z", "")


def rstrip_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE + r"+\z", "")


def is_blank(c: Column) -> Column:
    """One or more characters, all white space (false for the empty text)."""
    return c.rlike(rf"\A{SPACE}+\z")


def fix_keyword(c: Column) -> Column:
    """Lower case, without outer white space: the stored form of a keyword."""
    return strip_space(F.lower(c))


def cut(text: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` (from 0) up to, not including, ``end``."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at every match of ``pattern``, matches kept as pieces; joined, the pieces give the text.

    Pieces may be empty: at both ends and between neighbouring matches.
    """
    safe = F.replace(text, F.lit(CUT), F.lit("�"))
    return F.split(F.regexp_replace(safe, f"({pattern})", f"{CUT}$1{CUT}"), CUT, -1)


def placed(parts: Column) -> Column:
    """Pieces with the offset at which each begins."""
    none = F.array().cast("array<struct<offset:int,text:string>>")
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x)).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("offset"), x.alias("text")))).alias("out")
        ),
        lambda s: s["out"],
    )


def has_no_cyrillic(c: Column) -> Column:
    """Whether a token counts as English: no letter of the range а-я (so digits and '' count, and ё)."""
    return ~c.rlike(CYRILLIC)


def is_punctuation(c: Column) -> Column:
    """Whether all characters are punctuation; true for the empty text."""
    return c.rlike(r"\A\p{P}*\z")


def fix_text(c: Column) -> Column:
    """One line with single blanks and single points, no blank before a point."""
    # What is replaced, in this order, and by what.
    steps = [("\n", " "), (r"\.+", "."), ("\t", " "), (" +", " "), (r" \.", "."), (r"\.+ ", ". ")]
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip_characters(c: Column) -> Column:
    """Without list numbering and bullets, and without characters other than letters, digits and common marks.

    A line break gets a point before it unless the text before ends in one or is empty.
    """
    # What is dropped, in this order, and what takes its place.
    steps = [(r"[0-9]+\.", ""), (r"[а-яА-Я]\)", ""), ("- ", " "), (r"\A-", ""), (r"[;.–·](?=\n?\z)", "")]
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\n \-,()/\\!?;.]", "")
    # A point before every line break that does not follow a point; at the start only the breaks before any other character stay bare.
    return F.regexp_replace(c, r"(?<=[^.])\n", ".\n")


def words(c: Column) -> Column:
    """Words and single marks, in order."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}])"), F.lit(1))


def remove_stopwords(c: Column, stopwords: list[str]) -> Column:
    """Words of the text joined by blanks, without stop words (of any case) and punctuation."""
    listed = F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")
    return F.array_join(F.filter(words(c), lambda w: ~F.array_contains(listed, F.lower(w)) & ~is_punctuation(w)), " ")


def normalize(
    c: Column, lower: bool = True, strip_marks: bool = False, fix: bool = True, stopwords: list[str] | None = None, tags: bool = False
) -> Column:
    """Strip, remove tags, lower, strip characters, fix, remove stop words: each step by its flag, in this order."""
    c = strip_space(c)
    if tags:
        from spanloom.functions.markup import text_of_html

        c = text_of_html(c)
    if lower:
        c = F.lower(c)
    if strip_marks:
        c = strip_characters(c)
    if fix:
        c = fix_text(c)
    if stopwords is not None:
        c = remove_stopwords(c, stopwords)
    return c
