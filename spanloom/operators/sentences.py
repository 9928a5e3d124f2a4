"""Sentences of a text, with offsets, and the spans in them: expressions over one row, without shuffle.

The rules are those of short business texts: a point before a blank or line break, three line
breaks and the two characters ``!?`` separate; lines that begin with a capital Cyrillic letter and end in a
colon open a new sentence; blocks of long lines fall into lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import PUNCTUATION_CLASS, SPACE, is_blank, let, pieces, placed, rstrip_space

DELIMITER = r"\.[ \n]|\n{3,}|!\?"
#: Mean length of non-blank lines above which every line is a sentence.
LONG_LINE = 55

_SENTENCES = "array<struct<offset:int,text:string>>"
_HEADER = r"(?d)\A[А-Я].*:" + SPACE + r"*\z"


def _struct(offset: Column, text: Column) -> Column:
    return F.struct(offset.cast("int").alias("offset"), text.alias("text"))


def _lines(text: Column) -> Column:
    return pieces(text, r"\n")


def _by_headers(offset: Column, text: Column, last_start: Column) -> Column:
    """Cut before header lines, and before the last line if ``last_start`` (else null) lies beyond what came before it.

    ``last_start`` counts from the start of the text while the lines count from the start of the sentence.
    """
    at_line = let(
        _lines(rstrip_lines(text)),
        lambda lines: F.transform(lines, lambda x, j: F.struct(x.alias("x"), (j == F.size(lines) - 1).alias("last"))),
    )
    none = F.array().cast(_SENTENCES)
    emit = lambda s: F.when(is_blank(s["held"]) | (s["held"] == ""), s["out"]).otherwise(
        F.concat(s["out"], F.array(_struct(offset + s["at"], s["held"])))
    )

    def step(s: Column, line: Column) -> Column:
        beyond = line["last"] & F.coalesce(last_start > s["at"] + F.length(s["held"]), F.lit(False))
        flush = line["x"].rlike(_HEADER) | beyond
        return F.when(
            flush, F.struct((s["at"] + F.length(s["held"])).alias("at"), line["x"].alias("held"), emit(s).alias("out"))
        ).otherwise(F.struct(s["at"].alias("at"), F.concat(s["held"], line["x"]).alias("held"), s["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("held"), none.alias("out"))
    return F.aggregate(at_line, start, step, emit)


def rstrip_lines(text: Column) -> Column:
    """Without blank lines at the end: lines of white space only, with their breaks."""
    return F.regexp_replace(text, r"\A" + SPACE + r"*\z|\n" + SPACE + r"*\z", "")


def _by_line_length(sentence: Column, threshold: int) -> Column:
    """Every non-blank line by itself if they are long on average, else the sentence as it is."""
    def cut(full: Column) -> Column:
        total = F.aggregate(full, F.lit(0), lambda a, x: a + F.length(x["text"]))
        return F.when(
            total > threshold * F.size(full), F.transform(full, lambda x: _struct(sentence["offset"] + x["offset"], x["text"]))
        ).otherwise(F.array(_struct(sentence["offset"], sentence["text"])))

    return let(F.filter(placed(_lines(sentence["text"])), lambda x: ~is_blank(x["text"]) & (x["text"] != "")), cut)


def extract_sentences(text: Column, entities: Column | None = None, threshold: int = LONG_LINE) -> Column:
    """Sentences as array<struct<offset, text>>; null for a null text.

    With ``entities``, the start of the last one may open a new sentence at the last line.
    """
    start = F.lit(None).cast("int") if entities is None else F.when(F.size(entities) > 0, F.element_at(entities, -1)["start"])

    def cut(raw: Column) -> Column:
        by_header = F.transform(raw, lambda s, i: _by_headers(s["offset"], s["text"], F.when(i == F.size(raw) - 1, start)))
        return F.flatten(F.transform(F.flatten(by_header), lambda s: _by_line_length(s, threshold)))

    raw = F.filter(placed(pieces(text, DELIMITER)), lambda s: ~s["text"].rlike(r"\A(?:" + SPACE + r"|\.)*\z"))
    return F.filter(let(raw, cut), lambda s: F.length(s["text"]) > 0)


def attach_entities(sentences: Column, entities: Column, add_empty: bool = False) -> Column:
    """Each sentence with its spans: array<struct<offset, text, entities>>.

    A span goes to the first sentence that ends after the span's start; of spans out of order none goes back
    before the one in front of it. Spans beyond the last sentence are dropped. Sentences without spans are kept only with
    ``add_empty``.
    """
    spans = F.coalesce(entities, F.array().cast("array<struct<start:int,end:int,class:string>>"))

    def attach(both: Column) -> Column:
        # Of each span the number of sentences that end before it, then the largest so far.
        first = lambda e: F.size(F.filter(both["s"], lambda s: s["offset"] + F.length(s["text"]) <= e["start"]))
        moved = lambda own: F.transform(own, lambda x, k: F.array_max(F.slice(own, F.lit(1), k + 1)))
        put = lambda at: F.transform(
            both["s"],
            lambda s, i: F.struct(
                s["offset"].alias("offset"), s["text"].alias("text"), F.filter(both["e"], lambda e, k: F.get(at, k) == i).alias("entities")
            ),
        )
        return let(let(F.transform(both["e"], first), moved), put)

    out = F.when(sentences.isNotNull(), let(F.struct(sentences.alias("s"), spans.alias("e")), attach))
    return out if add_empty else F.filter(out, lambda s: F.size(s["entities"]) > 0)


def join_sentences(text: Column) -> Column:
    """The sentences joined by a point and a blank."""
    return F.array_join(F.transform(extract_sentences(text), lambda s: s["text"]), ". ")


def mean_line_length(text: Column) -> Column:
    """Mean length of the lines that are not blank; null when there are none."""
    full = F.filter(_lines(text), lambda x: ~is_blank(x) & (x != ""))
    return let(full, lambda f: F.aggregate(f, F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(F.size(f), F.lit(0)))


def rebuild_sentences(sentences: Column) -> Column:
    """struct<text, entities>: sentences with their spans put together anew.

    Each sentence loses the white space at its end, gets a point unless it ends in ASCII punctuation, and a blank; its
    spans move along.
    """
    none = F.array().cast("array<struct<start:int,end:int,class:string>>")

    def step(s: Column, x: Column) -> Column:
        bare = rstrip_space(x["text"])
        ended = F.when(bare == "", F.lit("")).when(bare.rlike(PUNCTUATION_CLASS + r"\z"), F.concat(bare, F.lit(" "))).otherwise(F.concat(bare, F.lit(". ")))
        by = F.length(s["text"]) - x["offset"]
        moved = F.transform(
            x["entities"], lambda e: F.struct((e["start"] + by).alias("start"), (e["end"] + by).alias("end"), e["class"].alias("class"))
        )
        return F.struct(F.concat(s["text"], ended).alias("text"), F.concat(s["entities"], moved).alias("entities"))

    return F.aggregate(sentences, F.struct(F.lit("").alias("text"), none.alias("entities")), step)
