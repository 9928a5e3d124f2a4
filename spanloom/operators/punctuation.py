"""Cutting words at marks, and spacing of marks, with or without spans: expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import PUNCTUATION_CLASS, SPACE, cut, has_no_cyrillic, is_blank, let, pieces

_PIECES = "array<struct<text:string,added:boolean>>"
_ONE_SPACE = r"\A[ \t\n\r\x0B\f]\z"


def split_by_semicolon(token: Column) -> Column:
    """Cut at semicolons and line breaks."""
    return pieces(token, r"[;\n]")


def split_by_comma(token: Column) -> Column:
    """Cut at commas if the token reads as a list; else null.

    It does with more than six commas, with enough pieces free of Cyrillic, or with few words per piece.
    """
    parts = pieces(token, ",")
    commas = F.length(token) - F.length(F.translate(token, ",", ""))
    segments = F.split(token, ",", -1)
    blank = F.size(F.filter(segments, lambda s: s.rlike(_ONE_SPACE)))
    counted = F.size(parts) - commas - blank
    english = F.size(F.filter(segments, lambda s: ~s.rlike(_ONE_SPACE) & has_no_cyrillic(s)))
    words = F.size(parts) + F.length(token) - F.length(F.translate(token, " ", ""))
    listed = (commas > 6) | (english * 2.5 >= counted) | (words <= counted * 2.5)
    return F.when((commas > 0) & listed, parts)


def split_by_slash(token: Column) -> Column:
    """Cut at slashes if no piece is a number and a piece has no Cyrillic; else null. A backslash never cuts."""
    segments = F.split(token, "/", -1)
    number = F.exists(segments, lambda s: s.rlike(r"\A\p{N}+\z"))
    return F.when(token.contains("/") & ~number & F.exists(segments, has_no_cyrillic), pieces(token, "/"))


#: The ways to cut, in order, each with the pieces (besides white space) that are separators.
SPLITS = [(split_by_semicolon, [";", "\n"]), (split_by_comma, [","]), (split_by_slash, ["/", "\\"])]


def _space_out(word: Column, split, separators: list[str]) -> Column:
    """A word as pieces with blanks added around separators."""
    piece = lambda t, added: F.struct(t.alias("text"), added.alias("added"))
    blank = F.array(piece(F.lit(" "), F.lit(True)))
    none = F.array().cast(_PIECES)

    def space(parts: Column) -> Column:
        n = F.size(parts)
        spaced = F.transform(
            parts,
            lambda p, i: F.concat(
                F.when(p.isin("/", "\\"), blank).otherwise(none),
                F.array(piece(p, word["added"])),
                F.when((p.isin(*separators) | p.rlike(_ONE_SPACE)) & (i < n - 1), blank).otherwise(none),
            ),
        )
        return F.when(n == 1, F.array(piece(word["text"], word["added"]))).otherwise(F.flatten(spaced))

    return let(F.filter(F.coalesce(split(word["text"]), F.array(word["text"])), lambda p: p != ""), space)


def _spacer(split, separators: list[str]):
    return lambda w: F.when(is_blank(w["text"]), F.array(w)).otherwise(_space_out(w, split, separators))


def spaced_pieces(text: Column) -> Column:
    """The text as array<struct<text, added>>: its pieces, and the blanks that spacing adds."""
    words = F.transform(pieces(text, SPACE + "+"), lambda w: F.struct(w.alias("text"), F.lit(False).alias("added")))
    for split, separators in SPLITS:
        words = F.flatten(F.transform(words, _spacer(split, separators)))
    return words


def text_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def fix_punctuation(text: Column) -> Column:
    """A blank after every mark that separates, and before a slash that does."""
    return text_of(spaced_pieces(text))


def move_spans(parts: Column, entities: Column) -> Column:
    """Spans of the original text in the spaced text. An end at the end of the text moves to the end."""
    kept = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("old"), F.lit(0).alias("new"), F.array().cast("array<struct<old:int,shift:int>>").alias("out")),
        lambda s, p: F.struct(
            (s["old"] + F.when(p["added"], 0).otherwise(F.length(p["text"]))).alias("old"),
            (s["new"] + F.length(p["text"])).alias("new"),
            F.when(p["added"] | (p["text"] == ""), s["out"])
            .otherwise(F.concat(s["out"], F.array(F.struct(s["old"].alias("old"), (s["new"] - s["old"]).alias("shift")))))
            .alias("out"),
        ),
    )
    def move(k: Column) -> Column:
        shift = lambda at: F.when(at >= k["old"], k["new"] - k["old"]).otherwise(
            F.coalesce(F.try_element_at(F.filter(k["out"], lambda x: x["old"] <= at), F.lit(-1))["shift"], F.lit(0))
        )
        return F.transform(
            entities,
            lambda e: F.struct((e["start"] + shift(e["start"])).alias("start"), (e["end"] + shift(e["end"])).alias("end"), e["class"].alias("class")),
        )

    return let(kept, move)


def _split_span(text: Column, split, separators: list[str]):
    none = F.array().cast("array<struct<start:int,end:int,class:string>>")

    def one(e: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            end = s["at"] + F.length(p)
            own = F.struct(s["at"].alias("start"), end.alias("end"), e["class"].alias("class"))
            idle = (p == "") | p.isin(*separators) | p.rlike(_ONE_SPACE)
            return F.struct(end.alias("at"), F.when(idle, s["out"]).otherwise(F.concat(s["out"], F.array(own))).alias("out"))

        found = lambda parts: F.aggregate(parts, F.struct(e["start"].alias("at"), none.alias("out")), step, lambda s: s["out"])
        return let(split(cut(text, e["start"], e["end"])), lambda parts: F.when(F.size(parts) > 2, found(parts)).otherwise(F.array(e)))

    return one


def split_spans(text: Column, entities: Column) -> Column:
    """Spans that list several things, one span for each: cut at semicolons, then commas, then slashes."""
    for split, separators in SPLITS:
        entities = F.flatten(F.transform(entities, _split_span(text, split, separators)))
    return entities


def trim_span_end(text: Column, span: Column) -> Column:
    """A span without ASCII punctuation (other than ``)``, ``+``, ``#``) and white space at its end."""
    bare = F.regexp_replace(cut(text, span["start"], span["end"]), r"(?:(?![)+#])" + PUNCTUATION_CLASS + r"|[ \t\n\r\x0B\f])+\z", "")
    return F.struct(span["start"].alias("start"), (span["start"] + F.length(bare)).alias("end"), span["class"].alias("class"))
