"""Spans (start, end, class) on a text: filters, labels, and merging with human feedback.

Operators are expressions over one row, or chains of such columns. Arrays of spans are short, so nothing is exploded and
nothing is shuffled.
Null arrays and maps count as empty. Status maps are keyed by the stored form of a keyword (lower case, trimmed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import PUNCTUATION_CLASS, cut, fix_keyword, has_no_cyrillic, let
from spanloom.schemas import ADDED, CONFIRMED, EXTRACTED, REJECTED, SPANS, priority

_STATUS = "map<string,string>"


def span(start: Column, end: Column, kind: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("class"))


def spans_or_none(entities: Column) -> Column:
    return F.coalesce(entities, F.array().cast(SPANS))


def status_or_none(status: Column) -> Column:
    """The status map, keys in stored form; of keys that become equal the last holds."""
    entries = F.transform(
        F.map_entries(F.coalesce(status, F.create_map().cast(_STATUS))), lambda e: F.struct(fix_keyword(e["key"]).alias("key"), e["value"].alias("value"))
    )
    return last_wins(entries)


def last_wins(entries: Column) -> Column:
    """A map of (key, value) entries in which the last entry of a key holds."""
    return F.aggregate(
        entries,
        F.create_map().cast(_STATUS),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))),
    )


def value_of(text: Column, e: Column) -> Column:
    """The keyword a span stands for."""
    return fix_keyword(cut(text, e["start"], e["end"]))


def by_start(entities: Column) -> Column:
    """Ordered by start; spans of equal start keep their order."""
    keyed = F.transform(entities, lambda e, i: F.struct(e["start"].alias("s"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).otherwise(a["i"] - b["i"])), lambda k: k["e"])


def non_empty(entities: Column) -> Column:
    return F.filter(spans_or_none(entities), lambda e: e["start"] < e["end"])


def chain(inputs: dict[str, Column], stages: list, out) -> Column:
    """Values computed stage by stage inside a row, each once: a stage gets the values so far and gives new ones by name."""

    def nest(s: Column, names: list[str], rest: list) -> Column:
        if not rest:
            return out(s)
        new = rest[0](s)
        kept = [n for n in names if n not in new]
        both = F.struct(*[s[n].alias(n) for n in kept], *[c.alias(n) for n, c in new.items()])
        return let(both, lambda t: nest(t, [*kept, *new], rest[1:]))

    return let(F.struct(*[c.alias(n) for n, c in inputs.items()]), lambda s: nest(s, list(inputs), stages))


def _replaced(data: DataFrame, result: Column, *drop: str) -> DataFrame:
    """``data`` with the spans and statuses of ``result``, without the columns that went into it."""
    made = data.withColumn("_made", result).withColumn("entities", F.col("_made.entities")).withColumn("status", F.col("_made.status"))
    return made.drop("_made", *drop)


def filter_rejected(data: DataFrame) -> DataFrame:
    """``data`` (text, entities, status, ...) without rejected keywords; a span whose keyword has no status stays."""

    def out(s: Column) -> Column:
        gone = lambda e: F.coalesce(F.try_element_at(s["st"], value_of(F.col("text"), e)) == REJECTED, F.lit(False))
        return F.struct(
            F.filter(s["e"], lambda e: ~gone(e)).alias("entities"), F.map_filter(s["st"], lambda k, v: F.coalesce(v != REJECTED, F.lit(True))).alias("status")
        )

    return _replaced(data, chain({"e": spans_or_none(F.col("entities")), "st": status_or_none(F.col("status"))}, [], out))


def override_class(text: Column, entities: Column, names: Column, kind: str) -> Column:
    """Spans whose keyword is in ``names`` (an array) get the class ``kind``."""
    return F.transform(
        entities, lambda e: span(e["start"], e["end"], F.when(F.array_contains(names, value_of(text, e)), F.lit(kind)).otherwise(e["class"]))
    )


# --- Labels of tokens -------------------------------------------------------------------------------------------------


#: A token: a word or a single mark.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"


def tokens_of(sentence: Column, pattern: str = TOKEN) -> Column:
    """Tokens of a sentence struct (offset, text) as array<struct<token, offset>>; offsets count in the document.

    The default cuts into words and single marks. A language model's tokens may take its place (``operators.extract``).
    """
    from spanloom.functions.text import pieces, placed

    parts = placed(pieces(sentence["text"], pattern))
    # Matches are every second piece.
    own = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["i"] % 2 == 1)
    return F.transform(own, lambda x: F.struct(x["p"]["text"].alias("token"), (x["p"]["offset"] + sentence["offset"]).alias("offset")))


def tag_tokens(tokens: Column, entities: Column, with_bio: bool = True) -> Column:
    """array<struct<token, tag, offset>>: the class of the span a token begins in, else O.

    The span looked at moves on only when it ended before the token. So of two spans that touch, the first token of
    the second is O; and a token that begins inside a span without beginning it is I.
    """
    none = F.array().cast("array<struct<token:string,tag:string,offset:int>>")

    def tag(spans: Column) -> Column:
        n = F.size(spans)

        def step(s: Column, t: Column) -> Column:
            # Spans that ended before the token are passed, in order; the first that did not is looked at.
            passed = F.aggregate(
                spans,
                F.struct(s["at"].alias("at"), F.lit(0).alias("i")),
                lambda w, e: F.struct(F.when((w["i"] == w["at"]) & (e["end"] < t["offset"]), w["at"] + 1).otherwise(w["at"]).alias("at"), (w["i"] + 1).alias("i")),
                lambda w: w["at"],
            )

            def put(x: Column) -> Column:
                inside = (x["at"] < n) & (x["e"]["start"] <= t["offset"]) & (x["e"]["end"] > t["offset"]) & ~t["token"].rlike(r"\A\s*\n+\s*\z")
                mark = F.concat(F.when(x["e"]["start"] == t["offset"], F.lit("B-")).otherwise(F.lit("I-")), x["e"]["class"]) if with_bio else x["e"]["class"]
                out = F.struct(t["token"].alias("token"), F.when(inside, mark).otherwise(F.lit("O")).alias("tag"), t["offset"].cast("int").alias("offset"))
                return F.struct(x["at"].alias("at"), F.concat(s["out"], F.array(out)).alias("out"))

            return let(let(passed, lambda at: F.struct(at.alias("at"), F.get(spans, at).alias("e"))), put)

        return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])

    return let(spans_or_none(entities), tag)


def decode_tags(tokens: Column, with_bio: bool = True) -> Column:
    """Spans from tagged tokens (token, tag, offset) of one sentence.

    A B tag, or an I tag of another class than the open span, opens a span; an I tag of its class extends it; O closes it. Without BIO every
    token with a tag other than O is a span of its own, with a null class.
    """
    if not with_bio:
        hit = F.filter(tokens, lambda t: t["tag"] != "O")
        return F.transform(hit, lambda t: span(t["offset"], t["offset"] + F.length(t["token"]), F.lit(None).cast("string")))

    def step(s: Column, t: Column) -> Column:
        kind = F.when(t["tag"] == "O", F.lit(None)).otherwise(F.substring_index(t["tag"], "-", -1))
        grows = (t["tag"] != "O") & ~t["tag"].startswith("B") & s["open"].eqNullSafe(kind)
        end = t["offset"] + F.length(t["token"])
        n = F.size(s["out"])
        last = F.try_element_at(s["out"], F.lit(-1))
        longer = F.concat(F.slice(s["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(span(last["start"], end, last["class"])))
        out = F.when(t["tag"] == "O", s["out"]).when(grows, longer).otherwise(F.concat(s["out"], F.array(span(t["offset"], end, kind))))
        return F.struct(kind.alias("open"), out.alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(tokens, start, step, lambda s: s["out"])


def annotated(text: Column, entities: Column) -> Column:
    """array<struct<text, class>>: plain pieces (null class) and spans in turn; empty plain pieces stay, overlaps repeat text."""
    none = F.array().cast("array<struct<text:string,class:string>>")
    piece = lambda t, c: F.struct(t.alias("text"), c.cast("string").alias("class"))
    return F.aggregate(
        spans_or_none(entities),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, e: F.struct(
            e["end"].alias("at"),
            F.concat(s["out"], F.array(piece(cut(text, s["at"], e["start"]), F.lit(None)), piece(cut(text, e["start"], e["end"]), e["class"]))).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.array(piece(F.substring(text, s["at"] + 1, F.length(text)), F.lit(None)))),
    )


def label_list(labels: list[str], with_bio: bool = True) -> list[str]:
    """The labels a model tells apart: O as it is, every other class as B and I."""
    return [x for c in labels for x in ((c,) if c == "O" or not with_bio else (f"B-{c}", f"I-{c}"))]


# --- Merging with saved spans -----------------------------------------------------------------------------------------


def occurrences(text: Column, value: Column, boundary: bool = True) -> Column:
    """Starts of ``value`` in a text, from left to right without overlap; with ``boundary`` only whole words."""
    word = r"\A[\p{L}\p{M}\p{N}_]\z"

    def find(x: Column) -> Column:
        n = F.length(x["v"])
        place = F.filter(
            F.sequence(F.lit(0), F.greatest(F.length(x["t"]) - n, F.lit(0))), lambda i: (n > 0) & (F.substring(x["t"], i + 1, n) == x["v"])
        )
        if boundary:
            char = lambda i: F.when(i >= 0, F.substring(x["t"], i + 1, F.lit(1))).otherwise(F.lit(""))
            place = F.filter(place, lambda i: ~char(i - 1).rlike(word) & ~char(i + n).rlike(word))
        return F.aggregate(
            place,
            F.array().cast("array<int>"),
            lambda out, i: F.when((F.size(out) == 0) | (i >= F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + n), F.concat(out, F.array(i))).otherwise(out),
        )

    # Most keywords do not occur at all; those are told at once.
    return F.when(text.contains(value), let(F.struct(text.alias("t"), value.alias("v")), find)).otherwise(F.array().cast("array<int>"))


def reanchor(data: DataFrame, new_text: str = "new_text") -> DataFrame:
    """``data`` (text, entities, status, new_text, ...): saved spans looked up again in the changed text.

    Every occurrence of a saved keyword becomes a span of the class the keyword had first; its status goes along, extracted if it
    has none. Keywords without spans vanish. Texts become the new texts.
    """
    named = F.transform(spans_or_none(F.col("entities")), lambda e: F.struct(value_of(F.col("text"), e).alias("value"), e["class"].alias("class")))

    def first_classes(s: Column) -> dict:
        kind = lambda v: F.get(F.filter(s["named"], lambda x: x["value"] == v), 0)["class"]
        return {"first": F.transform(F.array_distinct(F.transform(s["named"], lambda x: x["value"])), lambda v: F.struct(v.alias("value"), kind(v).alias("class")))}

    def found(s: Column) -> dict:
        one = lambda x: F.transform(occurrences(s["low"], x["value"]), lambda i: span(i, i + F.length(x["value"]), x["class"]))
        return {"found": F.flatten(F.transform(s["first"], one))}

    def out(s: Column) -> Column:
        kept = F.transform(s["first"], lambda x: F.struct(x["value"].alias("key"), F.coalesce(F.try_element_at(s["st"], x["value"]), F.lit(EXTRACTED)).alias("value")))
        return F.struct(by_start(s["found"]).alias("entities"), F.map_from_entries(kept).alias("status"))

    inputs = {"named": named, "st": status_or_none(F.col("status")), "low": F.lower(new_text)}
    return _replaced(data, chain(inputs, [first_classes, found], out)).withColumn("text", F.col(new_text)).drop(new_text)


def merge(data: DataFrame, carry_status: bool = False) -> DataFrame:
    """``data`` (text, entities, status, saved_entities, saved_status, ...): new spans merged with saved ones on the same text.

    Saved spans that were only extracted are dropped. A saved span equal to a new one sets the keyword's
    status: confirmed if it was confirmed or added, rejected if rejected. Other saved spans are added; their
    status is kept only with ``carry_status``. Where spans overlap, the one of the higher status wins, then new before saved, then
    the earlier; it wins from left to right over the places where spans begin, and a winner stays even if it loses
    further right. Empty spans vanish.
    """
    value = lambda e: value_of(F.col("text"), e)
    none = F.array().cast("array<int>")

    def told(s: Column) -> dict:
        one = lambda e: F.struct(e.alias("e"), value(e).alias("v"), F.coalesce(F.try_element_at(s["sb"], value(e)), F.lit(EXTRACTED)).alias("st"))
        return {"told": F.filter(F.transform(s["b"], one), lambda x: x["st"] != EXTRACTED)}

    def parted(s: Column) -> dict:
        equal = lambda x: F.exists(s["a"], lambda e: e.eqNullSafe(x["e"]))
        return {"extra": F.filter(s["told"], lambda x: ~equal(x)), "equal": F.filter(s["told"], lambda x: equal(x) & x["st"].isin(CONFIRMED, ADDED, REJECTED))}

    def statuses(s: Column) -> dict:
        decided = F.transform(s["equal"], lambda x: F.struct(x["v"].alias("key"), F.when(x["st"] == REJECTED, F.lit(REJECTED)).otherwise(F.lit(CONFIRMED)).alias("value")))
        return {"status": last_wins(F.concat(F.map_entries(s["sa"]), decided))}

    def ranked(s: Column) -> dict:
        rank = lambda v, own: priority(F.coalesce(F.try_element_at(s["status"], v), own))
        mine = F.transform(s["a"], lambda e: F.struct(e.alias("e"), rank(value(e), F.lit(None).cast("string")).alias("rank")))
        both = F.concat(mine, F.transform(s["extra"], lambda x: F.struct(x["e"].alias("e"), rank(x["v"], x["st"]).alias("rank"))))
        placed = F.transform(both, lambda x, i: F.struct(x["e"].alias("e"), x["rank"].alias("rank"), i.alias("i")))
        return {"spans": F.filter(placed, lambda x: x["e"]["start"] < x["e"]["end"])}

    def swept(s: Column) -> dict:
        def step(w: Column, p: Column) -> Column:
            here = F.filter(s["spans"], lambda x: (x["e"]["start"] <= p) & (p < x["e"]["end"]) & ~F.array_contains(w["lost"], x["i"]))
            # The ids of the spans that cover the place, the winner first.
            ids = F.transform(F.array_sort(F.transform(here, lambda x: F.struct((-x["rank"]).alias("r"), x["i"].alias("i")))), lambda x: x["i"])
            return let(
                ids,
                lambda k: F.struct(F.array_union(w["won"], F.slice(k, 1, 1)).alias("won"), F.array_union(w["lost"], F.slice(k, F.lit(2), F.size(k))).alias("lost")),
            )

        starts = F.array_sort(F.array_distinct(F.transform(s["spans"], lambda x: x["e"]["start"])))
        return {"won": F.aggregate(starts, F.struct(none.alias("won"), none.alias("lost")), step, lambda w: w["won"])}

    def out(s: Column) -> Column:
        kept = F.transform(F.filter(s["spans"], lambda x: F.array_contains(s["won"], x["i"])), lambda x: x["e"])
        status = s["status"]
        if carry_status:
            status = last_wins(F.concat(F.transform(s["extra"], lambda x: F.struct(x["v"].alias("key"), x["st"].alias("value"))), F.map_entries(status)))
        return F.struct(by_start(kept).alias("entities"), status.alias("status"))

    inputs = {
        "a": spans_or_none(F.col("entities")),
        "b": spans_or_none(F.col("saved_entities")),
        "sa": status_or_none(F.col("status")),
        "sb": status_or_none(F.col("saved_status")),
    }
    return _replaced(data, chain(inputs, [told, parted, statuses, ranked, swept], out), "saved_entities", "saved_status")


def reject_missing(data: DataFrame) -> DataFrame:
    """``data`` (text, entities, status, saved_entities, saved_status, ...): a user's spans, and the saved spans the user left out, as rejected.

    Left-out keywords that a user had added are removed for good; others come back with the status rejected.
    """
    value = lambda e: value_of(F.col("text"), e)

    def gone(s: Column) -> dict:
        saved = F.transform(s["b"], lambda e: F.struct(e.alias("e"), value(e).alias("v")))
        known = lambda x: F.coalesce(F.try_element_at(s["sb"], x["v"]).isin(REJECTED, EXTRACTED, CONFIRMED), F.lit(False))
        return {"gone": F.filter(saved, lambda x: ~F.array_contains(s["kept"], x["v"]) & known(x))}

    def out(s: Column) -> Column:
        marks = F.transform(s["gone"], lambda x: F.struct(x["v"].alias("key"), F.lit(REJECTED).alias("value")))
        return F.struct(
            by_start(F.concat(s["a"], F.transform(s["gone"], lambda x: x["e"]))).alias("entities"), last_wins(F.concat(F.map_entries(s["sa"]), marks)).alias("status")
        )

    inputs = {
        "a": spans_or_none(F.col("entities")),
        "b": spans_or_none(F.col("saved_entities")),
        "sa": status_or_none(F.col("status")),
        "sb": status_or_none(F.col("saved_status")),
    }
    return _replaced(data, chain(inputs, [lambda s: {"kept": F.transform(s["a"], value)}, gone], out), "saved_entities", "saved_status")


# --- Spans prepared for training ----------------------------------------------------------------------------------------

# Lemmas that say nothing at the start of a skill.
EMPTY_WORDS = [
    "знание", "владеть", "знать", "хороший", "отличный", "прекрасный", "и", "с", "умение", "понимание", "принцип", "опыт", "работа", "уметь",
    "навык", "готовность", "уверенный", "в", "роль", "знакомство", "желание", "базовый", "использование",
]

# The two letters с (Cyrillic) and c (Latin) in names of languages.
SAME_LANGUAGE = {"с++": "c++", "с": "c"}
# C++ written apart, and together.
SPACED_PLUS = [("С ++", "C++ "), ("C ++", "c++ "), ("С\n++", "С++ "), ("C\n++", "С++ ")]


def join_plus(text: Column) -> Column:
    """``C ++`` with a blank or line break inside written together; the length stays."""
    for a, b in SPACED_PLUS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cast_tokens(text: Column, entities: Column) -> Column:
    """The text with Cyrillic names of C and C++ in spans replaced by Latin ones, padded to the length of the span."""

    def step(t: Column, e: Column) -> Column:
        n = e["end"] - e["start"]
        out = t
        for a, b in SAME_LANGUAGE.items():
            put = F.when(n > len(b), F.rpad(F.lit(b), F.greatest(n, F.lit(1)), F.lit(" "))).otherwise(F.lit(b))
            out = F.when(value_of(t, e) == a, F.concat(F.substring(t, F.lit(1), e["start"]), put, F.substring(t, e["end"] + 1, F.length(t)))).otherwise(out)
        return out

    return F.aggregate(spans_or_none(entities), text, step)


def align_analysis(token: Column, parts: Column) -> Column:
    """The pieces (text, lemma) of an analysis that make up the token: those that begin inside it, the last cut to its length and
    without a line break at its end. Analysers add a break, and now and then a character."""
    none = F.array().cast("array<struct<text:string,lemma:string>>")
    piece = lambda t, x: F.struct(t.alias("text"), x["lemma"].alias("lemma"))

    def step(s: Column, x: Column) -> Column:
        inside = s["at"] < F.length(token)
        at = s["at"] + F.when(inside, F.length(x["text"])).otherwise(F.lit(0))
        return F.struct(at.alias("at"), F.when(inside, F.concat(s["out"], F.array(piece(x["text"], x)))).otherwise(s["out"]).alias("out"))

    def finish(s: Column) -> Column:
        n = F.size(s["out"])
        last = F.element_at(s["out"], -1)
        over = F.greatest(s["at"] - F.length(token), F.lit(0))
        cut_off = F.regexp_replace(F.substring(last["text"], F.lit(1), F.greatest(F.length(last["text"]) - over, F.lit(0))), r"\n\z", "")
        return F.when(n > 0, F.concat(F.slice(s["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(piece(cut_off, last)))).otherwise(none)

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, finish)


def trim_span_start(text: Column, e: Column, lemmas: Column | None = None, analyse=None) -> Column:
    """A span without words at its start that say nothing, white space and marks.

    Only spans with Cyrillic, longer than five characters and of more than one word are cut, and none that begins with c+, с+, c# or с#.
    ``lemmas`` maps words to lemmas; words it lacks stand for themselves. ``analyse`` is a morphological analyser in their place: a
    function from the span's text to array<struct<text, lemma>>.
    """
    from spanloom.functions.text import pieces

    listed = F.array(*[F.lit(w) for w in EMPTY_WORDS])
    idle = lambda p: F.coalesce(F.array_contains(listed, p["lemma"]), F.lit(False)) | p["text"].rlike(r"\A(?:" + PUNCTUATION_CLASS + r"|\s|\p{Z})+\z")

    def by_table(v: Column) -> Column:
        lemma = lambda p: F.lower(p) if lemmas is None else F.coalesce(F.try_element_at(lemmas, F.lower(p)), F.lower(p))
        words = F.filter(pieces(v, r"[\p{L}\p{M}\p{N}]+"), lambda p: p != "")
        return F.transform(words, lambda p: F.struct(p.alias("text"), lemma(p).alias("lemma")))

    def trim(x: Column) -> Column:
        skip = F.aggregate(
            x["p"],
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda s, p: let(s["on"] & idle(p), lambda on: F.struct(F.when(on, s["n"] + F.length(p["text"])).otherwise(s["n"]).alias("n"), on.alias("on"))),
            lambda s: s["n"],
        )
        apt = ~has_no_cyrillic(x["v"]) & (F.length(x["v"]) > 5) & (F.size(x["p"]) > 1) & ~F.lower(F.substring(x["v"], 1, 2)).isin("c+", "с+", "c#", "с#")
        return span(F.when(apt, e["start"] + skip).otherwise(e["start"]), e["end"], e["class"])

    parts = lambda v: F.struct(v.alias("v"), (by_table(v) if analyse is None else align_analysis(v, analyse(v))).alias("p"))
    return let(let(cut(text, e["start"], e["end"]), parts), trim)
