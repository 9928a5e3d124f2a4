"""Texts, sentences, marks and labels on hand-written cases and against state machines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as t
from spanloom.functions.markup import plain_text
from spanloom.operators import punctuation as p
from spanloom.operators import sentences as s
from spanloom.operators import spans as x
from spanloom.transformers import stem

L = F.lit


def spans(*rows):
    return F.array(*[F.struct(L(a).alias("start"), L(b).alias("end"), L(c).alias("class")) for a, b, c in rows]).cast("array<struct<start:int,end:int,class:string>>")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("A. B!?C\n\n\nD", [(0, "A"), (3, "B"), (4, "!?"), (6, "C"), (10, "D")]),
        ("Да! Нет? Да", [(0, "Да! Нет? Да")]),
        ("текст\nНавыки:\nSQL", [(0, "текст\n"), (6, "Навыки:\nSQL")]),
        ("", []),
        (" . . ", []),
        ("x" * 60 + "\n" + "y" * 60, [(0, "x" * 60), (61, "y" * 60)]),
        ("x" * 40 + "\n" + "y" * 40, [(0, "x" * 40 + "\n" + "y" * 40)]),
    ],
)
def test_sentences(one, text, expected):
    assert [(r["offset"], r["text"]) for r in one(s.extract_sentences(L(text)))] == expected


def test_sentences_of_null(one):
    assert one(s.extract_sentences(L(None).cast("string"))) is None


def test_last_entity_cuts_last_line(one):
    got = one(s.extract_sentences(L("a\nb"), spans((5, 6, "X"))))
    assert [r["text"] for r in got] == ["a\n", "b"]


def test_pieces_join_to_the_text(one):
    text = "a. b!?c\n\n\n\nd. "
    assert "".join(one(t.pieces(L(text), s.DELIMITER))) == text


@pytest.mark.parametrize(
    "word,expected",
    [("a/b", "a / b"), ("и/или", "и/или"), ("24/7", "24/7"), ("python/питон", "python / питон"), ("C/", "C /"), ("a\\b", "a\\b"), ("3,14", "3, 14"), ("a;b", "a; b"), ("", ""), ("x y", "x y")],
)
def test_punctuation(one, word, expected):
    assert one(p.fix_punctuation(L(word))) == expected


def test_moved_spans_keep_their_text(spark):
    rows = spark.createDataFrame([("a,b;c/d",)], "text string").select("text", spans((0, 1, "A"), (2, 3, "B"), (4, 5, "C"), (6, 7, "D")).alias("e"))
    parts = p.spaced_pieces(F.col("text"))
    r = rows.select(p.text_of(parts).alias("t"), p.move_spans(parts, F.col("e")).alias("e")).collect()[0]
    assert [r["t"][e["start"] : e["end"]].strip() for e in r["e"]] == ["a", "b", "c", "d"]
    assert r["e"][-1]["end"] == len(r["t"])


def test_split_and_trimmed_spans(one):
    assert [(e["start"], e["end"]) for e in one(p.split_spans(L("java, go; c"), spans((0, 11, "P"))))] == [(0, 4), (5, 8), (9, 11)]
    for value, bare in (("SQL.,", "SQL"), ("C++", "C++"), ("(x)", "(x)"), ("C#;", "C#")):
        e = one(p.trim_span_end(L(value), F.struct(L(0).alias("start"), L(len(value)).alias("end"), L("X").alias("class"))))
        assert value[: e["end"]] == bare
    e = one(x.trim_span_start(L("знание с SQL базы"), F.struct(L(0).alias("start"), L(17).alias("end"), L("X").alias("class"))))
    assert e["start"] == 9


def test_tokens_and_tags(one):
    tok = F.array(*[F.struct(L(a).alias("token"), L(b).alias("offset")) for a, b in (("aaa", 0), ("bb", 3), ("cc", 6))])
    assert [r["tag"] for r in one(x.tag_tokens(tok, spans((0, 3, "X"), (3, 8, "Y"))))] == ["B-X", "O", "I-Y"]
    assert [r["tag"] for r in one(x.tag_tokens(tok, L(None).cast("array<struct<start:int,end:int,class:string>>")))] == ["O", "O", "O"]


def _decode(tags):
    out, start = [], None
    for i, tag in enumerate(tags):
        kind = None if tag == "O" else tag[2:]
        if start is not None and tag.startswith("I") and kind == out[-1][2]:
            out[-1][1] = 2 * i + 1
        elif kind:
            out.append([2 * i, 2 * i + 1, kind])
            start = i
        if tag == "O":
            start = None
    return out


def test_decode_equals_a_state_machine(spark):
    rng = random.Random(7)
    cases = [[rng.choice(["O", "B-x", "I-x", "B-y", "I-y"]) for _ in range(rng.randrange(0, 9))] for _ in range(300)]
    rows = [(i, [("t", tag, 2 * k) for k, tag in enumerate(tags)]) for i, tags in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, tokens array<struct<token:string,tag:string,offset:int>>")
    for r in df.select("i", x.decode_tags(F.col("tokens")).alias("e")).collect():
        assert [[e["start"], e["end"], e["class"]] for e in r["e"]] == _decode(cases[r["i"]])


def test_decode_without_bio_has_no_class(one):
    tok = F.array(F.struct(L("ab").alias("token"), L("X").alias("tag"), L(3).alias("offset")))
    assert [tuple(e) for e in one(x.decode_tags(tok, False))] == [(3, 5, None)]


def test_attached_spans(one):
    sent = s.extract_sentences(L("A b. C d. E"))
    got = one(s.attach_entities(sent, spans((0, 1, "X"), (5, 6, "Y"), (99, 100, "Z"))))
    assert [(r["text"], [e["class"] for e in r["entities"]]) for r in got] == [("A b", ["X"]), ("C d", ["Y"])]
    assert len(one(s.attach_entities(sent, spans(), True))) == 3
    assert one(s.attach_entities(sent, spans())) == []


def test_rebuilt_sentences(one):
    got = one(s.rebuild_sentences(s.attach_entities(s.extract_sentences(L("A. B")), spans((3, 4, "X")), True)))
    assert got["text"] == "A. B. " and [tuple(e) for e in got["entities"]] == [(3, 4, "X")]


def test_small_functions(one):
    assert one(t.fix_text(L("a. . b"))) == "a. b"
    assert one(t.fix_keyword(L(" Python\n"))) == "python"
    assert one(x.join_plus(L("С ++ и C ++"))) == "C++  и c++ "
    assert len(one(x.join_plus(L("С\n++")))) == 4
    assert one(x.cast_tokens(L("с++ и с"), spans((0, 3, "P"), (6, 7, "P")))) == "c++ и c"
    assert one(t.is_punctuation(L(""))) and not one(t.is_punctuation(L("a.")))
    assert one(t.strip_characters(L("1. one\n- two;"))) == " one.\n two"
    assert plain_text("<p>a<b>b</b></p><script>x</script>") == "a\nb"
    assert plain_text(None) is None
    assert x.label_list(["O", "A"]) == ["O", "B-A", "I-A"] and x.label_list(["O", "A"], False) == ["O", "A"]
    assert [stem(w) for w in ("навыки", "работающий", "красивейшая", "SQL")] == ["навык", "работа", "красив", "sql"]


def test_slash_and_comma_rules_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aб1/, ") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def slash(w):
        parts = re.split("(/)", w)
        english = sum(not re.search("[а-яА-Я]", q) for q in parts if q not in ("\\", "/ ", " ", ""))
        idle = sum(q in ("\\", "/ ", " ", "") for q in parts)
        return len(parts) > 1 and not any(q.isnumeric() for q in parts) and english >= (len(parts) - idle) / 2

    def comma(w):
        parts = re.split("(,)", w)
        idle = sum(q in (" ", ",", ", ") for q in parts)
        english = sum(not re.search("[а-яА-Я]", q) for q in parts if q not in (" ", ",", ", "))
        n = len(parts) - idle
        return len(parts) > 1 and (w.count(",") > 6 or english >= n / 2.5 or sum(q.count(" ") + 1 for q in parts) <= n * 2.5)

    for r in df.select("w", p.split_by_slash(F.col("w")).isNotNull().alias("s"), p.split_by_comma(F.col("w")).isNotNull().alias("c")).collect():
        assert r["s"] == slash(r["w"]), r["w"]
        assert r["c"] == comma(r["w"]), r["w"]
