"""Small literal rows for rules that the tables do not reach or that SQL cannot express, with the rows they must give.

The expected rows are worked out by hand from the rules; each query runs the operator on all rows of its fixture.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as t
from spanloom.functions.markup import text_of_html
from spanloom.operators import documents, entities, extract, punctuation, spans, store, training
from spanloom.plans import fuzzy
from spanloom.schemas import KEYWORD, LINK, SPANS
from spanloom.transformers import TextStemmer, stop_words

_DATUM = f"id int, text string, entities {SPANS}"
_MERGE = f"id int, text string, entities {SPANS}, status map<string,string>, saved_entities {SPANS}, saved_status map<string,string>"
_DOC = "id long, object_type string, system_id string, root_id long, is_active boolean, text string, ner_text string"
OLD, NOW = datetime(2020, 1, 1), datetime(2030, 1, 1)


def _rows(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("id", *keep, F.inline("entities")).select("id", *keep, "start", "end", "class")


def spaced_words(spark: SparkSession, d: str) -> DataFrame:
    words = ["a/b", "и/или", "24/7", "python/питон", "C/", "a\\b", "3,14", "a;b", "x y", ";;a"]
    return spark.createDataFrame(list(enumerate(words)), "id int, text string").select("id", punctuation.fix_punctuation(F.col("text")).alias("text"))


def split_lists(spark, d):
    rows = [(0, "java, go; c", [(0, 11, "P")]), (1, "python/питон", [(0, 12, "P")]), (2, "и/или", [(0, 5, "P")])]
    df = spark.createDataFrame(rows, _DATUM)
    return _rows(df.withColumn("entities", punctuation.split_spans(F.col("text"), F.col("entities"))))


def cast_names(spark, d):
    rows = [(0, "с++ и с", [(0, 3, "P"), (6, 7, "P")]), (1, "с++ и", [(0, 4, "P")]), (2, "Си", [(0, 2, "P")]), (3, "С ++ x", [(0, 4, "P")]), (4, "нет", None)]
    return spark.createDataFrame(rows, _DATUM).select("id", spans.cast_tokens(spans.join_plus(F.col("text")), F.col("entities")).alias("text"))


def trimmed(spark, d):
    rows = [
        (0, "знание с SQL базы", [(0, 17, "X")]), (1, "опыт", [(0, 4, "X")]), (2, "с++ и базы", [(0, 10, "X")]), (3, "базы данных.,", [(0, 13, "X")]),
        (4, "C#;", [(0, 3, "X")]), (5, "знание SQL; ", [(0, 12, "X")]), (6, "(x)", [(0, 3, "X")]),
    ]
    trim = lambda e: punctuation.trim_span_end(F.col("text"), spans.trim_span_start(F.col("text"), e))
    return _rows(spark.createDataFrame(rows, _DATUM).withColumn("entities", F.transform("entities", trim)))


def aligned(spark, d):
    rows = [
        (0, "базы данных", [("базы", "база"), (" ", None), ("данных", "данные"), ("\n", None)]),
        (1, "ab", [("a", "a"), ("b\n", "b")]),
        (2, "ab\n", [("ab", "ab"), ("\n", None)]),
        (3, "ab", []),
    ]
    df = spark.createDataFrame(rows, "id int, token string, parts array<struct<text:string,lemma:string>>")
    got = df.select("id", F.posexplode(spans.align_analysis(F.col("token"), F.col("parts"))).alias("pos", "p"))
    return got.select("id", "pos", "p.text", "p.lemma")


def trimmed_by_analysis(spark, d):
    """T22 with an analyser: lemmas of inflected words."""
    rows = [(0, "владеющий базами данных", [(0, 23, "X")])]
    parts = F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).cast("string").alias("lemma")) for a, b in (("владеющий", "владеть"), (" ", None), ("базами", "база"), (" ", None), ("данных\n", "данные"))])
    df = spark.createDataFrame(rows, _DATUM)
    return _rows(df.withColumn("entities", F.transform("entities", lambda e: spans.trim_span_start(F.col("text"), e, analyse=lambda v: parts))))


def spaced(spark, d):
    df = spark.createDataFrame([(0, "a,b;c/d", [(0, 1, "A"), (2, 3, "B"), (4, 5, "C"), (6, 7, "D")])], _DATUM)
    return _rows(entities.space_marks(df), "text")


def rebuilt(spark, d):
    return _rows(entities.rebuild(spark.createDataFrame([(0, "A. B", [(3, 4, "X")])], _DATUM)), "text")


def prepared(spark, d):
    text = "Знаю Elixir. Опытом работы с базами данных"
    df = spark.createDataFrame([(0, text, [(5, 11, "Technology"), (13, 42, "Subject")])], _DATUM)
    return _rows(entities.preprocess(df, ["elixir"], {"опытом": "опыт", "работы": "работа"}), "text")


def labels(spark, d):
    got = training.labels_of(spark.createDataFrame([(0, "Go is. SQL", [(0, 2, "P"), (7, 10, "T")])], _DATUM))
    both = got.select("id", F.posexplode(F.arrays_zip("labels", "tokens")).alias("sentence", "z"))
    return both.select("id", "sentence", F.array_join("z.labels", " ").alias("labels"), F.array_join("z.tokens", " ").alias("tokens"))


def tag_free(spark, d):
    rows = ["<p>a<b>b</b></p><script>x</script>", "plain", "x &amp; y", "<!-- c --><i>z</i>"]
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string").select("id", text_of_html(F.col("text")).alias("text"))


def word_kinds(spark, d):
    df = spark.createDataFrame(list(enumerate(["и", "SQL", ".,", "Или", ""])), "id int, w string")
    listed = F.array(*[F.lit(w) for w in stop_words(spark, "russian")])
    return df.select("id", F.array_contains(listed, F.lower("w")).alias("stop"), t.is_punctuation(F.col("w")).alias("marks"))


def bare_words(spark, d):
    df = spark.createDataFrame(list(enumerate(["и SQL, или Go", "Не  сервер", ""])), "id int, text string")
    return df.select("id", t.remove_stopwords(F.col("text"), stop_words(spark, "russian")).alias("text"))


def stems(spark, d):
    df = spark.createDataFrame([(0, "навыки работающий красивейшая SQL")], "id int, text string")
    return TextStemmer(inputCol="text", outputCol="stems").transform(df).select("id", "stems")


def reanchored(spark, d):
    rows = [(0, "Go go GO", [(0, 2, "X"), (3, 5, "Y"), (6, 8, "Y")], {"go": "added"}, "we Go, going; go"), (1, "a b", [(0, 1, "X")], {}, "nothing here")]
    df = spark.createDataFrame(rows, f"id int, text string, entities {SPANS}, status map<string,string>, new_text string")
    return _rows(spans.reanchor(df), "text")


def _overlapping(spark) -> DataFrame:
    rows = [
        # The saved one is stronger; the new one keeps the place it won before.
        (0, "abcdef", [(0, 4, "A")], {}, [(2, 6, "B")], {"cdef": "confirmed"}),
        # Inside a stronger one.
        (1, "abcdef", [(2, 4, "A")], {}, [(0, 6, "B")], {"abcdef": "added"}),
        # Equally strong: the new one goes first.
        (2, "abcdef", [(0, 3, "A")], {"abc": "added"}, [(0, 6, "B")], {"abcdef": "added"}),
        # Saved and only extracted: dropped.
        (3, "abcdef", [], {}, [(0, 3, "B")], {"abc": "extracted"}),
        # Equal spans: the keyword is confirmed.
        (4, "abcdef", [(0, 3, "A")], {"abc": "extracted"}, [(0, 3, "A")], {"ABC ": "added"}),
        # Of equal place, another class: not equal, and stronger.
        (5, "abcdef", [(0, 3, "A")], {}, [(0, 3, "B")], {"abc": "rejected"}),
        # Three in a chain: the middle one is the weakest and loses to the first.
        (6, "abcdef", [(0, 3, "A"), (2, 5, "B"), (4, 6, "C")], {"abc": "confirmed", "ef": "added"}, None, None),
        (7, "abcdef", None, None, None, None),
    ]
    return spans.merge(spark.createDataFrame(rows, _MERGE))


def overlapping(spark, d):
    return _rows(_overlapping(spark))


def overlapping_status(spark, d):
    return _overlapping(spark).select("id", F.explode("status").alias("value", "status"))


def _short_tags():
    """A tagger that gives tags for the first two tokens only."""
    return lambda docs: [["B-P"] * min(2, len(s)) for s in docs]


def zipped(spark, d):
    df = spark.createDataFrame([(0, "Go SQL Rust"), (1, None), (2, "")], "id int, text string")
    return _rows(extract.extract(df, _short_tags))


def _go_tags():
    return lambda docs: [["B-P" if re.fullmatch("Go", w) else "O" for w in s] for s in docs]


def _shop(spark) -> store.Store:
    docs = spark.createDataFrame([(1, "rpd", "1", None, True, "SQL and Go", None), (2, "rpd", "2", 1, True, "SQL", "SQL"), (3, "vac", "3", None, None, None, None)], _DOC)
    kw = spark.createDataFrame([(5, "sql", "Old", OLD), (6, "gone", "T", OLD)], KEYWORD)
    links = spark.createDataFrame([(2, 5, "confirmed", ([[0, 3]],), OLD, OLD), (2, 6, "added", None, OLD, OLD)], LINK)
    return store.Store(docs, kw, links)


def _saved(spark) -> store.Store:
    new = spark.createDataFrame([(1, "SQL and Go", [(0, 3, "New"), (8, 10, "P"), (0, 3, "New")], {"go": "added"})], f"id long, text string, entities {SPANS}, status map<string,string>")
    return store.save(_shop(spark), new, NOW)


def _links_of(s: store.Store) -> DataFrame:
    return s.links.select("document_id", "keyword_id", "status", F.array_join(F.flatten("meta.indices").cast("array<string>"), ",").alias("marks"), "created_at", "updated_at")


def saved_links(spark, d):
    return _links_of(_saved(spark))


def saved_keywords(spark, d):
    return _saved(spark).keywords.select("id", "value", "type", "updated_at")


def saved_by_user(spark, d):
    """A user left out what was confirmed: it comes back as rejected; what the user had added is gone."""
    new = spark.createDataFrame([(2, "SQL", [], {})], f"id long, text string, entities {SPANS}, status map<string,string>")
    return _links_of(store.save(_shop(spark), new, NOW, is_user=True))


def saved_data(spark, d):
    got = store.saved_data(_shop(spark))
    flat = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["start"], e["end"], e["class"])), ",")
    return got.select("id", "text", flat.alias("spans"), F.array_join(F.transform(F.map_entries("status"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("status"))


def extracted_by_dictionary(spark, d):
    return _links_of(extract.extract_documents(_shop(spark), NOW, 1))


def extracted_one(spark, d):
    return _links_of(extract.extract_documents(_shop(spark), NOW, 1, load=_go_tags, needle="rpd:1"))


def one_needle(spark, d):
    docs = _shop(spark).documents
    found = [documents.by_needle(docs, n, r).select(F.lit(str(n)).alias("needle"), F.lit(r).alias("root"), "id") for n, r in ((2, False), ("rpd:2", True), ("vac:3", False), (99, False))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.unionByName(documents.duplicates_of(docs, 2).select(F.lit("dupes of 2").alias("needle"), F.lit(True).alias("root"), "id"))


def _close(spark) -> DataFrame:
    texts = ["abcdefghij", "abcdefghij", "abcdefghix", "abcd", "abce", "zzzzzzzzzz", "ABCDEFGHIJ", "abcdefghiy", None]
    return spark.createDataFrame(list(enumerate(texts)), "idx long, text string")


def close_edges(spark, d):
    return fuzzy.edges(_close(spark), 0.85, 5)


def close_canonical(spark, d):
    return fuzzy.canonical(_close(spark), 0.85, 5)


def close_clusters(spark, d):
    return fuzzy.clusters(close_canonical(spark, d)).select("canonical", F.array_join("members", ",").alias("members"))


QUERIES = {
    "T8_T13_cases": spaced_words,
    "T19_cases": split_lists,
    "T21_C13_cases": cast_names,
    "T22_cases": trimmed,
    "T23_cases": aligned,
    "T22_T23_cases": trimmed_by_analysis,
    "T26_cases": spaced,
    "T27_cases": rebuilt,
    "T28_cases": prepared,
    "T7_cases": labels,
    "C5_cases": tag_free,
    "C7_C8_cases": word_kinds,
    "C9_cases": bare_words,
    "C10_cases": stems,
    "G1_A6_cases": reanchored,
    "G2_G3_J13_O2_X1_X3_C12_cases": overlapping,
    "G3_X4_status_cases": overlapping_status,
    "J16_U1_cases": zipped,
    "S8_M4_M6_C15_cases": saved_links,
    "S8_M1_cases": saved_keywords,
    "G5_M2_M6_cases": saved_by_user,
    "G7_cases": saved_data,
    "U6_U8_A4_cases": extracted_by_dictionary,
    "U7_S9_U3_cases": extracted_one,
    "J2_needle_cases": one_needle,
    "D5_J15_F10_O4_cases": close_edges,
    "D5_D6_cases": close_canonical,
    "D7_A13_cases": close_clusters,
}


def _cell(v) -> str:
    if v is None:
        return "null"
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def _values(columns: str, *rows: tuple) -> str:
    """SQL of literal rows; columns are ``name type`` pairs."""
    pairs = [c.strip().split(" ") for c in columns.split(",")]
    cols = ", ".join(f'cast("{n}" as {k}) as "{n}"' for n, k in pairs)
    names = ", ".join(f'"{n}"' for n, _ in pairs)
    return f"select {cols} from (values {', '.join('(' + ', '.join(map(_cell, r)) + ')' for r in rows)}) v({names})"


_SPAN = "id int, start int, end int, class varchar"
_TEXT_SPAN = "id int, text varchar, start int, end int, class varchar"
_LINK = "document_id bigint, keyword_id bigint, status varchar, marks varchar, created_at timestamp, updated_at timestamp"
_OLD, _NOW = "2020-01-01 00:00:00", "2030-01-01 00:00:00"
_KEPT = [(2, 5, "confirmed", "0,3", _OLD, _OLD), (2, 6, "added", None, _OLD, _OLD)]

ORACLE = {
    "T8_T13_cases": _values("id int, text varchar", (0, "a / b"), (1, "и/или"), (2, "24/7"), (3, "python / питон"), (4, "C /"), (5, "a\\b"), (6, "3, 14"), (7, "a; b"), (8, "x y"), (9, "; ; a")),
    "T19_cases": _values(_SPAN, (0, 0, 4, "P"), (0, 5, 8, "P"), (0, 9, 11, "P"), (1, 0, 6, "P"), (1, 7, 12, "P"), (2, 0, 5, "P")),
    "T21_C13_cases": _values("id int, text varchar", (0, "c++ и c"), (1, "c++ и"), (2, "Си"), (3, "C++  x"), (4, "нет")),
    "T22_cases": _values(_SPAN, (0, 9, 17, "X"), (1, 0, 4, "X"), (2, 0, 10, "X"), (3, 0, 11, "X"), (4, 0, 2, "X"), (5, 7, 10, "X"), (6, 0, 3, "X")),
    "T23_cases": _values(
        "id int, pos int, text varchar, lemma varchar", (0, 0, "базы", "база"), (0, 1, " ", None), (0, 2, "данных", "данные"), (1, 0, "a", "a"), (1, 1, "b", "b"), (2, 0, "ab", "ab"), (2, 1, "", None)
    ),
    "T22_T23_cases": _values(_SPAN, (0, 10, 23, "X")),
    "T26_cases": _values(_TEXT_SPAN, *[(0, "a, b; c / d", *s) for s in ((0, 1, "A"), (3, 4, "B"), (6, 8, "C"), (10, 11, "D"))]),
    "T27_cases": _values(_TEXT_SPAN, (0, "A. B. ", 3, 4, "X")),
    "T28_cases": _values(_TEXT_SPAN, *[(0, "Знаю Elixir. Опытом работы с базами данных. ", *s) for s in ((5, 11, "ProgLanguage"), (29, 42, "Subject"))]),
    "T7_cases": _values("id int, sentence int, labels varchar, tokens varchar", (0, 0, "P O", "Go is"), (0, 1, "T", "SQL")),
    "C5_cases": "select cast(id as int) as id, text from (values (0, 'a' || chr(10) || 'b'), (1, 'plain'), (2, 'x & y'), (3, 'z')) v(id, text)",
    "C7_C8_cases": _values("id int, stop boolean, marks boolean", (0, True, False), (1, False, False), (2, False, True), (3, True, False), (4, False, True)),
    "C9_cases": _values("id int, text varchar", (0, "SQL Go"), (1, "сервер"), (2, "")),
    "C10_cases": _values("id int, stems varchar", (0, "навык работа красив sql")),
    "G1_A6_cases": _values(_TEXT_SPAN, (0, "we Go, going; go", 3, 5, "X"), (0, "we Go, going; go", 14, 16, "X")),
    "G2_G3_J13_O2_X1_X3_C12_cases": _values(
        _SPAN, (0, 0, 4, "A"), (0, 2, 6, "B"), (1, 0, 6, "B"), (2, 0, 3, "A"), (4, 0, 3, "A"), (5, 0, 3, "B"), (6, 0, 3, "A"), (6, 4, 6, "C")
    ),
    "G3_X4_status_cases": _values("id int, value varchar, status varchar", (2, "abc", "added"), (4, "abc", "confirmed"), (6, "abc", "confirmed"), (6, "ef", "added")),
    "J16_U1_cases": _values(_SPAN, (0, 0, 2, "P"), (0, 3, 6, "P")),
    "S8_M4_M6_C15_cases": _values(_LINK, *_KEPT, (1, 5, "extracted", "0,3,0,3", _NOW, _NOW), (1, 7, "added", "8,10", _NOW, _NOW)),
    "S8_M1_cases": _values("id bigint, value varchar, type varchar, updated_at timestamp", (5, "sql", "Old", _NOW), (6, "gone", "T", _OLD), (7, "go", "P", _NOW)),
    "G5_M2_M6_cases": _values(_LINK, (2, 5, "rejected", "0,3", _OLD, _NOW)),
    "G7_cases": _values("id bigint, text varchar, spans varchar, status varchar", (1, "SQL and Go", "", ""), (2, "SQL", "0:3:Old", "sql=confirmed"), (3, None, "", "")),
    "U6_U8_A4_cases": _values(_LINK, *_KEPT, (1, 5, "extracted", "0,3", _NOW, _NOW)),
    "U7_S9_U3_cases": _values(_LINK, *_KEPT, (1, 7, "extracted", "8,10", _NOW, _NOW)),
    "J2_needle_cases": _values("needle varchar, root boolean, id bigint", ("2", False, 2), ("rpd:2", True, 1), ("vac:3", False, 3), ("dupes of 2", True, 2)),
    "D5_J15_F10_O4_cases": _values("a bigint, b bigint, weight double", (2, 0, 0.9), (6, 0, 1.0), (7, 0, 0.9), (7, 2, 0.9)),
    "D5_D6_cases": _values("idx bigint, canonical bigint", (1, 0), (2, 0), (6, 0), (7, 0)),
    "D7_A13_cases": _values("canonical bigint, members varchar", (0, "1,2,6,7,0")),
}
