"""Merging spans with feedback, and the store."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanloom.operators import documents, extract, spans, store, training
from spanloom.schemas import KEYWORD, LINK

SCHEMA = "i int, text string, entities array<struct<start:int,`end`:int,class:string>>, status map<string,string>, saved_entities array<struct<start:int,`end`:int,class:string>>, saved_status map<string,string>"
RANK = {"confirmed": 4, "rejected": 3, "added": 2, "extracted": 1}


def _sweep(text, new, status, saved, saved_status):
    """Place by place over all characters."""
    value = lambda e: text[e[0] : e[1]].lower().strip()
    status, own = dict(status), {}
    ents = list(new)
    for e in saved:
        st = saved_status.get(value(e), "extracted")
        if st == "extracted":
            continue
        if e in new:
            status[value(e)] = "rejected" if st == "rejected" else "confirmed"
        else:
            own[len(ents)] = st
            ents.append(e)
    rank = lambda k: RANK.get(status.get(value(ents[k]), own.get(k)), 0)
    won, lost = [], set()
    for i in range(len(text)):
        here = sorted((k for k, e in enumerate(ents) if e[0] <= i < e[1] and k not in lost), key=lambda k: (-rank(k), k))
        if here:
            if here[0] not in won:
                won.append(here[0])
            lost.update(here[1:])
    return sorted((ents[k][0], k) for k in won), ents, status


def test_merge_equals_a_sweep_over_places(spark):
    rng, text, rows = random.Random(11), "abcdefghijkl", []

    def some():
        out = []
        for _ in range(rng.randrange(0, 5)):
            a = rng.randrange(0, 11)
            out.append((a, min(12, a + rng.randrange(0, 6)), rng.choice("XY")))
        return list(dict.fromkeys(out))

    for i in range(150):
        new, saved = some(), some()
        value = lambda e: text[e[0] : e[1]]
        rows.append((i, text, new, {value(e): rng.choice(list(RANK)) for e in new if rng.random() < 0.6 and value(e)}, saved, {value(e): rng.choice(list(RANK)) for e in saved if value(e)}))
    for r in spans.merge(spark.createDataFrame(rows, SCHEMA)).collect():
        _, text, new, status, saved, saved_status = rows[r["i"]]
        order, ents, st = _sweep(text, new, status, saved, saved_status)
        assert [tuple(e) for e in r["entities"]] == [ents[k] for _, k in order]
        assert r["status"] == st


def test_merge_and_reject_cases(spark):
    row = lambda *a: spark.createDataFrame([(0, *a)], SCHEMA)
    got = spans.merge(row("abc", [(0, 3, "X")], {"abc": "extracted"}, [(0, 3, "X")], {"ABC ": "added"})).collect()[0]
    assert [tuple(e) for e in got["entities"]] == [(0, 3, "X")] and got["status"] == {"abc": "confirmed"}
    four = [(0, 1, "A"), (1, 2, "B"), (2, 3, "C"), (3, 4, "D")]
    st = dict(zip("abcd", ("rejected", "extracted", "confirmed", "added")))
    got = spans.reject_missing(row("abcd", [], {}, four, st)).collect()[0]
    assert [e["class"] for e in got["entities"]] == ["A", "B", "C"] and got["status"] == dict.fromkeys("abc", "rejected")
    got = spans.merge(row("abc", None, None, None, None)).collect()[0]
    assert got["entities"] == [] and got["status"] == {}
    got = spans.filter_rejected(row("ab", [(0, 1, "A"), (1, 2, "B")], {"A": "rejected"}, None, None)).collect()[0]
    assert [e["class"] for e in got["entities"]] == ["B"] and got["status"] == {}


def test_reanchor_takes_the_first_class(spark):
    df = spark.createDataFrame([("Go go GO", [(0, 2, "X"), (3, 5, "Y"), (6, 8, "Y")], {"go": "added"}, "we Go, going; go")], "text string, entities array<struct<start:int,`end`:int,class:string>>, status map<string,string>, new_text string")
    got = spans.reanchor(df).collect()[0]
    assert [tuple(e) for e in got["entities"]] == [(3, 5, "X"), (14, 16, "X")] and got["status"] == {"go": "added"} and got["text"] == "we Go, going; go"


DOC = "id long, object_type string, system_id string, root_id long, is_active boolean, text string, ner_text string"


@pytest.fixture(scope="module")
def shop(spark):
    docs = spark.createDataFrame([(1, "rpd", "1", None, True, "SQL and Go", None), (2, "rpd", "2", 1, True, "SQL", "SQL"), (3, "vac", "3", None, None, None, None)], DOC)
    kw = spark.createDataFrame([(5, "sql", "Old", datetime(2020, 1, 1)), (6, "gone", "T", datetime(2020, 1, 1))], KEYWORD)
    links = spark.createDataFrame([(2, 5, "confirmed", ([[0, 3]],), datetime(2020, 1, 1), datetime(2020, 1, 1)), (2, 6, "added", None, datetime(2020, 1, 1), datetime(2020, 1, 1))], LINK)
    return store.Store(docs, kw, links)


NOW = datetime(2030, 1, 1)
DATUM = "id long, text string, entities array<struct<start:int,`end`:int,class:string>>, status map<string,string>"


def test_saving_found_spans(spark, shop):
    new = spark.createDataFrame([(1, "SQL and Go", [(0, 3, "New"), (8, 10, "P"), (0, 3, "New")], {"go": "added"})], DATUM)
    got = store.save(shop, new, NOW)
    assert {(r["id"], r["value"], r["type"], r["updated_at"] == NOW) for r in got.keywords.collect()} == {(5, "sql", "Old", True), (6, "gone", "T", False), (7, "go", "P", True)}
    links = {(r["document_id"], r["keyword_id"]): (r["status"], r["meta"] and r["meta"]["indices"], r["created_at"] == NOW) for r in got.links.collect()}
    assert links[1, 5] == ("extracted", [[0, 3], [0, 3]], True) and links[1, 7] == ("added", [[8, 10]], True) and links[2, 5][2] is False and (2, 6) in links
    assert {r["id"]: r["ner_text"] for r in got.documents.collect()} == {1: "SQL and Go", 2: "SQL", 3: None}
    again = store.save(got, new, datetime(2031, 1, 1))
    assert {r["updated_at"] for r in again.links.where("document_id = 1").collect()} == {NOW}


def test_saving_as_a_user(spark, shop):
    got = store.save(shop, spark.createDataFrame([(2, "SQL", [], {})], DATUM), NOW, is_user=True)
    assert [(r["keyword_id"], r["status"]) for r in got.links.where("document_id = 2").collect()] == [(5, "rejected")]
    with pytest.raises(store.TextChanged):
        store.save(shop, spark.createDataFrame([(1, "SQL and Go", [], {})], DATUM), NOW, is_user=True)


def test_extraction_is_gated_and_repeatable(spark, shop):
    got = extract.extract_documents(shop, NOW, 1)
    assert {(r["document_id"], r["keyword_id"]) for r in got.links.collect()} == {(1, 5), (2, 5), (2, 6)}
    tagger = lambda: lambda docs: [["B-P" if w == "Go" else "O" for w in s] for s in docs]
    got = extract.extract_documents(shop, NOW, 1, load=tagger)
    assert {(r["value"], r["type"]) for r in got.keywords.collect()} >= {("go", "P")}
    assert extract.extract(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), tagger).collect()[0]["entities"] == []


def test_needles(spark, shop):
    docs = shop.documents
    n = spark.createDataFrame([("1",), ("rpd:2",), ("01",), ("abc",), ("a:b:c",), (None,), ("1",)], "needle string")
    got = {(r["needle"], r["id"]) for r in documents.by_needles(n, docs).collect()}
    assert got == {("1", 1), ("rpd:2", 2), ("01", None), ("abc", None), ("a:b:c", None), (None, None)}
    assert documents.one_by_needle(docs, 12, allow_null=True) is None and documents.one_by_needle(docs, "012", allow_null=True) is None
    assert documents.one_by_needle(docs, "rpd:2", ensure_root=True)["id"] == 1
    assert [r["id"] for r in documents.duplicates_of(docs, 2).collect()] == [2]
    for bad in ("abc", "a:b:c"):
        with pytest.raises(ValueError):
            documents.by_needle(docs, bad)
    with pytest.raises(documents.NotOneDocument):
        documents.one_by_needle(docs, 99)


def test_update_gate(spark):
    rows = spark.createDataFrame([("a", None), ("a", "a"), ("b", "a"), (None, None)], "text string, ner_text string")
    gate = lambda u: [r[0] for r in rows.select(documents.needs_update(u)).collect()]
    assert gate(0) == [True, False, False, True] and gate(1) == [True, False, True, True] and gate(2) == [True] * 4
    with pytest.raises(ValueError):
        documents.needs_update(3)
    assert documents.status(rows.selectExpr("1 id", "'' object_type", "'' system_id", "1 root_id", "true is_active", "now() created_at", "now() updated_at", "text", "ner_text")).where("ner_extracted").count() == 2


def test_training_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"kind":"rpd","id":7,"text":"x","entities":[],"meta":null}\n{"kind":"vac","id":"1","text":"old","entities":[[0,3,"X"]]}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"kind":"vac","id":1,"text":"new","entities":[]}\n\n{"kind":"rpd","id":8,"meta":{"id":9},"text":"y","entities":[]}\n', encoding="utf-8")
    from spanloom.sources.jsonl import read_training

    got = {r["id"]: (r["text"], r["_first"]["file_no"]) for r in read_training(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).collect()}
    assert got == {"rpd-unk-7": ("x", 0), "vac-1": ("new", 0), "rpd-9": ("y", 1)}


def test_majority_tags_and_evaluation(spark):
    tok = spark.createDataFrame([("k", "a", "B-X"), ("k", "a", "B-X"), ("k", "a", "O"), ("k", "b", "O")], "kind string, word string, label string")
    best = training.majority_tags(tok).withColumnRenamed("label", "guess")
    r = training.evaluate(tok.join(best, "word")).collect()[0]
    assert (r["precision"], r["recall"], r["n"]) == (0.666667, 1.0, 4)


def test_keywords_of_any_length_are_found(spark):
    long = "level one, two, three, four, five, six"
    words = ["go", "saroltmur v11 - 7 years", long, "four", "zi\u0307s a b c d"]
    kw = spark.createDataFrame([(i, w, "T") for i, w in enumerate(words)] + [(9, None, "T"), (10, "", "T")], "id long, value string, type string")
    texts = ["x Go y Saroltmur v11 - 7 years z", f"see {long.upper()} go", "four five", "zİs a b c d", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: [r["text"][e["start"] : e["end"]] for e in r["entities"]] for r in extract.extract_by_dictionary(df, kw).collect()}
    assert got == {0: ["Go", "Saroltmur v11 - 7 years"], 1: [long.upper(), "go"], 2: ["four"], 3: ["zİs a b c d"], 4: []}
    assert all(r["entities"] == [] for r in extract.extract_by_dictionary(df, kw.limit(0)).collect())


def test_prepared_spans_use_the_dictionary_and_lemmas(spark, tmp_path):
    from spanloom.queries import QUERIES

    text = "Знаю Elixir. Опытом работы с базами данных"
    at = text.index("Elixir"), text.index("Опытом")
    rows = [("a-1", text, [(at[0], at[0] + 6, "Technology"), (at[1], len(text), "Subject")], {})]
    schema = "id string, text string, entities array<struct<start:int,end:int,class:string>>, status map<string,string>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/datum.parquet")
    spark.createDataFrame([(1, "Elixir", "ProgLanguage"), (2, "SQL", "Technology")], "canon_id long, name string, type string").write.parquet(f"{tmp_path}/canon_term.parquet")
    got = QUERIES["T28_preprocessed_spans"](spark, str(tmp_path)).collect()
    out = QUERIES["T28_preprocessed"](spark, str(tmp_path)).collect()[0]
    assert sorted((out["text"][r["start"] : r["end"]], r["class"]) for r in got) == [("Elixir", "ProgLanguage"), ("базами данных", "Subject")]
