from datetime import datetime

from spanloom.operators.store import Store
from spanloom.schemas import DOCUMENT, KEYWORD, LINK
from spanloom.streaming.changes import extract_from_stream, read_snapshot, write_snapshot

T0 = datetime(2030, 1, 1)


def test_changes_arrive_as_a_stream(spark, tmp_path):
    doc = lambda i, text, at: (i, "rpd", str(i), None, True, at, at, text, None)
    docs = spark.createDataFrame([doc(1, "SQL", T0)], DOCUMENT)
    kw = spark.createDataFrame([(1, "sql", "T", T0), (2, "go", "P", T0)], KEYWORD)
    write_snapshot(Store(docs, kw, spark.createDataFrame([], LINK)), str(tmp_path / "s"), -1)
    for n, rows in enumerate(([doc(1, "Go", datetime(2030, 2, 1)), doc(1, "old", T0)], [doc(2, "SQL, Go", T0)])):
        spark.createDataFrame(rows, DOCUMENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        extract_from_stream(stream, str(tmp_path / "s"), str(tmp_path / "c"), lambda k: datetime(2031, 1, 1 + k)).awaitTermination()
        got = read_snapshot(spark, str(tmp_path / "s"), n)
    assert {(r["document_id"], r["keyword_id"]) for r in got.links.collect()} == {(1, 2), (2, 1), (2, 2)}
    assert {r["id"]: r["ner_text"] for r in got.documents.collect()} == {1: "Go", 2: "SQL, Go"}
