"""Queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, canonical, history, lookalike, packing, sentences, subjects, survivor, term_frequency
from spanloom.session import table


#: Batches of a backlog probed at once.
WAVE = 5


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nav_document").agg(F.count_distinct("id")).collect()[0][0]
    return term_frequency.term_frequency(table(spark, d, "keyword"), table(spark, d, "document_keyword"), n)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where(F.col("mark").isNotNull()).select("term", "type", "mark")


def p2_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The index is built from the documents; then the waiting batches are probed in order of batch_no, and what is accepted is appended.

    A probe decides several batches as if they came one at a time, so a backlog is taken in waves of ``WAVE`` batches: the index is
    probed and appended to once a wave.
    """
    index = history.HistoryIndex(spark)
    index.add_documents(table(spark, d, "nav_document"))
    batches = table(spark, d, "document_batch")
    # One number a delivery; rows without a number come first.
    numbers = sorted((r[0] for r in batches.select("batch_no").distinct().collect()), key=lambda n: (n is not None, n))
    found = spark.createDataFrame([], "id long, repeats long, kept double")
    for k in range(0, len(numbers), WAVE):
        wave = numbers[k : k + WAVE]
        rows = batches.where(F.col("batch_no").isin(wave) | (F.lit(None in wave) & F.col("batch_no").isNull()))
        found = found.unionByName(index.probe(rows, keep=True))
        # Handles of finished jobs are let go, so that Spark frees their broadcasts and shuffle files.
        spark._jvm.System.gc()
    return found


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_repeats(spark, d).select(F.least("id", "repeats").alias("id_a"), F.greatest("id", "repeats").alias("id_b")).distinct()


def p2_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each row of the batches as new or as repeating a document; a row that came before under its own id is 'again'."""
    rows = table(spark, d, "document_batch").where(F.col("id").isNotNull()).select("batch_no", "id").distinct()
    first = rows.groupBy("id").agg(F.min("batch_no").alias("first"))
    told = rows.join(first, "id").join(p2_repeats(spark, d).select("id", "repeats"), "id", "left")
    verdict = F.when(F.col("batch_no") > F.col("first"), "again").when(F.col("repeats").isNotNull(), "repeat").otherwise("new")
    return told.select("batch_no", "id", verdict.alias("verdict"), F.when(verdict == "repeat", F.col("repeats")).alias("repeats"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "datum"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Read from the survivors after the pivot."""
    return survivor.sources(survivor.survivor_rows(table(spark, d, "nav_document")))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "nav_document"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "keyword"), table(spark, d, "canon_term"))


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    kw = table(spark, d, "keyword").select(F.lit("keyword").alias("tbl"), F.col("id").cast("string").alias("key"), "value")
    dt = table(spark, d, "datum").select(F.lit("datum").alias("tbl"), F.col("id").alias("key"), F.col("text").alias("value"))
    return kw.unionByName(dt)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(p6_rows(spark, d))


def p6_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(p6_rows(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trips(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(bpe.token_counts(table(spark, d, "documents")), table(spark, d, "container_spec"))


def p8_room(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused_room(p8_containers(spark, d), table(spark, d, "container_spec"))


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_label"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    # A document listed twice counts once.
    return p9_subjects(spark, d).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject and language: documents and sentences."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return p9_subjects(spark, d).join(docs, "doc_id").groupBy("subject", "lang").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_verdicts, p3_found, p4_found, p4_survivors, p5_found, p6_found, p6_form, p7_ids, p7_round_trip, p8_containers, p8_room, p9_found, p9_subjects, p9_composition)}

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _strip(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '^{_SPACE}+', ''), '{_SPACE}+" + r"\z', '')"



_P1 = (
    r"""
with kw as (select id, """
    + _strip("lower(value)")
    + r""" as term, coalesce(type, '') as type from keyword where value is not null and id is not null),
pairs as (select document_id, keyword_id, greatest(coalesce(len(meta.indices), 0), 0) as n from (
    select *, row_number() over (partition by document_id, keyword_id
        order by updated_at desc nulls last, created_at desc nulls last, coalesce(len(meta.indices), 0) desc) as k
    from document_keyword where document_id is not null and keyword_id is not null) where k = 1),
t as (select term, type, count(distinct id) as n_keywords, cast(coalesce(sum(n), 0) as bigint) as n_marks, count(distinct document_id) as n_docs
    from kw left join pairs on keyword_id = id group by term, type),
m as (select *, case when n_docs < 3 then 'rare' when n_docs > 0.04 * (select count(distinct id) from nav_document) then 'common' end as mark from t)
"""
)

_P4_WINNERS = r"""
with recursive root as (select id, max_by(root_id, updated_at) as parent from nav_document where id is not null group by id),
chain as (select id, id as node, 0 as k from root
    union all select c.id, r.parent, k + 1 from chain c join root r on r.id = c.node where r.parent is not null and r.parent <> r.id and k < 64),
ends as (select id, max_by(node, k) as group_id from chain group by id),
rows as (select e.group_id, n.* from nav_document n join ends e using (id)),
several as (select group_id, count(distinct id) as n_ids from rows group by group_id having count(distinct id) > 1),
long as (
    select group_id, id, updated_at, 'text' as field, text as value from rows where length(STRIP(text)) >= 20
    union all select group_id, id, updated_at, 'ner_text', ner_text from rows where length(STRIP(ner_text)) >= 20
    union all select group_id, id, updated_at, 'system_id', system_id from rows where regexp_matches(system_id, '\p{Nd}')),
won as (select group_id, field, id as from_id, value from (
    select *, row_number() over (partition by group_id, field order by updated_at desc nulls last, id, value desc) as k from long join several using (group_id)) where k = 1)
""".replace("STRIP(text)", _strip("text")).replace("STRIP(ner_text)", _strip("ner_text"))

ORACLE = {
    "p1_found": _P1 + "select term, type, mark from m where mark is not null",
    "p1_terms": _P1 + "select term, type, n_keywords, n_marks, n_docs, mark from m",
    "p4_found": _P4_WINNERS + "select group_id, field, from_id from won",
    "p4_survivors": _P4_WINNERS
    + """select s.group_id, s.n_ids,
        max(value) filter (field = 'text') as "text", max(from_id) filter (field = 'text') as text_from,
        max(value) filter (field = 'ner_text') as ner_text, max(from_id) filter (field = 'ner_text') as ner_text_from,
        max(value) filter (field = 'system_id') as system_id, max(from_id) filter (field = 'system_id') as system_id_from
    from several s left join won using (group_id) group by s.group_id, s.n_ids""",
}
