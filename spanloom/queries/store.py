"""Queries on the keyword store, on sources and sinks: J1, J6, J9, A4 to A9, M1 to M6, G7, S1, S2, S4, S6, S10, U6 to U8."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import fix_keyword
from spanloom.operators import extract, spans, store, training
from spanloom.queries.common import DATA, DOCS, SPANS, data, docs, strip_sql
from spanloom.session import new_path, table
from spanloom.sources import jsonl

AS_OF = datetime(2032, 1, 1)


def _links(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair of document and keyword: the latest, by updated_at, then created_at, then status."""
    rows = table(spark, d, "document_keyword").groupBy("document_id", "keyword_id")
    last = rows.agg(F.max(F.struct("updated_at", "created_at", "status", F.to_json("meta").alias("m"), "meta")).alias("r"))
    return last.select("document_id", "keyword_id", "r.status", "r.meta", "r.created_at", "r.updated_at")


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    """The keyword table as it should be: values in stored form, each once (the smallest id)."""
    kw = table(spark, d, "keyword").withColumn("value", fix_keyword(F.col("value")))
    return kw.groupBy("value").agg(F.min(F.struct("id", "type", "updated_at")).alias("k")).select("k.id", "value", "k.type", "k.updated_at")


def _store(spark: SparkSession, d: str) -> store.Store:
    return store.Store(docs(spark, d), _keywords(spark, d), _links(spark, d))


def saved_spans(spark, d):
    return store.saved_spans(_links(spark, d), table(spark, d, "keyword"))


def saved_data(spark, d):
    rows = store.saved_data(_store(spark, d), rejected=False)
    return rows.select("id", F.length("text").alias("n_chars"), F.size("entities").alias("n_spans"), F.size(F.map_keys("status")).alias("n_status"))


def found_keywords(spark, d):
    return store.found_keywords(data(spark, d))


def keyword_upsert(spark, d):
    return store.upsert_keywords(_keywords(spark, d), store.found_keywords(data(spark, d)), AS_OF, True)


def keyword_values(spark, d):
    """Spans of the data by keyword, with the id of the keyword they stand for."""
    kw = _keywords(spark, d).select("value", F.col("id").alias("keyword_id"))
    seen = data(spark, d).select("id", "text", F.explode("entities").alias("e"))
    named = seen.select("id", spans.value_of(F.col("text"), F.col("e")).alias("value"))
    return named.groupBy("value").agg(F.count("*").alias("n_spans"), F.count_distinct("id").alias("n_texts")).join(kw, "value", "left")


def status_of_values(spark, d):
    """A5: the status of each keyword of a text, the last one said."""
    return data(spark, d).select("id", F.explode(spans.status_or_none(F.col("status"))).alias("value", "status"))


def _confirmed(spark, d):
    """New links: the extracted ones, confirmed."""
    return _links(spark, d).where("status = 'extracted'").select("document_id", "keyword_id", F.lit("confirmed").alias("status"), "meta")


def _vacancies(spark, d):
    return docs(spark, d, "id", "object_type").where("object_type = 'vacancy'").select("id")


def link_upsert(spark, d):
    return store.upsert_links(_links(spark, d), _confirmed(spark, d), _vacancies(spark, d), AS_OF).select(
        "document_id", "keyword_id", "status", F.size("meta.indices").alias("n_marks"), "created_at", "updated_at"
    )


def stale_links(spark, d):
    mine = _links(spark, d).join(_vacancies(spark, d).withColumnRenamed("id", "document_id"), "document_id", "left_semi")
    return mine.join(_confirmed(spark, d).select("document_id", "keyword_id"), ["document_id", "keyword_id"], "left_anti").select("document_id", "keyword_id")


def marked_processed(spark, d):
    rows = store.mark_processed(docs(spark, d, "id", "text", "ner_text"), _vacancies(spark, d))
    return rows.select("id", F.col("ner_text").eqNullSafe(F.col("text")).alias("same"), F.length("ner_text").alias("n_chars"))


def extraction_links(spark, d):
    """Links after extracting from all documents that need it."""
    s = extract.extract_documents(_store(spark, d), AS_OF, 1)
    return s.links.select("document_id", "keyword_id", "status", F.size("meta.indices").alias("n_marks"))


def extraction_keywords(spark, d):
    return extract.extract_documents(_store(spark, d), AS_OF, 2, "vacancy").keywords.select("id", "value", "type", "updated_at")


def jsonl_round_trip(spark, d):
    """The data written as lines of JSON and read again."""
    path = new_path(spark, "jsonl")
    rows = data(spark, d).where("text is not null").select("id", F.substring_index("id", "-", 1).alias("kind"), "text", "entities", "status")
    jsonl.write_jsonl(rows, path)
    back = jsonl.read_jsonl(spark, path)
    return back.select("id", "kind", "text", F.inline_outer("entities")).select("id", "kind", "text", "start", "end", "class")


def training_files(spark, d):
    """Two files of records, the second with the rpd records again; later records override."""
    path = new_path(spark, "training")
    rows = data(spark, d).where("text is not null").select(
        F.substring_index("id", "-", -1).alias("id"), F.substring_index("id", "-", 1).alias("kind"), "text", "entities", F.create_map().cast("map<string,string>").alias("status"),
        F.struct(F.when(F.size("entities") > 0, F.substring_index("id", "-", -1)).alias("id")).alias("meta"),
    )
    jsonl.write_jsonl(rows.drop("status"), f"{path}/a")
    jsonl.write_jsonl(rows.where("kind = 'rpd'").withColumn("text", F.concat(F.lit("# "), "text")).drop("status"), f"{path}/b")
    got = jsonl.read_training(spark, [f"{path}/a", f"{path}/b"])
    return training.of_kinds(got, ["rpd", "vac"]).select("id", "kind", "text", "file_no")


def dictionary(spark, d):
    path = new_path(spark, "words")
    table(spark, d, "canon_term").where("type = 'ProgLanguage'").select(F.concat(F.lit(" "), F.lower("name"), F.lit("  "))).write.text(path)
    return jsonl.read_words(spark, path)


def health(spark, d):
    full = {n: not table(spark, d, n).isEmpty() for n in ("nav_document", "keyword", "document_keyword", "datum")}
    return jsonl.health_counts(jsonl.health(spark, full))


QUERIES = {
    "J1_F13_C18_saved_spans": saved_spans,
    "G7_saved_data": saved_data,
    "A8_found_keywords": found_keywords,
    "M1_S8_keyword_upsert": keyword_upsert,
    "A9_J9_keyword_values": keyword_values,
    "A5_status_of_values": status_of_values,
    "M4_C16_C15_S8_link_upsert": link_upsert,
    "M2_J6_X2_stale_links": stale_links,
    "M3_marked_processed": marked_processed,
    "U8_M6_A4_extraction_links": extraction_links,
    "U6_M1_extraction_keywords": extraction_keywords,
    "S1_S2_jsonl_round_trip": jsonl_round_trip,
    "S4_F9_C17_training_files": training_files,
    "S6_dictionary": dictionary,
    "S10_A12_health": health,
}

_LINKS = """links as (select * exclude (k) from (select *, row_number() over (partition by document_id, keyword_id
    order by updated_at desc nulls last, created_at desc nulls last, status desc nulls last, meta::varchar desc nulls last) as k from document_keyword) where k = 1)"""
_KEYWORDS = f"kw as (select id, value, type, updated_at from (select *, row_number() over (partition by value order by id) as k from (select id, {strip_sql('lower(value)')} as value, type, updated_at from keyword)) where k = 1)"
_FOUND = """found as (select value, arg_min(e."class", (id, pos)) as type from spans where text is not null group by value)"""
_NEW = "fresh as (select document_id, keyword_id, meta from links where status = 'extracted'), mine as (select id from docs where object_type = 'vacancy')"

ORACLE = {
    "J1_F13_C18_saved_spans": f"""with {_LINKS} select document_id, value, type, status, i[1] as "start", i[2] as "end"
        from (select l.document_id, k.value, k.type, l.status, unnest(l.meta.indices) as i from links l join keyword k on k.id = l.keyword_id where l.meta is not null)""",
    "A8_found_keywords": f"with {DATA}, {SPANS}, {_FOUND} select value, type from found",
    "M1_S8_keyword_upsert": f"""with {DATA}, {SPANS}, {_FOUND}, {_KEYWORDS}
        select k.id, k.value, case when f.value is not null then f.type else k.type end as type, case when f.value is not null then timestamp '2032-01-01' else k.updated_at end as updated_at
        from kw k left join found f using (value)
        union all select (select max(id) from kw) + row_number() over (order by value), value, type, timestamp '2032-01-01' from found where value not in (select value from kw)""",
    "A9_J9_keyword_values": f"""with {DATA}, {SPANS}, {_KEYWORDS} select s.value, count(*) as n_spans, count(distinct s.id) as n_texts, any_value(k.id) as keyword_id
        from spans s left join kw k using (value) where text is not null group by s.value""",
    "A5_status_of_values": f"with {DATA} select id, {strip_sql('lower(s.key)')} as value, s.value as status from (select id, unnest(map_entries(status)) as s from data)",
    "M4_C16_C15_S8_link_upsert": f"""with {DOCS}, {_LINKS}, {_NEW}
        select l.document_id, l.keyword_id, case when f.document_id is not null then 'confirmed' else l.status end as status, cast(len(l.meta.indices) as int) as n_marks, l.created_at,
            case when f.document_id is not null then timestamp '2032-01-01' else l.updated_at end as updated_at
        from links l left join fresh f using (document_id, keyword_id) where f.document_id is not null or l.document_id not in (select id from mine)""",
    "M2_J6_X2_stale_links": f"with {DOCS}, {_LINKS}, {_NEW} select document_id, keyword_id from links where document_id in (select id from mine) and (document_id, keyword_id) not in (select document_id, keyword_id from fresh)",
    "M3_marked_processed": f"""with {DOCS} select id, n is not distinct from text as same, cast(length(n) as int) as n_chars from (select *, case when object_type = 'vacancy' then text else ner_text end as n from docs)""",
    "S1_S2_jsonl_round_trip": f"""with {DATA} select d.id, string_split(d.id, '-')[1] as kind, d.text, e."start" as "start", e."end" as "end", e."class" as "class"
        from data d left join (select id, unnest(entities) as e from data) using (id) where d.text is not null""",
    "S4_F9_C17_training_files": f"""with {DATA}, r as (select string_split(id, '-')[2] as n, string_split(id, '-')[1] as kind, text, coalesce(len(entities), 0) > 0 as m from data where text is not null)
        select kind || '-' || case when kind = 'rpd' and not m then 'unk-' || n else n end as id, kind, case when kind = 'rpd' then '# ' || text else text end as text, case when kind = 'rpd' then 1 else 0 end as file_no
        from r where kind in ('rpd', 'vac')""",
    "S6_dictionary": "select distinct lower(name) as word from canon_term where type = 'ProgLanguage'",
    "S10_A12_health": "select 4::bigint as ok, 0::bigint as failed, 4::bigint as total",
}
