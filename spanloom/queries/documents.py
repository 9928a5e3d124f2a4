"""Queries on the document table: S3 to S7, F1 to F6, J2 to J5, P1 to P4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import documents, training
from spanloom.queries.common import DOCS, docs
from spanloom.session import table

_TYPES = ("vacancy", "rpd", "iot_plan")


def documents_of_type(spark: SparkSession, d: str) -> DataFrame:
    return documents.of_type(docs(spark, d, "id", "object_type", "text"), "vacancy")


def eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.current(table(spark, d, "nav_document"), "id", "object_type", "is_active", "root_id", text=F.when(F.col("text").isNotNull(), F.lit("")))
    return documents.eligible(rows).select("id", "object_type")


def worklist(spark: SparkSession, d: str) -> DataFrame:
    """All three modes of updating, in one pass; only flags about the texts are shuffled."""
    modes = F.array(*[F.when(documents.needs_update(u), F.lit(u)) for u in (0, 1, 2)])
    rows = documents.current(
        table(spark, d, "nav_document"), "id", "is_active", "root_id", text=F.when(F.col("text").isNotNull(), F.lit("")), modes=F.array_compact(modes)
    )
    return documents.eligible(rows).select(F.explode("modes").alias("update_mode"), "id")


def needles(spark: SparkSession, d: str) -> DataFrame:
    """Needles of every form for every document, good and bad."""
    rows = docs(spark, d, "id", "object_type", "system_id")
    forms = F.array(
        F.col("id").cast("string"),
        F.concat(F.lit("0"), F.col("id").cast("string")),
        F.concat_ws(":", "object_type", F.coalesce("system_id", F.lit("none"))),
        F.concat(F.lit("x:"), F.col("id").cast("string"), F.lit(":y")),
    )
    return rows.select(F.explode(forms).alias("needle"))


def parsed_needles(spark: SparkSession, d: str) -> DataFrame:
    return needles(spark, d).select("needle", documents.parse_needle(F.col("needle")).alias("p")).select("needle", "p.*")


def needle_bulk(spark: SparkSession, d: str) -> DataFrame:
    return documents.by_needles(needles(spark, d), docs(spark, d, "id", "object_type", "system_id"))


def confirmed_documents(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "document_keyword").where("status = 'confirmed'").select(F.col("document_id").alias("id"))
    return documents.by_ids(docs(spark, d, "id", "object_type", "system_id"), ids)


def resolved_roots(spark: SparkSession, d: str) -> DataFrame:
    return documents.resolve_root(docs(spark, d, "id", "root_id", "object_type", "system_id"))


def roots(spark: SparkSession, d: str) -> DataFrame:
    return documents.with_roots(docs(spark, d, "id", "root_id"))


def root_members(spark: SparkSession, d: str) -> DataFrame:
    return documents.root_members(docs(spark, d, "id", "root_id"))


def duplicate_lists(spark: SparkSession, d: str) -> DataFrame:
    return documents.duplicate_lists(docs(spark, d, "id", "root_id", "object_type", "system_id"))


def status(spark: SparkSession, d: str) -> DataFrame:
    same = F.col("ner_text").eqNullSafe(F.col("text"))
    return documents.current(table(spark, d, "nav_document"), *documents.STATUS_FIELDS, ner_extracted=same)


def listing(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "id", "object_type", "system_id")


def last_batch_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_batch").select("id", "batch_no", "received_at", F.length("text").alias("n_chars"))
    return training.last_of_each(rows, "id", ["batch_no", "received_at"]).select("id", "batch_no", "n_chars", F.col("_first.batch_no").alias("first_batch"))


def root_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    """The smallest id of each group of direct duplicates, on every row."""
    from pyspark.sql.window import Window

    rows = docs(spark, d, "id", "root_id").select("id", F.coalesce("root_id", "id").alias("cluster"))
    return rows.withColumn("first_id", F.min("id").over(Window.partitionBy("cluster")))


QUERIES = {
    "S3_F1_documents_of_type": documents_of_type,
    "F2_eligible": eligible,
    "S5_F3_worklist": worklist,
    "F4_parsed_needles": parsed_needles,
    "J3_F6_needle_bulk": needle_bulk,
    "F5_confirmed_documents": confirmed_documents,
    "J2_resolved_roots": resolved_roots,
    "J5_roots": roots,
    "J5_root_members": root_members,
    "J4_O3_duplicate_lists": duplicate_lists,
    "P3_status": status,
    "P1_P2_P4_listing": listing,
    "A7_W5_last_batch_rows": last_batch_rows,
    "A1_W1_root_per_cluster": root_per_cluster,
}

_NEEDLES = """needles as (select unnest([id::varchar, '0' || id, concat_ws(':', object_type, coalesce(system_id, 'none')), 'x:' || id || ':y']) as needle from docs)"""
_ELIGIBLE = "is_active and root_id is null and text is not null"

ORACLE = {
    "S3_F1_documents_of_type": f"with {DOCS} select id, coalesce(text, '') as text from docs where object_type = 'vacancy'",
    "F2_eligible": f"with {DOCS} select id, object_type from docs where {_ELIGIBLE}",
    "S5_F3_worklist": f"""with {DOCS} select u as update_mode, id from docs, (select unnest([0, 1, 2])::int as u) where {_ELIGIBLE}
        and (ner_text is null or (u >= 1 and ner_text is distinct from text) or u >= 2)""",
    "F4_parsed_needles": f"""with {DOCS}, {_NEEDLES} select needle, case when regexp_matches(needle, '^[0-9]{{1,18}}$') then needle::bigint end as id,
        case when not regexp_matches(needle, '^[0-9]{{1,18}}$') and len(string_split(needle, ':')) = 2 then string_split(needle, ':')[1] end as object_type,
        case when not regexp_matches(needle, '^[0-9]{{1,18}}$') and len(string_split(needle, ':')) = 2 then string_split(needle, ':')[2] end as system_id from needles""",
    "J3_F6_needle_bulk": f"""with {DOCS}, {_NEEDLES}, pairs as (select object_type || ':' || system_id as needle, max(id) as id from docs where object_type is not null and system_id is not null group by 1)
        select n.needle, d.id, d.object_type, d.system_id from needles n left join docs a on a.id::varchar = n.needle left join pairs p on p.needle = n.needle left join docs d on d.id = coalesce(a.id, p.id)""",
    "F5_confirmed_documents": f"with {DOCS} select id, object_type, system_id from docs where id in (select document_id from document_keyword where status = 'confirmed')",
    "J2_resolved_roots": f"with {DOCS} select d.id, r.id as resolved_id, r.object_type, r.system_id from docs d left join docs r on r.id = coalesce(d.root_id, d.id)",
    "J5_roots": f"with {DOCS} select id, coalesce(nullif(root_id, 0), id) as root from docs",
    "J5_root_members": f"with {DOCS} select root_id, max(id) as id from docs where root_id is not null group by root_id",
    "J4_O3_duplicate_lists": f"with {DOCS} select root_id, id, object_type, system_id from docs where root_id in (select id from docs)",
    "P3_status": f"with {DOCS} select id, object_type, system_id, root_id, is_active, created_at, updated_at, ner_text is not distinct from text as ner_extracted from docs",
    "P1_P2_P4_listing": f"with {DOCS} select id, object_type, system_id from docs",
    "A7_W5_last_batch_rows": """select id, batch_no, n_chars, first_batch from (select id, batch_no, length(text) as n_chars, min(batch_no) over (partition by id) as first_batch,
        row_number() over (partition by id order by batch_no desc, received_at desc) as k from document_batch) where k = 1""",
    "A1_W1_root_per_cluster": f"with {DOCS} select id, coalesce(root_id, id) as cluster, min(id) over (partition by coalesce(root_id, id)) as first_id from docs",
}
