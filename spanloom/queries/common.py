"""Shared inputs of the queries, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators import documents
from spanloom.session import table


def docs(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """The document table, one row per id (the latest); with ``fields`` these columns only."""
    return documents.current(table(spark, d, "nav_document"), *fields)


def data(spark: SparkSession, d: str) -> DataFrame:
    """Labelled texts, repeated rows once (they repeat whole, so the id tells)."""
    return table(spark, d, "datum").dropDuplicates(["id"])


_LATEST = ", ".join(f"{c} desc nulls last" for c in ("updated_at", "created_at", "system_id", "object_type", "root_id", "is_active", "text", "ner_text"))

DOCS = f"docs as (select * exclude (k) from (select *, row_number() over (partition by id order by {_LATEST}) as k from nav_document where id is not null) where k = 1)"
DATA = "data as (select * exclude (k) from (select *, row_number() over (partition by id) as k from datum) where k = 1)"

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip_sql(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '^{_SPACE}+', ''), '{_SPACE}+\\z', '')"


#: A span's keyword, for e in data.
VALUE = strip_sql('lower(substring(text, e."start" + 1, greatest(e."end" - e."start", 0)))')
#: Spans of the data, in order.
SPANS = f"spans as (select id, text, status, e, pos, {VALUE} as value from (select id, text, status, unnest(entities) as e, generate_subscripts(entities, 1) as pos from data))"
