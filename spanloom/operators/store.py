"""The document, keyword and link tables: reading saved spans, and saving new ones.

Plain files have no row-level merge, so every change gives new snapshots: three DataFrames to be written
side by side and swapped in. ``as_of`` is the time of the change, given by the caller, so a repeated run gives the
same tables.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import spans
from spanloom.schemas import EXTRACTED, SPANS
from spanloom.plans.skew import lookup_join


@dataclass
class Store:
    documents: DataFrame
    keywords: DataFrame
    links: DataFrame

    def write(self, folder: str) -> Store:
        """Write all three as one snapshot below ``folder`` and read it back; readers of older snapshots are not disturbed."""
        at = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        spark = self.documents.sparkSession
        out = []
        for name, df in (("document", self.documents), ("keyword", self.keywords), ("document_keyword", self.links)):
            df.write.parquet(f"{at}/{name}")
            out.append(spark.read.schema(df.schema).parquet(f"{at}/{name}"))
        return Store(*out)


def saved_spans(links: DataFrame, keywords: DataFrame) -> DataFrame:
    """(document_id, value, type, status, start, end): one row per saved span. Links without meta are left out."""
    kw = keywords.select(F.col("id").alias("keyword_id"), "value", "type")
    met = lookup_join(links.where(F.col("meta").isNotNull()), kw, "keyword_id", "inner")
    place = F.explode(F.coalesce("meta.indices", F.array().cast("array<array<int>>"))).alias("i")
    return met.select("document_id", "value", "type", "status", place).select(
        "document_id", "value", "type", "status", F.get("i", 0).alias("start"), F.get("i", 1).alias("end")
    )


def saved_data(store: Store, rejected: bool = True) -> DataFrame:
    """(id, text, entities, status): what is saved of each document.

    A document never processed has its text and nothing else. Else the text is the one last processed; spans come
    ordered by start, then keyword. Statuses are kept for keywords without spans too. Without ``rejected``, rejected keywords
    and their spans are left out.
    """
    kw = store.keywords.select(F.col("id").alias("keyword_id"), "value", "type")
    met = lookup_join(store.links.where(F.col("meta").isNotNull()), kw, "keyword_id", "inner")
    per = met.select(
        "document_id",
        "value",
        "status",
        F.transform(
            F.coalesce("meta.indices", F.array().cast("array<array<int>>")),
            lambda i: F.struct(F.get(i, 0).alias("start"), F.get(i, 1).alias("end"), F.col("value"), F.col("type").alias("class")),
        ).alias("found"),
    )
    own = per.groupBy("document_id").agg(
        F.array_sort(F.flatten(F.collect_list("found"))).alias("found"), F.array_sort(F.collect_list(F.struct(F.col("value").alias("key"), F.col("status").alias("value")))).alias("st")
    )
    done = F.col("ner_text").isNotNull()
    docs = store.documents.select("id", "text", "ner_text").join(own.withColumnRenamed("document_id", "id"), "id", "left")
    ents = F.transform("found", lambda e: spans.span(e["start"], e["end"], e["class"]))
    out = docs.select(
        "id",
        F.coalesce("ner_text", "text").alias("text"),
        F.when(done, F.coalesce(ents, F.array().cast(SPANS))).otherwise(F.array().cast(SPANS)).alias("entities"),
        F.when(done & F.col("st").isNotNull(), spans.last_wins(F.col("st"))).otherwise(F.create_map().cast("map<string,string>")).alias("status"),
    )
    if rejected:
        return out
    return spans.filter_rejected(out)


def found_keywords(data: DataFrame) -> DataFrame:
    """(value, type): each keyword of the data once, with the class of its first span (by document, then place)."""
    each = data.select("id", "text", F.posexplode(spans.spans_or_none(F.col("entities"))).alias("pos", "e"))
    named = each.select(spans.value_of(F.col("text"), F.col("e")).alias("value"), F.col("e.class").alias("type"), F.struct("id", "pos").alias("at"))
    return named.groupBy("value").agg(F.min_by("type", "at").alias("type"))


def upsert_keywords(keywords: DataFrame, found: DataFrame, as_of: datetime, update_classes: bool) -> DataFrame:
    """The keyword table with all found keywords.

    A known one gets ``as_of`` as its time, and the found class only with ``update_classes``; new ones get ids after the largest, in
    order of value.
    """
    now = F.lit(as_of).cast("timestamp")
    known = keywords.join(
        found.select("value", F.col("type").alias("_type"), F.lit(True).alias("_hit")), "value", "left"
    ).select(
        "id",
        "value",
        (F.when(F.col("_hit"), F.col("_type")).otherwise(F.col("type")) if update_classes else F.col("type")).alias("type"),
        F.when(F.col("_hit"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    new = found.join(keywords.select("value").distinct(), "value", "left_anti")
    last = keywords.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = numbered_by(new, "value").crossJoin(F.broadcast(last))  # one row
    return known.unionByName(numbered.select((F.col("last") + F.col("_n")).alias("id"), "value", "type", now.alias("updated_at")))


def numbered_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_n``, 1, 2, ... in order of ``key``: sorted by ranges, counted per range, so no task sees all rows."""
    from spanloom.session import stage

    parts = stage(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()), "numbered")
    each = Window.partitionBy("_p").orderBy(key)
    counts = parts.groupBy("_p").count()  # one row a partition
    before = counts.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    return parts.withColumn("_k", F.row_number().over(each)).join(F.broadcast(before), "_p").withColumn("_n", F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def new_links(data: DataFrame, keywords: DataFrame) -> DataFrame:
    """(document_id, keyword_id, status, meta) of the data: one row per document and keyword, spans in their order."""
    st = spans.status_or_none(F.col("status"))
    each = data.withColumn("_st", st).select("id", "text", "_st", F.posexplode(spans.spans_or_none(F.col("entities"))).alias("pos", "e"))
    value = spans.value_of(F.col("text"), F.col("e"))
    one = each.select(
        F.col("id").alias("document_id"), value.alias("value"), F.coalesce(F.try_element_at("_st", value), F.lit(EXTRACTED)).alias("status"), F.struct("pos", "e.start", "e.end").alias("place")
    )
    grouped = one.groupBy("document_id", "value").agg(F.max("status").alias("status"), F.array_sort(F.collect_list("place")).alias("places"))
    meta = F.struct(F.transform("places", lambda p: F.array(p["start"], p["end"])).alias("indices"))
    ids = keywords.groupBy("value").agg(F.min("id").alias("keyword_id"))
    return lookup_join(grouped.select("document_id", "value", "status", meta.alias("meta")), ids, "value", "inner").select("document_id", "keyword_id", "status", "meta")


def upsert_links(links: DataFrame, new: DataFrame, saved_ids: DataFrame, as_of: datetime) -> DataFrame:
    """The link table after saving the documents ``saved_ids`` (id) with the links ``new``.

    Links of these documents that are not new are deleted. Of others the status and meta are set; the time changes only if
    either did (a null in the old row is no change), the time of creation never.
    """
    now = F.lit(as_of).cast("timestamp")
    key = ["document_id", "keyword_id"]
    touched = saved_ids.select(F.col("id").alias("document_id")).distinct().withColumn("_saved", F.lit(True))
    old = links.join(touched, "document_id", "left")
    n = new.select(*key, F.col("status").alias("_status"), F.col("meta").alias("_meta"), F.lit(True).alias("_new"))
    met = old.join(n, key, "full")
    is_new, was = F.coalesce("_new", F.lit(False)), F.col("created_at").isNotNull() | F.col("status").isNotNull() | F.col("_saved").isNotNull() | F.col("updated_at").isNotNull()
    changed = (F.col("_status") != F.col("status")) | (F.col("_meta") != F.col("meta"))
    kept = met.where(is_new | F.col("_saved").isNull())
    return kept.select(
        *key,
        F.when(is_new, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(is_new, F.col("_meta")).otherwise(F.col("meta")).alias("meta"),
        F.when(was, F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(is_new & was & ~F.coalesce(changed, F.lit(False)), F.col("updated_at")).when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def mark_processed(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents listed have their text as the text last processed."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return documents.join(hit, "id", "left").withColumn("ner_text", F.when(F.col("_hit"), F.col("text")).otherwise(F.col("ner_text"))).drop("_hit")


class TextChanged(ValueError):
    """A user's spans belong to another text than the one last processed."""


def save(store: Store, data: DataFrame, as_of: datetime, is_user: bool = False) -> Store:
    """The store after saving (id, text, entities, status) of some documents.

    With ``is_user`` the text must be the one last processed; saved spans the user left out come back as rejected,
    and keywords take the user's classes.
    """
    data = data.select("id", "text", F.col("entities"), "status")
    if is_user:
        was = saved_data(store).select("id", F.col("entities").alias("saved_entities"), F.col("status").alias("saved_status"))
        done = store.documents.select("id", F.col("ner_text").alias("_ner"))
        met = data.join(was, "id").join(done, "id")
        wrong = met.where(F.col("_ner").isNull() | (F.col("_ner") != F.col("text"))).limit(1)
        if not wrong.isEmpty():
            raise TextChanged(f"document {wrong.first()['id']} has another text now")
        data = spans.reject_missing(met).select("id", "text", "entities", "status")
    keywords = upsert_keywords(store.keywords, found_keywords(data), as_of, is_user)
    links = upsert_links(store.links, new_links(data, keywords), data, as_of)
    return Store(mark_processed(store.documents, data), keywords, links)


def reset_roots(documents: DataFrame, dupes: DataFrame, kind: str | None = None) -> DataFrame:
    """Documents (of a type) with new roots: duplicates get theirs, all others none."""
    new = dupes.where(F.col("id") != F.col("root_id")).select("id", F.col("root_id").alias("_root"))
    hit = F.lit(True) if kind is None else F.col("object_type").eqNullSafe(F.lit(kind))
    return documents.join(new, "id", "left").withColumn("root_id", F.when(hit, F.col("_root")).otherwise(F.col("root_id"))).drop("_root")
