"""Queries on the document table: filters, look-ups by needle, roots and duplicates, status.

A needle is an id, or ``type:system id``. Many needles are a DataFrame, so that looking them up is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.plans.skew import lookup_join

STATUS_FIELDS = ["id", "object_type", "system_id", "root_id", "is_active", "created_at", "updated_at"]


class NotOneDocument(LookupError):
    """A needle that must name one document names none or several."""


#: The order in which rows of an id are compared: the latest, then by the short columns, then by a hash of each text.
_SHORT = ["updated_at", "created_at", "system_id", "object_type", "root_id", "is_active"]
_LONG = ["text", "ner_text"]


def current(docs: DataFrame, *fields: str, **made: Column) -> DataFrame:
    """The latest row of each id, by updated_at, then created_at; rows without id are left out.

    With ``fields`` only these columns come out, and texts not among them are not even read. ``made`` are columns computed from
    a row before rows are compared, so that a flag about a text is shuffled and not the text. Rows as late as one another that
    differ are told by their other columns, so the result does not hang on the order of rows.
    """
    fields = list(fields) or ([] if made else list(docs.columns))
    texts = [c for c in _LONG if c in fields]
    rows = docs.where(F.col("id").isNotNull()).select(*dict.fromkeys(["id", *_SHORT, *fields]), *[c.alias(n) for n, c in made.items()])
    ties = [*_SHORT, *[F.xxhash64(c) for c in texts], *made]
    order = Window.partitionBy("id").orderBy(*[(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in ties])
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*fields, *made)


def of_type(docs: DataFrame, kind: str) -> DataFrame:
    """(id, text) of a type; a null text is ''."""
    return docs.where(F.col("object_type") == kind).select("id", F.coalesce("text", F.lit("")).alias("text"))


def eligible(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """Active documents with a text that are no duplicates; an unknown activity is none."""
    ok = F.col("is_active") & F.col("root_id").isNull() & F.col("text").isNotNull()
    return docs.where(ok if kind is None else ok & (F.col("object_type") == kind))


def needs_update(update: int, text: Column | None = None, done: Column | None = None) -> Column:
    """Whether a document is to be processed: never processed; from 1 on also when its text has changed; at 2 always."""
    if update not in (0, 1, 2):
        raise ValueError(f"update must be 0, 1 or 2, given: {update}")
    text = F.col("text") if text is None else text
    done = F.col("ner_text") if done is None else done
    return done.isNull() | (F.lit(update >= 1) & ~done.eqNullSafe(text)) | F.lit(update >= 2)


def worklist(docs: DataFrame, update: int = 1, kind: str | None = None) -> DataFrame:
    """Documents to extract from: one filter over documents unique by id."""
    return eligible(docs, kind).where(needs_update(update))


def parse_needle(needle: Column) -> Column:
    """struct<id, object_type, system_id>: by digits alone an id, else type and system id; all null for anything else."""
    parts = F.split(needle, ":", -1)
    number = needle.rlike(r"\A[0-9]{1,18}\z")
    pair = ~number & (F.size(parts) == 2)
    return F.struct(
        F.when(number, needle.cast("long")).alias("id"),
        F.when(pair, parts[0]).alias("object_type"),
        F.when(pair, parts[1]).alias("system_id"),
    )


def _filter_of(needle: int | str) -> Column:
    if isinstance(needle, int) or isinstance(needle, str) and needle.isascii() and needle.isdigit():
        return F.col("id") == int(needle)
    parts = needle.split(":") if isinstance(needle, str) else []
    if len(parts) != 2:
        raise ValueError(f'a needle is "<id>" or "<type>:<system id>", given: {needle!r}')
    return (F.col("object_type") == parts[0]) & (F.col("system_id") == parts[1])


def by_needle(docs: DataFrame, needle: int | str, ensure_root: bool = False) -> DataFrame:
    """The rows a needle names; with ``ensure_root`` their roots instead, one hop."""
    found = docs.where(_filter_of(needle))
    if not ensure_root:
        return found
    roots = found.where(F.col("root_id").isNotNull()).select(F.col("root_id").alias("id")).distinct()
    return found.where(F.col("root_id").isNull()).unionByName(docs.join(roots, "id", "left_semi").select(*found.columns))


def one_by_needle(docs: DataFrame, needle: int | str, ensure_root: bool = False, allow_null: bool = False):
    """The one row a needle names; an error, or None with ``allow_null``, when there is none; an error when several."""
    rows = by_needle(docs, needle, ensure_root).limit(2).collect()
    if len(rows) == 1:
        return rows[0]
    if not rows and allow_null:
        return None
    raise NotOneDocument(f"{needle!r} names {'no document' if not rows else 'several documents'}")


def by_needles(needles: DataFrame, docs: DataFrame, needle: str = "needle", fields: list[str] | None = None) -> DataFrame:
    """Each row of ``needles`` with the document it names, or nulls: by the id as text, then by ``type:system id``.

    Two left joins; needles may repeat, and one needle may hold most rows. Of several documents with the same type and system id the largest
    id is taken.
    """
    fields = fields or ["id", "object_type", "system_id"]
    cols = F.struct(*fields)
    ids = docs.select(F.col("id").cast("string").alias(needle), cols.alias("_by_id"))
    pairs = (
        docs.where(F.col("object_type").isNotNull() & F.col("system_id").isNotNull())
        .groupBy(F.concat_ws(":", "object_type", "system_id").alias(needle))
        .agg(F.max_by(cols, "id").alias("_by_pair"))
    )
    out = lookup_join(lookup_join(needles, ids, needle), pairs, needle)
    got = F.coalesce("_by_id", "_by_pair")
    return out.select(*needles.columns, *[got[f].alias(f) for f in fields])


def by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is listed."""
    return docs.join(ids.select("id").distinct(), "id", "left_semi")


def with_roots(docs: DataFrame) -> DataFrame:
    """(id, root): the root of each document, itself if it has none (a root of 0 counts as none)."""
    return docs.select("id", F.coalesce(F.nullif("root_id", F.lit(0)), "id").alias("root"))


def root_members(docs: DataFrame) -> DataFrame:
    """(root_id, id): of each root the member with the largest id."""
    return docs.where(F.col("root_id").isNotNull()).groupBy("root_id").agg(F.max("id").alias("id"))


def resolve_root(docs: DataFrame) -> DataFrame:
    """(id, resolved_id, object_type, system_id): each document's root, one hop; documents whose root has no record name none."""
    r = docs.select(F.col("id").alias("_target"), F.struct(F.col("id").alias("resolved_id"), "object_type", "system_id").alias("r"))
    hop = docs.select("id", F.coalesce("root_id", "id").alias("_target"))
    return lookup_join(hop, r, "_target").select("id", "r.resolved_id", "r.object_type", "r.system_id")


def duplicates_of(docs: DataFrame, needle: int | str) -> DataFrame:
    """The duplicates of the needle's root, in order of id, without their texts."""
    root = one_by_needle(docs, needle, ensure_root=True)["id"]
    return docs.where(F.col("root_id") == root).drop("text", "ner_text").orderBy("id")


def duplicate_lists(docs: DataFrame) -> DataFrame:
    """(root_id, id, object_type, system_id) of every duplicate whose root has a record, ordered."""
    roots = docs.select(F.col("id").alias("root_id")).withColumn("_there", F.lit(True))
    rows = docs.where(F.col("root_id").isNotNull()).select("root_id", "id", "object_type", "system_id")
    return lookup_join(rows, roots, "root_id", "inner").drop("_there").orderBy("root_id", "id")


def status(docs: DataFrame) -> DataFrame:
    """Status fields, and whether the text was extracted from as it is now (two null texts are equal)."""
    return docs.select(*STATUS_FIELDS, F.col("ner_text").eqNullSafe(F.col("text")).alias("ner_extracted"))
