"""Problem 1: frequency of every distinct term over marks and documents.

Heavy-light aggregation. Terms that hold a large share of the links (over all keywords that write them) are counted in exact
local arrays, one per partition, and only the arrays are shuffled; all other terms go through
a partial aggregation by term. The two count tables are united.

Links repeat and change, so the rows of a pair of document and keyword are first reduced to the latest one. That shuffle is on
the pair, which spreads evenly whatever term is heavy. From there on heavy rows stay where they are: their keywords get
their terms by a broadcast of the few heavy keywords, and only documents of terms with several keywords are made distinct once more.

Cases: a null ``value`` is no term; a null ``type`` counts as ''; a blank ``value`` is the term
''. A term without links counts zero marks and documents. Links repeated for a pair of document
and keyword count once, with the marks of the latest row (``updated_at``, then ``created_at``,
then the number of marks; nulls come first). Links whose keyword does not exist, or whose
document or keyword id is null, belong to no term. An empty keyword table gives no row. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import strip_space
from spanloom.plans.skew import lookup_join
from spanloom.session import stage

#: A term (or keyword) is heavy when it holds more than this share of the links, so fewer than this many are.
HEAVY_SHARE = 256


def term_of(value: Column) -> Column:
    return strip_space(F.lower(value))


def _local_counts(slots: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, marks = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        for b in batches:
            slot = b.column(0).to_numpy(zero_copy_only=False)
            docs += np.bincount(slot, minlength=slots)
            np.add.at(marks, slot, b.column(1).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(docs[at]), pa.array(marks[at])], names=["slot", "n_docs", "n_marks"])

    return count


def term_frequency(
    keyword: DataFrame,
    links: DataFrame,
    n_documents: int,
    rare_below: int = 3,
    common_above: float = 0.04,
    heavy_share: int = HEAVY_SHARE,
) -> DataFrame:
    """(term, type, n_keywords, n_marks, n_docs, mark) for every term; mark is null for useful terms."""
    kw = keyword.select(
        F.col("id").alias("keyword_id"), term_of(F.col("value")).alias("term"), F.coalesce("type", F.lit("")).alias("type")
    ).where(F.col("term").isNotNull() & F.col("keyword_id").isNotNull())
    terms = kw.groupBy("term", "type").agg(F.min("keyword_id").alias("rep"), F.count_distinct("keyword_id").alias("n_keywords"))
    # (keyword_id, t): the keyword that stands for the term, and whether the term has others. An id listed under
    # several terms links to each of them.
    to_term = kw.join(terms, ["term", "type"]).groupBy("keyword_id").agg(F.collect_set(F.struct("rep", (F.col("n_keywords") > 1).alias("several"))).alias("t"))
    to_term = stage(to_term, "terms")

    valid = links.where(F.col("document_id").isNotNull() & F.col("keyword_id").isNotNull())
    per = stage(valid.groupBy("keyword_id").agg(F.count("*").alias("k")), "links")
    total = per.agg(F.coalesce(F.sum("k"), F.lit(0))).collect()[0][0]
    # Fewer than heavy_share keywords, and as few terms, reach the driver.
    hot_ids = [r[0] for r in per.where(F.col("k") * heavy_share > total).select("keyword_id").collect()]
    by_term = per.join(to_term, "keyword_id").select("k", F.inline("t")).groupBy("rep").agg(F.sum("k").alias("k"))
    hot = sorted(r[0] for r in by_term.where(F.col("k") * heavy_share > total).select("rep").collect())

    # One row a pair of document and keyword.
    pairs = (
        valid.select(
            "document_id",
            "keyword_id",
            F.struct("updated_at", "created_at", F.coalesce(F.size("meta.indices"), F.lit(0)).alias("n")).alias("v"),
        )
        .groupBy("document_id", "keyword_id")
        .agg(F.max("v").alias("v"))
        .select("document_id", "keyword_id", F.greatest(F.col("v.n"), F.lit(0)).cast("long").alias("n"))
    )
    named = lookup_join(pairs, to_term, "keyword_id", "inner", hot=hot_ids).select("document_id", "n", F.inline("t"))
    # One row a pair of document and term.
    shared = named.where("several").groupBy("rep", "document_id").agg(F.sum("n").alias("n")).select("rep", "n")
    each = named.where("not several").select("rep", "n").unionByName(shared)

    is_hot = F.col("rep").isin(hot) if hot else F.lit(False)
    counts = each.where(~is_hot).groupBy("rep").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_marks"))
    if hot:
        slot_of = F.create_map(*[F.lit(x) for i, k in enumerate(hot) for x in (k, i)])
        heavy = (
            each.where(is_hot)
            .select(F.element_at(slot_of, F.col("rep")).alias("slot"), "n")
            .mapInArrow(_local_counts(len(hot)), "slot long, n_docs long, n_marks long")
            .groupBy("slot")
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_marks").alias("n_marks"))
            .select(F.element_at(F.array(*[F.lit(k) for k in hot]), F.col("slot").cast("int") + 1).alias("rep"), "n_docs", "n_marks")
        )
        counts = counts.unionByName(heavy)

    n = F.coalesce("n_docs", F.lit(0))
    mark = F.when(n < rare_below, "rare").when(n > common_above * n_documents, "common")
    return terms.join(counts, "rep", "left").select(
        "term",
        "type",
        "n_keywords",
        F.coalesce("n_marks", F.lit(0)).alias("n_marks"),
        n.alias("n_docs"),
        mark.alias("mark"),
    )
