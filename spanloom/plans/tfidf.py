"""Near-duplicate documents by TF-IDF cosine: an exact similarity join, clusters, roots.

Two documents are neighbours if their unit vectors are at most ``eps`` apart, that is if their cosine is at least 1 - eps**2 / 2.
With clusters of two or more members every neighbour is in a cluster, so clusters are the connected components.

The join is exact and never compares all pairs. Documents of equal term counts are one class. Each class
keeps the prefix of its terms, rarest first, without which no partner of that cosine is possible; classes that share a prefix term
are candidates, and the cosine of these is computed from all terms. Terms are told by 64-bit hashes there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.components import components
from spanloom.session import stage

EPS = 0.2
_SLACK = 1e-9
BUCKETS = 48


def terms(text: Column) -> Column:
    """Words of two or more letters, digits or underscores, lower case. A null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def similar_classes(docs: DataFrame, part: list[str] = (), eps: float = EPS) -> tuple[DataFrame, DataFrame]:
    """(members (part..., id, class, members), pairs (class_a, class_b)) of documents (part..., id, text).

    A class holds the documents of equal term counts within a part; its number is the smallest id in it (per part). Documents
    without terms form one class.
    """
    part = list(part)
    least = 1 - eps * eps / 2
    # The only pass over the texts: terms counted by document, combined on the map side.
    rows = docs.where(F.col("id").isNotNull())
    tf = stage(rows.select(*part, "id", F.explode_outer(terms(F.col("text"))).alias("w")).groupBy(*part, "id", "w").agg(F.count("*").alias("c")), "tf")
    # Equal terms, equal vector: two hashes of the set of terms and counts. A document without terms has the one row of a null term.
    digest = tf.groupBy(*part, "id").agg(F.bit_xor(F.xxhash64("w", "c")).alias("h1"), F.bit_xor(F.xxhash64("c", "w", F.lit(1))).alias("h2"), F.count("w").alias("n_terms"))
    classes = digest.groupBy(*part, "h1", "h2").agg(F.min("id").alias("class"), F.count("*").alias("members"))
    members = stage(digest.join(classes, [*part, "h1", "h2"]).select(*part, "id", "class", "members"), "members")

    n = rows.groupBy(*part).agg(F.count_distinct("id").alias("n"))
    full = tf.where(F.col("w").isNotNull())
    df = full.groupBy(*part, "w").agg(F.count("*").alias("df"))
    # Copies count in the document frequency; of each class one document goes on.
    copies = members.where("id <> class").select(*part, "id")
    raw = full.join(copies, [*part, "id"], "left_anti").join(df, [*part, "w"])
    raw = raw.join(F.broadcast(n), part) if part else raw.crossJoin(F.broadcast(n))  # one row a part
    idf = F.log((1 + F.col("n")) / (1.0 + F.col("df"))) + 1
    raw = raw.select(*part, "id", F.xxhash64("w").alias("t"), "df", (F.col("c") * idf).alias("v"))
    # All further work is on one row a class: its terms, rarest first, with the length and the norms on a few buckets of terms.
    term = F.struct("df", "t", "v")
    x = raw.groupBy(*part, "id").agg(F.array_sort(F.collect_list(term)).alias("x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*part, "id").schema.fields)
    vectors = stage(x.mapInArrow(_vectors(len(part) + 1, least), f"{kinds}, t array<bigint>, v array<double>, norms array<float>, prefix array<bigint>"), "vectors")
    # Classes that share a prefix term; a term of one class has no partner, so it makes no row.
    prefix = vectors.select(*part, "id", F.explode("prefix").alias("w"))
    met = prefix.withColumnRenamed("id", "a").join(prefix.withColumnRenamed("id", "b"), [*part, "w"]).where("a < b").select(*part, "a", "b").distinct()
    # By Cauchy-Schwarz in each bucket the sum of products of norms is no less than the cosine, so candidates it holds below the
    # threshold are no pairs. That spares nearly all exact products.
    side = lambda i, *cols: vectors.select(*part, F.col("id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in cols])
    bound = F.aggregate(F.zip_with("norms_a", "norms_b", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    met = met.join(side("a", "norms"), [*part, "a"]).join(side("b", "norms"), [*part, "b"]).where(bound >= least - 1e-4).select(*part, "a", "b")
    exact = met.join(side("a", "t", "v"), [*part, "a"]).join(side("b", "t", "v"), [*part, "b"])
    pairs = exact.select(*part, "a", "b", "t_a", "v_a", "t_b", "v_b").mapInArrow(_cosines(len(part), least), ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in part), "class_a long", "class_b long"]))
    return members, pairs


def _vectors(n_keys: int, least: float):
    """Keys, then terms (sorted) with their weights, bucket norms, and the prefix without which no partner is possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(n_keys)
            bounds, flat = np.asarray(column.offsets) - column.offsets[0].as_py(), column.flatten()
            t, v = flat.field("t").to_numpy(), flat.field("v").to_numpy()
            out: list[list] = [[], [], [], []]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                tt, vv = t[lo:hi], v[lo:hi] / np.sqrt((v[lo:hi] ** 2).sum())
                squares = vv * vv
                before = np.cumsum(squares) - squares
                order = np.argsort(tt, kind="stable")
                out[0].append(tt[order])
                out[1].append(vv[order])
                # Rounded up, so that the bound stays one.
                out[2].append(np.nextafter(np.sqrt(np.bincount(tt % BUCKETS, weights=squares, minlength=BUCKETS)).astype(np.float32), np.float32(2)))
                out[3].append(tt[before <= 1 - least * least + _SLACK])
            kinds = (pa.int64(), pa.float64(), pa.float32(), pa.int64())
            arrays = [pa.array(c, pa.list_(k)) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n_keys)], *arrays], names=[*batch.schema.names[:n_keys], "t", "v", "norms", "prefix"])

    return run


def _cosines(n_keys: int, least: float):
    """Of candidates (keys, a, b, terms and weights of both) the pairs whose cosine reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t_a, v_a, t_b, v_b = (batch.column(n_keys + 2 + i) for i in range(4))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                _, at_a, at_b = np.intersect1d(t_a[i].values.to_numpy(), t_b[i].values.to_numpy(), assume_unique=True, return_indices=True)
                keep[i] = v_a[i].values.to_numpy()[at_a] @ v_b[i].values.to_numpy()[at_b] >= least
            cols = [batch.column(i).filter(pa.array(keep)) for i in range(n_keys + 2)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n_keys], "class_a", "class_b"])

    return run


def duplicates(docs: DataFrame, part: list[str] = (), eps: float = EPS, cluster_empty: bool = True) -> DataFrame:
    """(part..., id, cluster, root_id) of documents (part..., id, text) that have a near-duplicate (within their part).

    The root is the smallest id of a cluster; clusters are numbered from 0 in order of their roots (within the part).
    Documents without any term are duplicates of each other, unless ``cluster_empty`` is off. Documents without
    neighbours do not come out. An id listed with several texts must be made unique before.
    """
    part = list(part)
    members, pairs = similar_classes(docs, part, eps)
    if not cluster_empty:
        bare = docs.where(F.size(terms(F.col("text"))) == 0).select(*part, "id")
        members = members.join(bare, [*part, "id"], "left_anti")
    # A class is named by its smallest id, which is unique across parts if ids are.
    found = components(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).withColumnsRenamed({"id": "class", "root": "_root"})
    rows = members.join(found, "class", "left").withColumn("root_id", F.coalesce("_root", "class"))
    # Alone: a class of one member that is similar to no other.
    rows = rows.where(F.col("_root").isNotNull() | (F.col("members") > 1)).select(*part, "id", "root_id")
    return numbered(rows, part)


def numbered(rows: DataFrame, part: list[str]) -> DataFrame:
    """Clusters numbered in order of their roots."""
    from spanloom.operators.store import numbered_by

    roots = rows.select(*part, "root_id").distinct()
    if part:
        # Per part: the number over all parts, less the smallest of the part.
        key = roots.withColumn("_key", F.struct(*part, "root_id"))
        n = numbered_by(key, "_key").drop("_key")
        low = n.groupBy(*part).agg(F.min("_n").alias("_low"))
        n = n.join(low, part).withColumn("_n", F.col("_n") - F.col("_low") + 1).drop("_low")
    else:
        n = numbered_by(roots, "root_id")
    return rows.join(n, [*part, "root_id"]).select(*part, "id", (F.col("_n") - 1).cast("long").alias("cluster"), "root_id")
