"""Fuzzy duplicates of texts in their order of arrival: exact repeats, and close matches of earlier long texts.

A text equal to an earlier one is linked to every earlier equal one. A new long text is linked to the texts equal to its
best match among earlier long texts if the score is high enough. The best match is the one of least edit distance among the
``TOP`` texts of most similar letter triples.

Every distinct text is handled once, at its first place. Candidates are complete. An edit changes at most ``GRAM`` of a text's triples, so two texts
within k edits share all but ``GRAM`` k of the triples of the longer one (counted with repetition). What may be within that bound is found in one
of two ways, then compared whole.

Short texts: the ``GRAM`` k + 1 rarest triples of each hold a common one; these meet in an equi-join, together with the length, which differs by
k at most. ``BITS`` bits beside each key tell which buckets of triples a text has: one for each triple of a text whose bucket the other does not
have is not shared. That is checked inside the join, as what meets by chance grows with the square of the texts and would fill the disk.

Long texts: the rarest triples of one are a sixth of all and common in others, so nearly all pairs of a length would meet. Here every pair of near length is
looked at, but by bits alone: the parities of a text's triples (the repeats of a triple told apart) by bucket, more than one bucket a character. Where two
texts differ in a parity, one has a triple that the other has not, so the number of such buckets is at most that of the triples not shared. Blocks of texts in order of length meet the
texts up to the length that the cut-off allows (``_near``).

The ``TOP`` texts are those of the most similar triples among the texts that share enough of them to be within the cut-off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.session import stage

CUTOFF = 0.95
MIN_LENGTH = 100
TOP = 50
GRAM = 3
#: Triples whose frequency orders them, the most frequent ones; all others count as rarer. The order decides how much meets, not the result.
RANKED = 65_536
BUCKETS = 64
BITS = 128
_SLACK = 1e-9


def _padded(text: Column) -> Column:
    return _dashed(F.lower(text))


def _dashed(low: Column) -> Column:
    return F.concat(F.lit("-"), F.regexp_replace(low, r"[^\p{L}\p{M}\p{N}_, ]", ""), F.lit("-"))


def grams(text: Column) -> Column:
    """Letter triples of the lower-case text without marks, with a dash at both ends."""
    p = _padded(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - GRAM + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(GRAM)))


def matches(texts: DataFrame, cutoff: float = CUTOFF, min_length: int = MIN_LENGTH) -> DataFrame:
    """(first, other, score): each distinct long text (text, first) with its best matches among earlier long ones, scored at least ``cutoff``.

    ``first`` is the place of a text's first occurrence.
    """
    long = texts.where(F.length("text") >= min_length).select("first", F.lower("text").alias("low"))
    # A text equal but for case to earlier ones matches those alone, with score 1 (under the earliest writing). Hashes tell which texts
    # may be; only these texts are shuffled. What is written here is mostly little, its size is known then, and texts that meet it stay in place.
    hashes = long.select("first", F.xxhash64("low").alias("h"))
    often = hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    alike = long.join(stage(hashes.join(often, "h").select("first"), "alike"), "first")
    same = alike.groupBy("low").agg(F.min("first").alias("earliest"), F.count("*").alias("n"))
    by_case = alike.join(same.where("n > 1"), "low").where("earliest < first").select("first", F.col("earliest").alias("other"), F.lit(1.0).alias("score"))
    by_case = stage(by_case, "by_case")
    only = long.join(by_case.select("first"), "first", "left_anti").withColumn("p", _dashed(F.col("low")))
    # The bits of short texts bound well; those of long ones would all be set.
    short = (long.agg(F.max(F.length("low"))).collect()[0][0] or 0) <= BITS
    close = stage(_short_pairs(only, cutoff) if short else _near(only.select("first", F.length("low").alias("n"), "p"), cutoff), "close")
    texts_of = lambda i, key: only.select(F.col("first").alias(key), F.col("low").alias(f"low_{i}"))
    whole = close.join(texts_of("a", "first"), "first").join(texts_of("b", "other"), "other")
    whole = whole.select("first", "other", "low_a", "low_b", _dashed(F.col("low_a")).alias("p_a"), _dashed(F.col("low_b")).alias("p_b"))
    compared = whole.mapInArrow(_cosines(cutoff), "first long, other long, low_a string, low_b string, cosine double")
    near = compared.withColumn("k", F.row_number().over(Window.partitionBy("first").orderBy(F.desc("cosine"), "other"))).where(F.col("k") <= TOP)
    # The distance is computed within the band that the cut-off leaves.
    distance = F.expr(f"levenshtein(low_a, low_b, cast(floor({1 - cutoff!r} * greatest(length(low_a), length(low_b)) + {_SLACK!r}) as int))")
    scored = near.select("first", "other", distance.alias("d"), F.greatest(F.length("low_a"), F.length("low_b")).alias("n")).where("d >= 0")
    best = scored.select("first", "other", F.round(1 - F.col("d") / F.col("n"), 9).alias("score")).withColumn("r", F.rank().over(Window.partitionBy("first").orderBy(F.desc("score"))))
    return best.where((F.col("r") == 1) & (F.col("score") >= cutoff)).select("first", "other", "score").unionByName(by_case)


def _short_pairs(only: DataFrame, cutoff: float) -> DataFrame:
    counts = only.select("p").mapInArrow(_gram_counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    ranked = [r["g"] for r in counts.orderBy(F.desc("n"), "g").limit(RANKED).collect()]
    kind = "first long, n int, size int, counts array<int>, b0 long, b1 long, prefix array<long>"
    return _meet(stage(only.select("first", F.length("low").alias("n"), "p").mapInArrow(_features(ranked, cutoff), kind), "features"), cutoff)


def _edits(cutoff: float):
    return lambda n: F.floor((1 - cutoff) * n + _SLACK)


def _meet(features: DataFrame, cutoff: float, with_bits: bool = True) -> DataFrame:
    """(first, other): pairs of near length with one of the rarest triples in common that by their bits (if these are used) may share
    enough of all, each once."""
    band = (F.floor(F.log("n") / math.log(1 / cutoff)) if cutoff < 1 else F.col("n")).cast("long")
    rare = features.select("first", "n", "size", "b0", "b1", band.alias("band"), F.explode("prefix").alias("f"))
    named = lambda d, i: d.select("key", *[F.col(c).alias(f"{c}_{i}") for c in ("first", "n", "size", "b0", "b1", "band")])
    left = named(rare.withColumn("key", F.xxhash64("f", "band")), "x")
    # Lengths within the cut-off lie in one band or in neighbouring ones.
    right = named(rare.withColumn("at", F.explode(F.array("band", F.col("band") + 1))).withColumn("key", F.xxhash64("f", "at")), "y")
    most = _edits(cutoff)(F.greatest("n_x", "n_y"))
    needed = F.greatest(F.greatest("size_x", "size_y") - GRAM * most, F.lit(1))
    lacks = lambda i, j: sum((F.bit_count(F.col(f"{b}_{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{j}")))) for b in ("b0", "b1")), F.lit(0))
    enough = (F.col("size_x") - lacks("x", "y") >= needed) & (F.col("size_y") - lacks("y", "x") >= needed)
    return (
        left.join(right, "key")
        .where((F.col("first_x") > F.col("first_y")) | ((F.col("band_x") != F.col("band_y")) & (F.col("first_x") != F.col("first_y"))))
        .where(F.abs(F.col("n_x") - F.col("n_y")) <= most)
        .where(enough if with_bits else F.lit(True))
        .select(F.greatest("first_x", "first_y").alias("first"), F.least("first_x", "first_y").alias("other"))
        .distinct()
    )


def _codes(text: str) -> np.ndarray:
    """The triples of a padded text as numbers, in order of number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.concatenate([c, np.zeros(max(0, GRAM - len(c)), np.int64)])
    return np.sort((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


def _repeats(g: np.ndarray) -> np.ndarray:
    """How often each of some ordered numbers occurred before."""
    at = np.arange(len(g))
    return at - np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], at, 0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        if texts:
            g, n = np.unique(np.concatenate([_codes(t) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], names=["g", "n"])


def _features(ranked: list[int], cutoff: float):
    """(first, n, number of triples, counts by bucket, bits, hashes of the rarest triples) of texts (first, n, padded text)."""
    known = np.array(ranked, np.int64)
    by_code = np.argsort(known, kind="stable")
    sorted_codes = known[by_code]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, counts, prefix = [], [], []
            bits = np.zeros((batch.num_rows, BITS), np.uint8)
            for n, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                g = _codes(text)
                repeat = _repeats(g)
                mixed = _mixed(g)
                # Rarest first: what is not listed, then from the end of the list.
                i = np.minimum(np.searchsorted(sorted_codes, g), len(sorted_codes) - 1)
                rank = np.where(sorted_codes[i] == g, by_code[i], len(known))
                order = np.lexsort((repeat, mixed, -rank))
                keep = GRAM * math.floor((1 - cutoff) * n / cutoff + _SLACK) + 1
                bits[len(size), (mixed >> 20) % BITS] = 1
                size.append(len(g))
                counts.append(np.bincount(mixed % BUCKETS, minlength=BUCKETS).astype(np.int32))
                prefix.append(_mixed(mixed[order[:keep]] + repeat[order[:keep]]))
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(counts, pa.list_(pa.int32())),
                    pa.array(packed[:, 0]), pa.array(packed[:, 1]), pa.array(prefix, pa.list_(pa.int64())),
                ],
                names=["first", "n", "size", "counts", "b0", "b1", "prefix"],
            )

    return run


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, triple, count) of padded texts, in order of number and triple."""
    raw = [t.ljust(GRAM, "\0").encode("utf-32-le", "surrogatepass") for t in texts]
    of = np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw])
    c = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
    inside = of[:-2] == of[2:]
    g, of = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], of[:-2][inside]
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (of[1:] != of[:-1])])
    return of[at], g[at], np.diff(np.r_[at, len(g)])


def _compared(p: list[str], q: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of padded texts: triples shared, product of the counts, triples of the one with more, product of the squared norms."""
    n = len(p)
    if n == 1:
        (x, nx), (y, ny) = (np.unique(_codes(t), return_counts=True) for t in (p[0], q[0]))
        _, u, v = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        made = np.minimum(nx[u], ny[v]).sum(), nx[u] @ ny[v], max(nx.sum(), ny.sum()), (nx @ nx) * (ny @ ny)
        return tuple(np.array([float(m)]) for m in made)
    (i, x, nx), (j, y, ny) = _counted(p), _counted(q)
    pair, g = np.concatenate([i, j]), np.concatenate([x, y])
    order = np.lexsort((g, pair))
    twice = np.flatnonzero((pair[order][1:] == pair[order][:-1]) & (g[order][1:] == g[order][:-1]))
    u, v = order[twice], order[twice + 1] - len(x)  # equal keys stay in order of side
    total = lambda k, w: np.bincount(k, w, n)
    return total(i[u], np.minimum(nx[u], ny[v])), total(i[u], nx[u] * ny[v]), np.maximum(total(i, nx), total(j, ny)), total(i, nx * nx) * total(j, ny * ny)


def _width(n: int) -> int:
    """Buckets of parities for a text of n characters: a power of two, so that more buckets fold into fewer."""
    return 1 << max(6, math.ceil(math.log2(1.4 * max(n, 1))))


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, n, number of triples, parities of the triples by bucket, repeats told apart) of texts (first, n, padded text)."""
    for batch in batches:
        size, bits = [], []
        for n, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            g = _codes(text)
            size.append(len(g))
            width = _width(n)
            buckets = (_mixed(_mixed(g) + _repeats(g)) >> 20) % width
            bits.append(np.packbits(np.bincount(buckets, minlength=width).astype(np.uint8) & 1).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(bits, pa.binary())], names=["first", "n", "size", "bits"]
        )


#: Characters of the texts of a block: a share of all between these bounds. They decide how the work is cut, not the result.
BLOCK_SHARE = 64
BLOCK_CHARS = (500_000, 32_000_000)
#: Texts of a block that are compared at once with so many others.
TILE = (256, 512)


def _near(texts: DataFrame, cutoff: float, share: int = BLOCK_SHARE, chars: tuple[int, int] = BLOCK_CHARS) -> DataFrame:
    """(first, other): pairs of texts (first, n, padded text) of near length that by their parities may share enough triples, each once.

    Blocks hold texts of neighbouring lengths; each meets itself and the longer texts within the cut-off. What is sent to
    the driver is a number for each length.
    """
    sets = stage(texts.mapInArrow(_parities, "first long, n int, size int, bits binary"), "parities")
    lengths = sorted((r["n"], r["count"]) for r in sets.groupBy("n").count().collect())
    allowed = min(max(sum(n * c for n, c in lengths) // share, chars[0]), chars[1])
    blocks, last, held = [], -1, 0  # (length, first block, blocks of a length that needs several)
    for n, c in lengths:
        parts = max(1, math.ceil(n * c / allowed))
        if last < 0 or parts > 1 or held + n * c > allowed:
            last, held = last + 1, 0
        blocks.append((n, last, parts))
        last += parts - 1
        held = allowed if parts > 1 else held + n * c
    longest = dict((b, n) for n, at, parts in blocks for b in range(at, at + parts))
    most, rows, low = _edit_count(cutoff), [], 0
    for n, at, parts in blocks:
        while longest[low] < n - most(n):
            low += 1
        rows.append((n, at, parts, list(range(low, at + parts))))
    spark = texts.sparkSession
    placed = sets.join(F.broadcast(spark.createDataFrame(rows, "n int, at int, parts int, blocks array<int>")), "n")
    placed = placed.withColumn("own", F.col("at") + F.pmod(F.xxhash64("first"), F.col("parts")).cast("int"))
    sent = placed.select(F.explode(F.filter("blocks", lambda b: b <= F.col("own"))).alias("block"), "own", "first", "n", "size", "bits")
    # A number of partitions that is asked for is not lowered for their few bytes: the work is in the comparing.
    met = sent.repartition(min(2 * last + 2, 1000), "block").groupBy("block").applyInArrow(_block_pairs(cutoff), "first long, other long")
    return met


def _edit_count(cutoff: float):
    return lambda n: math.floor((1 - cutoff) * n + _SLACK)


def _block_pairs(cutoff: float, tile: tuple[int, int] = TILE):
    """Pairs (first, other) of a block's texts with one another and with the longer ones sent to it."""
    edits = _edit_count(cutoff)

    def words(bits: list[bytes], width: int) -> np.ndarray:
        """Bits as words by text, folded to a width."""
        b = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, width // 64)
        return np.ascontiguousarray(np.bitwise_xor.reduce(b, axis=1).T)

    def run(table: pa.Table) -> pa.Table:
        first, n, size = (table.column(c).to_numpy().astype(np.int64) for c in ("first", "n", "size"))
        mine = table.column("own").to_numpy() == table.column("block").to_numpy()
        order = np.lexsort((first, n, ~mine))
        first, n, size, mine = first[order], n[order], size[order], mine[order]
        bits = table.column("bits").take(pa.array(order)).to_pylist()
        width = np.array([8 * len(b) for b in bits])
        # Runs of one width, of the block's own texts or of others; tiles of these.
        starts = np.flatnonzero(np.r_[True, (width[1:] != width[:-1]) | (mine[1:] != mine[:-1])])
        runs = list(zip(starts, np.r_[starts[1:], len(n)]))
        cut = lambda step: [(i, min(i + step, hi)) for lo, hi in runs for i in range(lo, hi, step)]
        here, there = [], []
        for lo, hi in cut(tile[0]):
            if not mine[lo]:
                break
            folded: dict[int, np.ndarray] = {}
            for at, end in cut(tile[1]):
                most = edits(max(n[hi - 1], n[end - 1]))
                if end <= lo + 1 or n[at] - n[hi - 1] > edits(n[at]):
                    continue
                w = int(min(width[lo], width[at]))
                if w not in folded:
                    folded[w] = words(bits[lo:hi], w)
                x, y = folded[w], words(bits[at:end], w)
                differ = np.zeros((hi - lo, end - at), np.uint16 if w < 1 << 16 else np.uint32)
                for p, q in zip(x, y):
                    differ += np.bitwise_count(p[:, None] ^ q[None, :])
                i, j = np.nonzero(differ <= 2 * GRAM * most)
                d = differ[i, j].astype(np.int64)
                i, j = i + lo, j + at
                k = np.floor((1 - cutoff) * np.maximum(n[i], n[j]) + _SLACK).astype(np.int64)
                needed = np.maximum(np.maximum(size[i], size[j]) - GRAM * k, 1)
                keep = (i < j) & (np.abs(n[i] - n[j]) <= k) & (d <= size[i] + size[j] - 2 * needed)
                here.append(first[i[keep]])
                there.append(first[j[keep]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (here, there))
        return pa.table({"first": np.maximum(a, b), "other": np.minimum(a, b)})

    return run


#: Characters of a text up to which many pairs at a time are faster than one by one.
SHORT = 150


def _cosines(cutoff: float, some: int = 1000, short: int = SHORT):
    """(first, other, texts, cosine of the triple counts) of pairs that share enough triples; ``some`` pairs at a time, one if texts are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, some):
                batch = whole.slice(first, some)
                a, b, p, q = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
                shared, dot, size, norms = _compared(p, q) if sum(map(len, p)) <= short * len(p) else (np.concatenate(c) for c in zip(*(_compared([x], [y]) for x, y in zip(p, q))))
                needed = size - GRAM * np.array([math.floor((1 - cutoff) * max(len(s), len(t)) + _SLACK) for s, t in zip(a, b)])
                cosine = [round(c, 9) for c in (dot / np.sqrt(norms)).tolist()]
                mask = pa.array(shared >= np.maximum(needed, 1))
                cols = [*[batch.column(k) for k in range(4)], pa.array(cosine, pa.float64())]
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in cols], names=["first", "other", "low_a", "low_b", "cosine"])

    return run


def canonical(rows: DataFrame, cutoff: float = CUTOFF, min_length: int = MIN_LENGTH, key: str = "idx", text: str = "text") -> DataFrame:
    """(key, canonical): the smallest earlier key a text is linked to, for texts linked to an earlier one; one hop, not further.

    Null texts take no part.
    """
    rows = rows.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("idx"), F.col(text).alias("text"))
    firsts = stage(rows.groupBy("text").agg(F.min("idx").alias("first"), F.max("idx").alias("last")), "firsts")
    # Repeats find their text by its digest, so that texts are shuffled once.
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    repeated = firsts.where("last > first").select(digest, "first")
    repeats = rows.select("idx", digest).join(repeated, "digest").where("idx > first").select("idx", F.col("first").alias("canonical"))
    fuzzy = matches(firsts, cutoff, min_length).groupBy(F.col("first").alias("idx")).agg(F.min("other").alias("canonical"))
    return repeats.unionByName(fuzzy).select(F.col("idx").alias(key), "canonical")


def clusters(mapping: DataFrame, key: str = "idx") -> DataFrame:
    """(canonical, members): the members in order, the canonical one last."""
    return mapping.groupBy("canonical").agg(F.concat(F.array_sort(F.collect_list(key)), F.array("canonical")).alias("members"))


def edges(rows: DataFrame, cutoff: float = CUTOFF, min_length: int = MIN_LENGTH, key: str = "idx", text: str = "text") -> DataFrame:
    """(a, b, weight), per pair of texts: the first place of the later text, that of the earlier, and the score.

    Links between equal texts are not listed pair by pair: ``canonical`` gives each repeat its first place.
    """
    rows = rows.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("idx"), F.col(text).alias("text"))
    firsts = stage(rows.groupBy("text").agg(F.min("idx").alias("first")), "firsts")
    return matches(firsts, cutoff, min_length).select(F.col("first").alias("a"), F.col("other").alias("b"), F.col("score").alias("weight"))
