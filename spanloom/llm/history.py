"""Problem 2: each new batch against everything accepted so far.

The history is an index of tables in one folder, written once and appended to:

* ``bands`` (key, fp, one bit of each hash of the signature), partitioned by ``bucket``, a hash of the minwise band key;
* ``texts`` (fp, ids, number of words, signature, hashed words), partitioned by ``part``, a hash of the fingerprint;
* ``seen`` (id), the ids of all batch rows so far, partitioned likewise.

A probe computes the band keys of the batch, reads only the buckets these keys fall in (a filter on the partition column), joins on
the key, reads signatures and words of the candidates' parts only, verifies, and appends what it accepts. No text is read again, and
no row of the history outside of the touched buckets and parts. Unlike texts that share a band key by chance grow with the square of the
texts; the bits beside the key drop all but a few in a thousand of them inside the join, before anything is written or shuffled.

Similarity. Words are runs of letters and digits after markup is removed and look-alike
characters are brought to one form; their order does not count. Of two texts with word multisets A
and B the share kept is |A and B| / max(|A|, |B|); a text repeats another when it is ``SAME`` or
more. That lies between one word in six changed (0.833) and more than a quarter (below 0.75).

Texts of equal words form a class with one fingerprint, one row of ``texts`` and one set of keys, so
a group of copies, however large, puts one row into a bucket. A large group of near copies crowds its
buckets: there each class first meets the first of the bucket, and classes that seem new afterwards meet the others, until
nothing changes. That settles the verdicts; the classes that repeat then meet the history and all accepted classes of their buckets, so the
most similar document is named there as elsewhere. ``crowd`` changes the order of the work only, not the result.

Cases: a null text, an empty one or one of fewer than ``LEAST_WORDS`` words has no content: it
repeats nothing and is not repeated. A batch row whose id came in an earlier batch (or is
listed twice) counts once, at its first place. A row is not compared with a row of its own id. Of
several repeated documents the most similar is named, then the one with the smallest id. Texts are processed
whole. Rows with a null id are left out; a null batch number comes before all others. Empty tables give no row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.lookalike import fold
from spanloom.session import discard, new_path, stage, together

SAME = 0.79
LEAST_WORDS = 5
HASHES = 128
#: A pair at ``SAME`` shares a band of ``ROWS`` hashes with probability 0.0775, one of ``BANDS`` with 0.94.
BANDS = 34
ROWS = 6
#: Hashes (of 128, two bits of each kept) in which the signatures of candidates may differ: 2.6 standard deviations above what two
#: texts at ``SAME`` differ in.
MISMATCHES = 46
#: Of the 128 hashes one bit of each is kept beside the band keys. Bits in which candidates may differ: 3.3 standard deviations above
#: what two texts at ``SAME`` differ in (0.0007 of such pairs differ in more).
BITS = 36
#: Partitions of the tables. A bucket of the history expected should hold about a gigabyte: thousands at 100 TB.
BUCKETS = 32
PARTS = 16
#: Classes of a batch in one bucket from which the bucket is crowded.
CROWD = 200
#: Pairs of similar classes up to which one task decides them all: a few megabytes.
ONE_TASK = 500_000

_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_SUBSETS = np.stack([_rng.choice(HASHES, ROWS, replace=False) for _ in range(BANDS)])
_WEIGHTS = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

_SKETCH = ["s0", "s1", "s2", "s3"]
ENTRY = "fp long, n int, words array<int>, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Words:
    """Hashed words of texts; each distinct blank-separated piece is normalised once a task."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def _hash(self, piece: str) -> bytes:
        from xxhash import xxh64_intdigest

        return np.array([xxh64_intdigest(w) for w in _WORD.findall(fold(piece.lower()).lower().replace("́", ""))], np.uint64).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<" in text:
            text = _TAG.sub(" ", text)
        if "&" in text:
            text = html.unescape(text)
        known, out = self.known, []
        for piece in text.split():
            h = known.get(piece)
            if h is None:
                if len(known) > 1_000_000:  # the memory starts anew; results are the same
                    known.clear()
                h = known[piece] = self._hash(piece)
            out.append(h)
        return b"".join(out)


def words_of(text: str | None) -> list[str]:
    """The words that count, for tests."""
    text = html.unescape(_TAG.sub(" ", text or ""))
    return [w for p in text.split() for w in _WORD.findall(fold(p.lower()).lower().replace("́", ""))]


def _features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, bounds): per text its words, the k-th occurrence of a word told from the others."""
    n = np.array([len(r) // 8 for r in raw], np.int64)
    h = np.frombuffer(b"".join(raw), np.uint64)
    doc = np.repeat(np.arange(len(raw)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(h))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mix(h + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.concatenate([[0], np.cumsum(n)])


def _signatures(f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    low = (f >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(low * a, starts) for a in _MULTIPLIERS], axis=1)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        out[:, b] = _mix((sig[:, _SUBSETS[b]].astype(np.uint64) * _WEIGHTS[b]).sum(axis=1, dtype=np.uint64) + np.uint64(b))
    return out.view(np.int64)


def _sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each hash, as two planes of bits: four 64-bit numbers a text."""
    two = (sig * np.uint32(0x9E3779B1)) >> np.uint32(30)
    planes = [np.packbits((two >> np.uint32(k)).astype(np.uint8) & 1, axis=1) for k in (0, 1)]
    return np.concatenate(planes, axis=1).view(np.int64)


def _entries(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                raw = [words(t) for t in part.column(n_keys).to_pylist()]
                keep = [i for i, r in enumerate(raw) if len(r) >= 8 * LEAST_WORDS]
                if not keep:
                    continue
                f, bounds = _features([raw[i] for i in keep])
                fp = np.add.reduceat(_mix(f), bounds[:-1]).view(np.int64)
                first = []
                for i, x in enumerate(fp.tolist()):
                    if x not in seen:
                        seen.add(x)
                        first.append(i)
                n = np.diff(bounds)
                is_first = np.zeros(len(keep), bool)
                is_first[first] = True
                f1 = f[np.repeat(is_first, n)]
                b1 = np.concatenate([[0], np.cumsum(n[is_first])])
                word32 = (f1 >> np.uint64(16)).astype(np.uint32).view(np.int32)
                if first:
                    sig = _signatures(f1, b1[:-1])
                    keys, sketch = _band_keys(sig), _sketches(sig)
                # Later copies in this task carry only their fingerprint.
                where = np.cumsum(is_first) - 1
                some = lambda values, size: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values)
                cols = [part.column(k).take(pa.array(keep)) for k in range(n_keys)]
                cols += [
                    pa.array(fp),
                    pa.array(n, pa.int32()),
                    some(pa.array(word32), np.where(is_first, n, 0)),
                    *[pa.array(sketch[where, k] if first else np.zeros(len(keep), np.int64), mask=~is_first) for k in range(4)],
                    some(pa.array(keys.ravel() if first else np.empty(0, np.int64)), np.where(is_first, BANDS, 0)),
                ]
                names = [f"k{k}" for k in range(n_keys)] + ["fp", "n", "words", *_SKETCH, "bands"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def entries(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Index entries of texts: the key columns, the fingerprint, and for the first text of each class in a task its words, signature and band keys."""
    kinds = [f"k{i} {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    made = rows.select(*keys, text).mapInArrow(_entries(len(keys)), ", ".join([*kinds, ENTRY]))
    return made.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def _differ(a: str = "", b: str = "_other") -> Column:
    """The number of hashes in which two signatures differ."""
    x = [F.col(c + a).bitwiseXOR(F.col(c + b)) for c in _SKETCH]
    return F.bit_count(x[0].bitwiseOR(x[2])) + F.bit_count(x[1].bitwiseOR(x[3]))


def _alike() -> Column:
    """Whether the bits beside two band keys are near enough."""
    x = [F.col(c).bitwiseXOR(F.col(f"{c}_other")) for c in _SKETCH[:2]]
    return F.bit_count(x[0]) + F.bit_count(x[1]) <= BITS


def _as_other(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.col("fp").alias("other"), *[F.col(c).alias(f"{c}_other") for c in _SKETCH[:2]])


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n)).cast("int")


def crowded(keys: DataFrame, most: int = CROWD) -> DataFrame:
    """(key): buckets that more than ``most`` classes of the batch (fp, key) are in."""
    return keys.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > most).select("key")


def meet(mine: DataFrame, past: DataFrame, crowds: DataFrame | None) -> DataFrame:
    """(fp, other): classes of the batch (fp, place, key, bits) with classes of the history (other, key, bits) and with one another, once a pair.

    In a crowded bucket each class meets only the first class of the bucket, so the pairs grow with the bucket, not with its square.
    """
    calm, first = mine, None
    if crowds is not None:
        calm = mine.join(crowds, "key", "left_anti")
        bits = [f"{c}_other" for c in _SKETCH[:2]]
        old = past.join(crowds, "key", "left_semi").groupBy("key").agg(F.min(F.struct("other", *bits)).alias("old"))
        dense = mine.join(crowds, "key", "left_semi")
        new = dense.join(dense.groupBy("key").agg(F.min_by("fp", F.struct("place", "fp")).alias("fp")), ["key", "fp"], "left_semi")
        new = _as_other(new).select("key", F.struct("other", *bits).alias("new"))
        first = mine.join(new.join(old, "key", "left").select("key", F.coalesce("old", "new").alias("o")).select("key", "o.*"), "key")
        first = first.where((F.col("fp") != F.col("other")) & _alike()).select("fp", "other")
    calm = calm.drop("place")
    inner = calm.join(_as_other(calm), "key").where((F.col("fp") < F.col("other")) & _alike()).select("fp", "other")
    out = calm.join(past, "key").where((F.col("fp") != F.col("other")) & _alike()).select("fp", "other").unionByName(inner)
    return (out if first is None else out.unionByName(first)).distinct()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, accepted) from (fp, earlier, settled): a class is accepted unless an earlier one is; one that is ``settled`` is not, and
    one without earlier ones is."""
    before: dict[int, list[int]] = {}
    for batch in batches:
        for fp, earlier, settled in zip(*(batch.column(i).to_pylist() for i in range(3))):
            before.setdefault(fp, []).extend(() if settled else (earlier,))
    accepted: dict[int, bool] = {}
    for top in before:
        todo = [top]
        while todo:
            x = todo[-1]
            missing = [y for y in before.get(x, ()) if y not in accepted] if x not in accepted else []
            if not missing:
                accepted[x] = not any(accepted[y] for y in before.get(x, ()))
                todo.pop()
            todo += missing
    yield pa.RecordBatch.from_arrays([pa.array(list(before), pa.int64()), pa.array([accepted[x] for x in before], pa.bool_())], names=["fp", "accepted"])


def resolve(leaders: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(fp, accepted) for classes decided in order: a class is accepted unless an accepted earlier one is similar.

    ``leaders`` is (fp, place, known): ``known`` marks classes the history has; ``edges`` is (fp, earlier). At most ``one_task`` edges, which
    are counted, are decided by one task. Beyond, each round decides every class whose earlier neighbours are decided, so
    rounds follow the longest chain of similar texts, not the number of batches. Only the similar classes take part.
    """
    known = leaders.where("known").select("fp")
    settled = known.select(F.col("fp").alias("earlier"), F.lit(True).alias("settled"))
    undecided = stage(edges.join(known, "fp", "left_anti").join(settled, "earlier", "left").select("fp", "earlier", F.coalesce("settled", F.lit(False)).alias("settled")), "undecided")
    n = undecided.count()
    if n <= one_task:
        made = leaders.select("fp", "known")
        if n:
            told = undecided.coalesce(1).mapInArrow(_decide, "fp long, accepted boolean")
            made = made.join(told, "fp", "left")
        else:
            discard(undecided)
            made = made.withColumn("accepted", F.lit(True))
        return made.select("fp", (~F.col("known") & F.coalesce("accepted", F.lit(True))).alias("accepted"))
    undecided = undecided.drop("settled")
    accepted = leaders.where(~F.col("known")).select("fp").join(undecided.select("fp").distinct(), "fp", "left_anti")
    decided = stage(known.select("fp", F.lit(False).alias("accepted")).unionByName(accepted.select("fp", F.lit(True).alias("accepted"))), "decided")
    while not undecided.isEmpty():
        look = (
            undecided.join(decided.select(F.col("fp").alias("earlier"), "accepted"), "earlier", "left")
            .groupBy("fp")
            .agg(F.max(F.coalesce("accepted", F.lit(False))).alias("repeats"), F.count_if(F.col("accepted").isNull()).alias("open"))
        )
        now = stage(look.where("repeats or open = 0").select("fp", (~F.col("repeats")).alias("accepted")), "now")
        decided = stage(decided.unionByName(now), "decided", replaces=decided)
        undecided = stage(undecided.join(now.select("fp"), "fp", "left_anti"), "undecided", replaces=undecided)
        discard(now)
    return decided


class HistoryIndex:
    """The tables of everything accepted, in the folder ``path``; each append adds files and reads none.

    An index opened again must be given the ``buckets`` and ``parts`` it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, crowd: int = CROWD, buckets: int = BUCKETS, parts: int = PARTS) -> None:
        self.spark, self.path, self.crowd, self.buckets, self.parts = spark, path or new_path(spark, "history"), crowd, buckets, parts
        self.kinds = {
            "bands": "key long, fp long, s0 long, s1 long, bucket int",
            "texts": "fp long, low long, high long, n int, words array<int>, s0 long, s1 long, s2 long, s3 long, part int",
            "seen": "id long, part int",
        }

    def _write(self, name: str, rows: DataFrame, by: str, of: str, n: int) -> None:
        rows = rows.withColumn(by, _bucket(F.col(of), n)).repartition(min(n, 4 * self.spark.sparkContext.defaultParallelism), by)
        rows.write.mode("append").partitionBy(by).parquet(f"{self.path}/{name}")

    def read(self, name: str, at: list[int] | None = None) -> DataFrame:
        """A table; with ``at`` these partitions of it only. A table without files is empty."""
        kind, by = self.kinds[name], "bucket" if name == "bands" else "part"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/{name}")
        return rows if at is None else rows.where(F.col(by).isin(at))

    def append(self, found: DataFrame) -> None:
        """Add classes (fp, low, high, n, words, signature, bands), each class once."""
        together(
            lambda: self._write("texts", found.select("fp", "low", "high", "n", "words", *_SKETCH), "part", "fp", self.parts),
            lambda: self._write("bands", found.select("fp", *_SKETCH[:2], F.explode("bands").alias("key")), "bucket", "key", self.buckets),
        )

    def add_documents(self, docs: DataFrame) -> None:
        """Accept documents (id, text) without probing."""
        e = stage(entries(docs.where(F.col("id").isNotNull()).select("id", "text"), ["id"]), "entries")
        ids = e.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        self.append(e.where(F.col("s0").isNotNull()).drop("id").dropDuplicates(["fp"]).join(ids, "fp"))
        discard(e)

    def probe(self, batch: DataFrame, keep: bool = False) -> DataFrame:
        """(id, repeats, kept) for each row of ``batch`` (batch_no, id, text) that repeats an accepted document.

        ``batch`` may hold any number of batches; they are decided in order of batch_no, then id, with the result
        that probing and appending them one at a time gives. ``keep`` appends the accepted rows, and the ids of all.
        """
        rows = batch.where(F.col("id").isNotNull()).select(F.coalesce(F.col("batch_no").cast("long"), F.lit(-1)).alias("batch_no"), F.col("id").cast("long").alias("id"), "text")
        new = stage(entries(rows, ["batch_no", "id"]), "batch")
        # Where the batch's keys, classes and ids fall: at most as many numbers as the tables have partitions.
        mark = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("at"))
        part = lambda c: _bucket(F.col(c), self.parts)
        own = new.select(F.explode(F.array(mark("texts", part("fp")), mark("seen", part("id")))).alias("m"))
        marks = own.unionByName(new.select(F.explode("bands").alias("key")).select(mark("bands", _bucket(F.col("key"), self.buckets)).alias("m"))).distinct().collect()
        at = {name: sorted(r["m"]["at"] for r in marks if r["m"]["kind"] == name) for name in self.kinds}

        # The first place of each id; entries carry batch_no to choose it after the texts are hashed.
        first = rows.groupBy("id").agg(F.min("batch_no").alias("batch_no")).join(self.read("seen", at["seen"]).select("id"), "id", "left_anti")
        place = new.select("batch_no", "id", "fp").distinct().join(first, ["batch_no", "id"], "left_semi")
        known = self.read("texts", at["texts"]).select("fp", "low", "high").join(new.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        leaders = place.groupBy("fp").agg(F.min(F.struct("batch_no", "id")).alias("place"), F.min("id").alias("least"), F.max("id").alias("most"))
        leaders = stage(leaders.join(known, "fp", "left").withColumn("known", F.col("low").isNotNull()), "leaders")
        # A class of the history needs no partner, unless a row of it would be compared with its own id.
        asks = ~F.col("known") | ((F.col("low") == F.col("high")) & F.col("low").between(F.col("least"), F.col("most")))
        active = stage(
            new.where(F.col("s0").isNotNull()).drop("batch_no", "id").join(leaders.where(asks).select("fp", "place", "known"), "fp").dropDuplicates(["fp"]), "active"
        )
        mine = active.select("fp", "place", *_SKETCH[:2], F.explode("bands").alias("key"))
        past = _as_other(self.read("bands", at["bands"]))
        # No bucket holds more classes than there are.
        crowds = stage(crowded(mine, self.crowd), "crowds") if active.count() > self.crowd else None
        if crowds is not None and crowds.isEmpty():
            crowds = None
        near = self._verify(meet(mine, past, crowds), active)
        later = leaders.where(~F.col("known")).select(F.col("fp").alias("other"), F.col("place").alias("place_other"))

        def links_of(near: DataFrame) -> tuple[DataFrame, DataFrame]:
            """Pairs with the history, and pairs with earlier classes of the batch."""
            ahead = near.where("low is not null").select("fp", "other", "kept", "low", "high")
            pairs = near.where("low is null").select("fp", "other", "kept")
            both = pairs.unionByName(pairs.select(F.col("other").alias("fp"), F.col("fp").alias("other"), "kept"))
            return ahead, both.join(leaders, "fp").join(later, "other").where("place_other < place").select("fp", "other", "kept").distinct()

        seen = None
        while True:
            # Similar classes of the history decide at once; between classes of the batch the earlier one counts.
            ahead, inner = links_of(near)
            settled = leaders.join(ahead.select("fp").distinct().withColumn("near", F.lit(True)), "fp", "left")
            settled = settled.select("fp", (F.col("known") | F.coalesce("near", F.lit(False))).alias("known"))
            decided = resolve(settled, inner.select("fp", F.col("other").alias("earlier")))
            accepted = stage(decided.where("accepted").select("fp"), "accepted")
            if crowds is None:
                break
            # What was told new in a crowded bucket has met only the first of it. It now meets the rest; that settles
            # every class that is decided as new, and a group of near copies has few of those.
            dense = mine.drop("place").join(crowds, "key", "left_semi")
            todo = dense.select("fp").distinct().join(accepted, "fp", "left_semi")
            todo = stage(todo if seen is None else todo.join(seen, "fp", "left_anti"), "todo")
            if todo.isEmpty():
                break
            seen = todo if seen is None else stage(seen.unionByName(todo), "seen")
            theirs = past.join(crowds, "key", "left_semi").unionByName(_as_other(dense))
            more = dense.join(todo, "fp", "left_semi").join(theirs, "key").where((F.col("fp") != F.col("other")) & _alike()).select("fp", "other").distinct()
            near = stage(near.unionByName(self._verify(more, active)).distinct(), "similar", replaces=near)

        if crowds is not None:
            # The classes that repeat have met only the first of a crowded bucket: now all they could repeat. An accepted class is in
            # ``seen``, so no verdict changes; only the partner named does.
            rest = dense if seen is None else dense.join(seen, "fp", "left_anti")
            could = past.join(crowds, "key", "left_semi").unionByName(_as_other(dense.join(accepted, "fp", "left_semi")))
            more = rest.join(could, "key").where((F.col("fp") != F.col("other")) & _alike()).select("fp", "other").distinct()
            near = stage(near.unionByName(self._verify(more, active)).distinct(), "similar", replaces=near)
            ahead, inner = links_of(near)

        # What each class repeats: its own text in the history or in the batch, a similar one in the history, a similar one accepted from the batch.
        at_first = leaders.select("fp", F.col("place.id").alias("leader"))
        links = (
            leaders.where("known").select("fp", F.lit(1.0).alias("kept"), "low", "high")
            .unionByName(ahead.select("fp", "kept", "low", "high"))
            .unionByName(
                inner.join(accepted.withColumnRenamed("fp", "other"), "other")
                .join(at_first.withColumnRenamed("fp", "other"), "other")
                .select("fp", "kept", F.col("leader").alias("low"), F.col("leader").alias("high"))
            )
            .unionByName(at_first.join(accepted, "fp").select("fp", F.lit(1.0).alias("kept"), F.col("leader").alias("low"), F.col("leader").alias("high")))
        )
        found = (
            place.select("id", "fp").join(links, "fp")
            .select("id", "kept", F.when(F.col("low") != F.col("id"), F.col("low")).when(F.col("high") != F.col("id"), F.col("high")).alias("to"))
            .where(F.col("to").isNotNull())
            .groupBy("id")
            .agg(F.max(F.struct("kept", (-F.col("to")).alias("to"))).alias("best"))
            .select("id", (-F.col("best.to")).alias("repeats"), F.col("best.kept").alias("kept"))
        )
        # The leader of an accepted class repeats nothing.
        leads = at_first.join(accepted, "fp")
        found = found.join(leads.select(F.col("leader").alias("id")), "id", "left_anti")
        if keep:
            # What is appended does not hang on what is found; the tables read above are fixed lists of files.
            fresh = active.join(leads.select("fp", F.col("leader").alias("low"), F.col("leader").alias("high")), "fp")
            found, *_ = together(lambda: stage(found, "found"), lambda: self.append(fresh), lambda: self._write("seen", rows.select("id").distinct(), "part", "id", self.parts))
        else:
            found = stage(found, "found")
        discard(new, leaders, active, near)
        return found

    def _verify(self, met: DataFrame, active: DataFrame) -> DataFrame:
        """(fp, other, kept, low, high): the pairs that are similar, by signature first, then on all words; ``low`` and ``high`` are the
        ids of a class of the history and null for one of the batch."""
        met = stage(met, "met")
        # Candidates of the history lie in these parts only.
        parts = sorted(r[0] for r in met.select(_bucket(F.col("other"), self.parts)).distinct().collect())
        cols = ["fp", "n", "words", *_SKETCH]
        nothing = F.lit(None).cast("long")
        old = self.read("texts", parts).select(*cols, "low", "high")
        both = old.unionByName(active.where(~F.col("known")).select(*cols, nothing.alias("low"), nothing.alias("high")))
        mine = active.select(*cols)
        other = lambda d, *more: d.select(*[F.col(c).alias("other" if c == "fp" else f"{c}_other") for c in d.columns if c not in more], *more)
        near = (
            met.join(mine.select("fp", *_SKETCH), "fp")
            .join(other(both.select("fp", *_SKETCH)), "other")
            .where(_differ() <= MISMATCHES)
            .select("fp", "other")
        )
        kept = F.size(F.array_intersect("words", "words_other")) / F.greatest("n", "n_other")
        out = (
            near.join(mine.select("fp", "n", "words"), "fp")
            .join(other(both.select("fp", "n", "words", "low", "high"), "low", "high"), "other")
            .select("fp", "other", kept.alias("kept"), "low", "high")
            .where(F.col("kept") >= SAME)
        )
        out = stage(out, "verified")
        discard(met)
        return out
