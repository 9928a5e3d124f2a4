"""Problem 8: texts into containers of fixed capacity.

Texts are spread by a hash of their id over blocks of about ``BLOCK`` texts; each block is packed by itself, so no task
grows with the data and each block leaves at most a few containers underfull. In a block, best-fit decreasing
gives a first packing, then a swap-based local search empties the least filled containers: it moves one item, exchanges
one for one, or two for one, where that raises the sum of squared fills. Exchanges that fill a container exactly are tried
first, over all items and pairs of items; then the exchange of one for one that fills another container most.

Two parameters bound the time of the search, not what is packed: ``block`` and ``failures``. The README gives the containers used
against the least that could do.

A text longer than the capacity is cut into pieces of the full capacity and a rest; no other text is split.

Cases: null and empty texts have size 0 and are put with other texts of their block (into a container of their own if
there are none). A null or non-positive capacity gives no row. Repeated capacity rows count once. Empty documents give no row.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import stage

BLOCK = 20_000
#: The search ends after so many least filled containers in a row that it can't lower.
FAILURES = 100


class Bins:
    """Containers of one capacity with the items in them, found by free room and by item size."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[dict[int, int]] = []  # container -> item -> size
        self.fill: list[int] = []
        self.room: dict[int, set[int]] = defaultdict(set)  # free room -> containers
        self.rooms = 0  # bit r is set when a container has free room r
        self.having: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)  # (free room, size) -> (container, item)

    def _enter(self, b: int) -> None:
        r = self.capacity - self.fill[b]
        self.room[r].add(b)
        self.rooms |= 1 << r
        if r:
            for i, s in self.items[b].items():
                self.having[r, s].add((b, i))

    def _leave(self, b: int) -> None:
        r = self.capacity - self.fill[b]
        self.room[r].discard(b)
        if not self.room[r]:
            self.rooms &= ~(1 << r)
        if r:
            for i, s in self.items[b].items():
                self.having[r, s].discard((b, i))

    def change(self, b: int, put: list[tuple[int, int]] = (), take: list[int] = ()) -> None:
        self._leave(b)
        for i in take:
            self.fill[b] -= self.items[b].pop(i)
        for i, s in put:
            self.items[b][i] = s
            self.fill[b] += s
        self._enter(b)

    def best_fit(self, size: int, but: int = -1) -> int | None:
        """The container with the least sufficient room."""
        bits = self.rooms >> size
        at = size
        while bits:
            step = (bits & -bits).bit_length() - 1
            at += step
            for b in self.room[at]:
                if b != but and self.items[b]:
                    return b
            bits >>= step + 1
            at += 1
        return None

    def new(self, item: int, size: int) -> None:
        self.items.append({item: size})
        self.fill.append(size)
        self._enter(len(self.fill) - 1)


def _lower(bins: Bins, d: int) -> bool:
    """One change that takes fill from container d to fuller ones; false when there is none."""
    mine = sorted(bins.items[d].items(), key=lambda x: -x[1])
    for i, s in mine:  # move one
        b = bins.best_fit(s, d)
        if b is not None and bins.fill[b] + s > bins.fill[d]:
            bins.change(d, take=[i])
            bins.change(b, put=[(i, s)])
            return True
    rooms = [r for r in bins.room if r and bins.room[r]]
    for i, s in mine:  # one for one, filling the other exactly
        for r in rooms:
            for b, j in bins.having.get((r, s - r), ()):
                if b != d and bins.fill[b] + r > bins.fill[d]:
                    bins.change(d, take=[i], put=[(j, s - r)])
                    bins.change(b, take=[j], put=[(i, s)])
                    return True
    # Two for one, filling the other exactly: pairs of items of each sum of sizes that occurs, one pair a sum.
    sums: dict[int, tuple[int, int, int]] = {}
    sizes = list(dict.fromkeys(s for _, s in mine))
    of = {s: [i for i, x in mine if x == s][:2] for s in sizes}
    for x, s in enumerate(sizes):
        for t in sizes[x:]:
            if t != s or len(of[s]) > 1:
                sums.setdefault(s + t, (of[s][0], of[t][t == s], s))
    for both, (i, j, s) in sums.items():
        for r in rooms:
            for b, k in bins.having.get((r, both - r), ()):
                if b != d and bins.fill[b] + r > bins.fill[d]:
                    bins.change(d, take=[i, j], put=[(k, both - r)])
                    bins.change(b, take=[k], put=[(i, s), (j, both - s)])
                    return True
    # One for one that leaves some room: the largest gain first.
    for gain in range(max(rooms, default=1) - 1, 0, -1):
        for i, s in mine:
            for r in rooms:
                if r > gain:
                    for b, k in bins.having.get((r, s - gain), ()):
                        if b != d and bins.fill[b] + gain > bins.fill[d]:
                            bins.change(d, take=[i], put=[(k, s - gain)])
                            bins.change(b, take=[k], put=[(i, s)])
                            return True
    return False


def pack(sizes: list[int], capacity: int, failures: int = FAILURES) -> list[int]:
    """The container of each item; sizes are from 1 to the capacity."""
    bins = Bins(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = bins.best_fit(sizes[i])
        if b is None:
            bins.new(i, sizes[i])
        else:
            bins.change(b, put=[(i, sizes[i])])
    least = -(-sum(sizes) // capacity)
    used = sum(map(bool, bins.items))
    stuck: set[int] = set()
    while used > least and len(stuck) < failures:
        d = min((b for b, x in enumerate(bins.items) if x and b not in stuck and bins.fill[b] < capacity), key=lambda b: bins.fill[b], default=None)
        if d is None:
            break
        while bins.items[d] and _lower(bins, d):
            pass
        if not bins.items[d]:
            used -= 1
            stuck.clear()
        else:
            stuck.add(d)
    out = [0] * len(sizes)
    number = 0
    for x in bins.items:
        if x:
            for i in x:
                out[i] = number
            number += 1
    return out


def _pack_block(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, block = int(pdf["capacity"].iloc[0]), int(keys[1])
    pdf = pdf.sort_values("doc_id", kind="stable")
    docs, tokens = pdf["doc_id"].tolist(), pdf["tokens"].tolist()
    rows, rest, zero = [], [], []
    number = 0
    for d, n in zip(docs, tokens):
        whole, left = divmod(n, capacity)
        for p in range(whole):
            rows.append((number, d, p, capacity))
            number += 1
        if left:
            rest.append((d, whole, left))
        elif not whole:
            zero.append(d)
    for (d, p, n), c in zip(rest, pack([r[2] for r in rest], capacity)):
        rows.append((number + c, d, p, n))
    # What has no size goes with the block's last container.
    last = max((r[0] for r in rows), default=0)
    rows += [(last, d, 0, 0) for d in zero]
    out = pd.DataFrame(rows, columns=["container_id", "doc_id", "piece_no", "tokens"])
    out["container_id"] += block << 32
    out.insert(0, "spec_id", int(keys[0]))
    out["piece_no"] = out["piece_no"].astype("int32")
    return out


def fill_containers(sizes: DataFrame, specs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, tokens) for rows (doc_id, tokens) and each capacity."""
    sizes = stage(sizes.where(F.col("doc_id").isNotNull()), "sizes")
    blocks = max(1, -(-sizes.count() // block))
    each = specs.where(F.col("capacity_tokens") > 0).groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity"))
    # The capacities are a handful of rows by the table's definition; every document meets each of them.
    listed = [(r["spec_id"], r["capacity"]) for r in each.orderBy("spec_id").collect()]
    met = sizes.select(
        "doc_id",
        "tokens",
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).alias("capacity")) for s, c in listed])).alias("c"),
    ).select("c.spec_id", "c.capacity", "block", "doc_id", "tokens") if listed else None
    schema = "spec_id int, container_id long, doc_id long, piece_no int, tokens long"
    if met is None:
        return sizes.sparkSession.createDataFrame([], schema)
    return met.groupBy("spec_id", "block").applyInPandas(_pack_block, schema)


def unused_room(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, n_containers, n_least, fill): containers used, the least that could do, and the share of room used."""
    cap = specs.groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity"))
    used = packed.groupBy("spec_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("tokens").alias("tokens"))
    return used.join(cap, "spec_id").select(
        "spec_id", "n_containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("n_least"), F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill")
    )
