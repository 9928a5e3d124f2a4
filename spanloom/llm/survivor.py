"""Problem 4: the best representative of each group of duplicate records.

Groups come from pointer chains (``root_id``), resolved by pointer doubling: the number of rounds
is the logarithm of the longest chain. The survivor is chosen field by field: fields are unpivoted
to long rows, each filled field votes for its normalised value, votes are summed per value, and the
value with the strongest claim wins by ``max_by``; the winners are pivoted back to one record.

A vote weighs source trust times recency decay, 2 ** (-age / half_life). Votes are carried as powers of two, so none is lost
however old it is: each is measured against the strongest of its group and field before they are summed. With
``half_life_days=None`` the half-life goes to zero. There the power itself is what counts: the latest instant, and at the same
instant the rank of the source (``rank``, by default the smallest id), as no number of weaker votes adds up to a
stronger one. That is the rule problem 4 states.

Cases: a null ``id`` belongs to no group. A null ``updated_at`` is older than any other and has no
recency vote. Of several rows of an id with different roots the latest row's root holds (then the
largest root). A root that points to itself, a null root and an id without record end a chain; in
a cycle the smallest id of the cycle is the end. Exact repeats vote once. A field filled nowhere gives
no row. Empty input gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import strip_space
from spanloom.plans.skew import lookup_join
from spanloom.session import stage


def chain_ends(rows: DataFrame, id_col: str = "id", parent_col: str = "root_id", order_col: str = "updated_at") -> DataFrame:
    """(id, end) for every id that points elsewhere: the id its chain of parents leads to.

    Each round replaces a pointer by its target's pointer. ``low`` is the smallest id on the way,
    which for a pointer inside a cycle becomes the smallest id of the cycle.
    """
    state = (
        rows.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.struct(order_col, parent_col))[parent_col].alias("end"))
        .where(F.col("end").isNotNull() & (F.col("end") != F.col("id")))
        .select("id", "end", F.least("id", "end").alias("low"), F.lit(False).alias("done"))
    )
    state = stage(state, "chain")
    limit = math.ceil(math.log2(max(2, state.count()))) + 2
    for _ in range(limit):
        going = state.where(~F.col("done"))
        target = state.select(
            F.col("id").alias("end"), F.col("end").alias("next"), F.col("low").alias("next_low"), F.col("done").alias("next_done")
        )
        step = lookup_join(going, target, "end").select(
            "id",
            F.coalesce("next", "end").alias("end"),
            F.least("low", F.coalesce("next_low", "low")).alias("low"),
            F.coalesce("next_done", F.lit(True)).alias("done"),
        )
        state = stage(state.where("done").unionByName(step), "chain")
        if state.where(~F.col("done")).isEmpty():
            return state.select("id", "end")
    # What still moves runs in a cycle: its pointer lies on the cycle, whose smallest id it knows by now.
    cycle = state.where(~F.col("done")).select(F.col("id").alias("end"), F.col("low").alias("cycle_low"))
    looped = lookup_join(state.where(~F.col("done")).select("id", "end"), cycle, "end").select("id", F.col("cycle_low").alias("end"))
    return state.where("done").select("id", "end").unionByName(looped)


def with_group(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with ``group_id``: the end of the row's chain, or its own id."""
    found = rows.join(ends.select(F.col("id").alias("_id"), F.col("end").alias("_end")), F.col("id") == F.col("_id"), "left")
    return found.withColumn("group_id", F.coalesce("_end", "id")).drop("_id", "_end")


def default_filled() -> dict[str, Column]:
    """When a field counts as filled (problem 4): 20 characters after trimming, a digit in the system id."""
    long_enough = lambda c: F.length(strip_space(F.col(c))) >= 20
    return {"text": long_enough("text"), "ner_text": long_enough("ner_text"), "system_id": F.col("system_id").rlike(r"\p{Nd}")}


def field_winners(
    grouped: DataFrame,
    filled: dict[str, Column],
    trust: Column | None = None,
    half_life_days: float | None = None,
    rank: Column | None = None,
) -> DataFrame:
    """(group_id, field, from_id, updated_at): which row each field of a group's survivor comes from.

    Only hashes of values move through the shuffle, not the values. Votes of one value are summed
    with partial aggregation, so a hot group is never gathered in one task.
    """
    value = lambda c: F.xxhash64(strip_space(F.lower(F.col(c).cast("string"))))
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.when(ok, value(c)).alias("value")) for c, ok in filled.items()])
    w = F.lit(1.0) if trust is None else F.coalesce(trust.cast("double"), F.lit(0.0))
    low_id = -F.col("id") if rank is None else rank
    long = (
        grouped.where(F.col("id").isNotNull())
        .select("group_id", "id", "updated_at", low_id.alias("rank"), w.alias("trust"), F.inline(entries))
        .where(F.col("value").isNotNull())
        .distinct()
    )
    row = F.struct("updated_at", (-F.col("id")).alias("id"))
    if half_life_days is None:
        # The power of a vote is (instant, rank of the source, trust); a sum of powers in the limit is the greatest of them.
        power = F.struct("updated_at", "rank", "trust")
        votes = long.groupBy("group_id", "field", "value").agg(F.max(F.struct(power.alias("power"), row.alias("row"))).alias("vote"))
        claim, best = F.col("vote.power"), F.col("vote.row")
    else:
        day = F.unix_micros(F.col("updated_at").cast("timestamp")) / 86_400_000_000
        long = long.withColumn("power", F.when(F.col("trust") > 0, F.log2("trust") + day / half_life_days))
        # The strongest vote of each field of a group; at most one entry a field.
        top = long.groupBy("group_id", "field").agg(F.max("power").alias("top"))
        tops = top.where(F.col("top").isNotNull()).groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "top"))).alias("tops"))
        vote = F.coalesce(F.pow(F.lit(2.0), F.col("power") - F.try_element_at("tops", F.col("field"))), F.lit(0.0))
        votes = lookup_join(long, tops, "group_id").groupBy("group_id", "field", "value").agg(F.max(row).alias("row"), F.sum(vote).alias("votes"))
        claim, best = F.struct(F.round("votes", 9).alias("votes"), F.col("row.updated_at"), F.col("row.id")), F.col("row")
    won = votes.groupBy("group_id", "field").agg(F.max_by(best, claim).alias("row"))
    return won.select("group_id", "field", (-F.col("row.id")).alias("from_id"), F.col("row.updated_at").alias("updated_at"))


def survivor_rows(rows: DataFrame, half_life_days: float | None = None, trust: Column | None = None, rank: Column | None = None) -> DataFrame:
    """(group_id, n_ids, then for each field struct<from_id, updated_at> or null) of every group of two or more ids: the
    winners pivoted to one record."""
    filled = default_filled()
    grouped = with_group(rows, chain_ends(rows))
    won = field_winners(grouped, filled, trust, half_life_days, rank)
    wide = won.groupBy("group_id").pivot("field", list(filled)).agg(F.max(F.struct("from_id", "updated_at")))
    return groups_of_several(grouped).join(wide, "group_id", "left")


def sources(wide: DataFrame) -> DataFrame:
    """(group_id, field, from_id): where each field of the survivors comes from; fields filled nowhere are left out."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}.from_id").alias("from_id")) for c in default_filled()])
    return wide.select("group_id", F.inline(fields)).where(F.col("from_id").isNotNull())


def groups_of_several(grouped: DataFrame) -> DataFrame:
    return (
        grouped.where(F.col("id").isNotNull()).groupBy("group_id")
        .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count_distinct("id").alias("n_ids"))
        .where("a < b").select("group_id", "n_ids")
    )


def survivors(rows: DataFrame, half_life_days: float | None = None, trust: Column | None = None, rank: Column | None = None) -> DataFrame:
    """One record per group of two or more ids: each field's value and the id it comes from."""
    filled = default_filled()
    wide = stage(survivor_rows(rows, half_life_days, trust, rank), "winners")
    listed = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("of")) for c in filled])
    won = wide.select("group_id", F.inline(listed)).where(F.col("of").isNotNull()).select("group_id", "field", "of.*")
    # Back from (id, updated_at, field) to the value; of exact ties between values the largest is taken.
    picked = F.array(*[F.struct(F.lit(c).alias("field"), F.when(ok, F.col(c)).alias("value")) for c, ok in filled.items()])
    values = (
        rows.join(won.select(F.col("from_id").alias("id")).distinct(), "id", "left_semi")
        .select(F.col("id").alias("from_id"), F.col("updated_at").alias("at"), F.inline(picked))
        .where(F.col("value").isNotNull())
    )
    long = won.join(values, ["from_id", "field"]).where(F.col("updated_at").eqNullSafe(F.col("at")))
    made = long.groupBy("group_id").pivot("field", list(filled)).agg(F.max("value").alias("value"), F.max("from_id").alias("from_id"))
    names = {f"{c}_value": c for c in filled} | {f"{c}_from_id": f"{c}_from" for c in filled}
    return wide.select("group_id", "n_ids").join(made.withColumnsRenamed(names), "group_id", "left")
