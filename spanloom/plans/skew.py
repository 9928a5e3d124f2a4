"""Joins and lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: int = 64) -> list:
    """Values of ``key`` that hold more than 1/share of the non-null rows.

    At most ``share - 1`` values can exceed that, so the list sent to the driver is bounded
    whatever the data. Counting combines on the map side.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = df.where(F.col(key).isNotNull()).count()
    return [r[0] for r in counts.where(F.col("_n") * share > total).select(key).collect()]


def lookup_join(
    df: DataFrame, lookup: DataFrame, key: str, how: str = "left", share: int = 64, hot: list | None = None
) -> DataFrame:
    """``df`` joined to ``lookup`` (unique on ``key``) without a hot task.

    Rows of heavy keys meet the at most ``share`` lookup rows of those keys by broadcast and
    are not shuffled; all other rows are joined by the planner's choice. Rows with a null key
    match nothing and are kept by a left join. ``hot`` are the heavy keys, if they are known already.
    """
    hot = heavy_keys(df, key, share) if hot is None else hot
    if not hot:
        return df.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = lookup.where(F.col(key).isin(hot)).limit(len(hot))  # unique on key: the limit drops nothing
    rest = df.where(~is_hot).join(lookup, key, how)
    return df.where(is_hot).join(F.broadcast(few), key, how).unionByName(rest)
