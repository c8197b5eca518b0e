"""Lookups by a key that may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is looked up by broadcast: there are fewer than HOT_SHARE such keys.
HOT_SHARE = 64
#: Keys of fewer rows are never hot.
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, share: int | None = None, least: int | None = None) -> list:
    """Keys with more than 1/share of all rows and more than `least` rows: at most `share` of them."""
    share, least = share or HOT_SHARE, HOT_ROWS if least is None else least
    n = df.count()
    if n <= least:
        return []
    return [r[0] for r in df.groupBy(key).count().where(F.col("count") > max(least, n // share)).where(F.col(key).isNotNull()).select(key).collect()]


def lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, *, how: str = "left", hot: list | None = None) -> DataFrame:
    """A join of `left` with unique `right_key` rows (`how` is left, inner, left_semi or left_anti): the hot keys of `left`
    (a counted, bounded list) are looked up by broadcast, all others by a shuffled join. Columns of the two sides must
    differ."""
    if hot is None:
        hot = hot_keys(left, key)
    on = F.col(key) == F.col(right_key)
    if not hot:
        return left.join(right, on, how)
    few = F.broadcast(right.where(F.col(right_key).isin(hot)))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(few, on, how).unionByName(left.where(~is_hot).join(right, on, how))
