"""Joins on keys of which some may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most, whatever the tables hold: the bound on a hot key's rows follows from it.
MOST_HOT = 50_000
#: A key with no more rows than this is never hot; tables with few rows aren't looked at.
LEAST_ROWS, SMALL_TABLE = 500, 10_000


def hot_bound(total: int) -> int:
    """Rows of a key above which it counts as hot.  As the keys' rows add up to ``total``, at most ``MOST_HOT`` keys are."""
    return max(LEAST_ROWS, total // MOST_HOT)


def join_named(rows: DataFrame, named: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to ``named`` on ``key``, without ``count``.

    ``named`` holds one row a key and in ``count`` at least the key's number of
    ``rows``; ``total`` is the sum of it.  Rows of hot keys stay where they are and
    get their key's row by broadcast, the others are shuffled: so no task gets
    more than ``hot_bound(total)`` rows of a key.  Null keys join nothing.
    """
    if total < SMALL_TABLE:
        return rows.join(named.drop(count), key)
    bound = F.lit(hot_bound(total))
    hot, cold = named.where(F.col(count) > bound).drop(count), named.where(F.col(count) <= bound).drop(count)
    spread = rows.join(F.broadcast(hot), key)
    dealt = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return spread.unionByName(dealt)
