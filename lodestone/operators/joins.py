"""Join helpers: broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 20_000  # rows of a few short columns: a few MB


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """`df`, marked for broadcast if a count shows that it has at most `most`
    rows; otherwise as it is, so that the join shuffles both sides. The count
    stops at the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each key in a total order, numbered from 1. The rank
    filter lets the planner keep k rows per key before the shuffle."""
    from pyspark.sql.window import Window

    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
