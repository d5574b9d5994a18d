"""Top-k with total orders, shares and windows of newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, half-even; null where there is no whole."""
    return F.bround(F.try_divide(F.lit(100.0) * part, whole), digits)


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in ``order``, numbered from 1 as ``place``; only these come to one task."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each key (Spark limits groups before the shuffle)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row."""
    return df.crossJoin(F.broadcast(total))  # one row
