"""The last row of one table at or before each row of another, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, take: list[str], *, width: str = "DAY") -> DataFrame:
    """``left`` with ``take`` of the row of ``right`` with the same keys and the greatest ``at`` that is not after its own
    (of several with the same, the greatest values).

    A union in order of time, in which the last right row is carried forward. Time is cut into spans of ``width``: within
    a span a window carries rows forward, between spans only each span's last right row is, so a key with most of the rows
    is spread over its spans. Rows whose key or time is null get nothing."""
    span = F.date_trunc(width, F.col(at).cast("timestamp"))
    taken = F.struct(*(F.col(c) for c in take)).alias("_taken")
    keyed = [F.col(c).isNotNull() for c in [*on, at]]
    whole = keyed[0]
    for k in keyed[1:]:
        whole = whole & k
    own = left.columns
    rows = left.where(whole).select(*on, F.col(at).alias("_at"), span.alias("_span"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"))
    news = right.where(whole).select(*on, F.col(at).alias("_at"), span.alias("_span"), F.lit(0).alias("_side"), taken)
    both = rows.unionByName(news, allowMissingColumns=True)
    w = Window.partitionBy(*on, "_span").orderBy("_at", "_side", "_taken").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("_near", F.last("_taken", ignorenulls=True).over(w)).where("_side = 1")
    ends = both.groupBy(*on, "_span").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_taken"))).alias("_end"))
    earlier = Window.partitionBy(*on).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(earlier)).select(*on, "_span", F.col("_far._taken").alias("_far"))
    found = within.join(ends, [*on, "_span"]).select("_row.*", F.coalesce("_near", "_far").alias("_taken"))
    out = found.select(*own, *(F.col(f"_taken.{c}").alias(f"last_{c}") for c in take))
    return out.unionByName(left.where(~F.coalesce(whole, F.lit(False))), allowMissingColumns=True)
