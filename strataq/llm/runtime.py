"""Session settings and shared-folder tables that the operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.sources.session import materialize, scratch, ship

__all__ = ["bytes_of", "materialize", "scratch", "small_batches", "table"]

#: Rows of text that one Arrow batch carries to a Python worker; bounds memory when single texts are long.
ROWS_PER_BATCH = 256


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short (a batch of long texts must fit in a Python worker), and send workers this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def bytes_of(df: DataFrame, default: int = 1 << 28) -> int:
    """The optimizer's size estimate of a DataFrame; ``default`` where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 52 else default


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
