"""Risk trends that follow a folder of snapshots.

Each micro-batch brings new files in any order. Of the areas that it touches, the newest snapshots are kept in a keyed
table together with the areas' trends, which are worked out again from these; other areas are neither read nor written,
but for those in the same bucket. Merging a batch again gives the same rows, and the table knows the last batch that it
holds, so a batch that is replayed after a failure changes nothing. A snapshot that comes late takes its place by name;
one older than an area's ``KEPT_SNAPSHOTS`` newest is dropped, as the trend doesn't look so far back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators import risk as R
from strataq.operators.ranking import top_per
from strataq.sources.session import materialize
from strataq.sources.snapshots import DEFAULTS, stream_snapshots
from strataq.sources.versions import VersionedTable

FIELDS = ["seq", *DEFAULTS]


class TrendFollower:
    """Trends of the snapshots below ``folder``, kept below ``state``."""

    def __init__(self, spark: SparkSession, folder: str, state: str, *, buckets: int = 16, files_per_batch: int = 1000) -> None:
        self.spark, self.folder, self.files_per_batch = spark, folder, files_per_batch
        self.areas = VersionedTable(spark, f"{state}/areas", ["area"], buckets)
        self.damaged = VersionedTable(spark, f"{state}/damaged", ["file"], 1)
        self.checkpoint = f"{state}/checkpoint"

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in one batch of snapshot rows."""
        batch = materialize(batch)  # files are read once
        bad = batch.where("area IS NULL").select("file")
        if not bad.isEmpty():
            self.damaged.merge(bad, batch=number)
        self.areas.merge(batch.where("area IS NOT NULL").select("area", *FIELDS), self._combined, batch=number)

    @staticmethod
    def _combined(old: DataFrame, new: DataFrame) -> DataFrame:
        """One row an area: its newest snapshots, oldest first, and its trend. A snapshot that comes again replaces itself."""
        known = old.select("area", F.inline("snapshots"), F.lit(0).alias("fresh")) if "snapshots" in old.columns else new.select("*", F.lit(0).alias("fresh")).where("false")
        every = known.unionByName(new.withColumn("fresh", F.lit(1)))
        one = top_per(every, ["area", "seq"], 1, F.desc("fresh"), F.desc(F.struct(*FIELDS)), name="copy")
        kept = top_per(one, ["area"], R.KEPT_SNAPSHOTS, F.desc("seq"), name="newest").select("area", *FIELDS)
        lists = kept.groupBy("area").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("snapshots"))  # at most KEPT_SNAPSHOTS
        return lists.join(R.trends(kept), "area")

    def catch_up(self) -> None:
        """Take in all files that are there and not taken in yet, and end."""
        rows = stream_snapshots(self.spark, self.folder, files_per_batch=self.files_per_batch)
        q = rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    def trends(self) -> DataFrame | None:
        found = self.areas.read()
        return None if found is None else found.drop("snapshots")
