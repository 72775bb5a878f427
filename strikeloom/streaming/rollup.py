"""Hourly rollups from a stream, replaced by whole days so that a replay changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.operators import tiers

#: Tasks that write one day of one micro-batch.
WRITERS = 4


class HourlyRollup:
    """Target of ``foreachBatch`` for snapshot rows of one schema version.

    A micro-batch's rows are kept in partitions named by day, version and batch id. The days
    it touches are then computed from all rows kept for them, taking of every hour the
    newest version alone, and replace the days in the rollup. Both writes replace exactly
    the partitions they write, so the same batch id can come again, whole or after a failure between the two,
    and an older version can come after a newer one.
    """

    def __init__(self, kept: str, rollup: str, schema_version: int):
        self.kept, self.rollup, self.version = kept, rollup, schema_version

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({
            "day": F.to_date("ts"), "schema_version": F.lit(self.version).cast("bigint"), "batch": F.lit(batch_id).cast("bigint")})
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in batch.columns]), F.lit(WRITERS))
        _replace(rows.repartition("day", spread), self.kept, "day", "schema_version", "batch")
        # The days of one micro-batch, read from what was just kept; partition columns only.
        held = spark.read.schema(rows.schema).parquet(self.kept)
        days = [r["day"] for r in held.where((F.col("batch") == batch_id) & (F.col("schema_version") == self.version)).select("day").distinct().collect()]
        if not days:
            return
        touched = held.where(F.col("day").isin(days)).withColumn("hour", F.date_trunc("hour", "ts"))
        versions = touched.groupBy("hour").agg(F.max("schema_version").alias("_newest"))
        current = touched.join(versions, "hour").where(F.col("schema_version") == F.col("_newest")).drop("_newest", "hour", "batch")
        out = tiers.hourly(current.drop("schema_version")).drop("schema_version")
        out = out.join(versions.withColumnRenamed("_newest", "schema_version"), "hour").withColumn("day", F.to_date("hour"))
        _replace(out.repartition("day"), self.rollup, "day")


def _replace(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
