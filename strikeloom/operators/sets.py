"""Universe building and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def universe(prints: DataFrame, tiers: DataFrame, days: int = 5, look_back: int = 12) -> DataFrame:
    """Tickers of the last trade days with rows, plus the listed tiers.

    Provenance is the first source that names a ticker: newest trade day, then tier.
    The list of trade days is one row per day.
    """
    seen = prints.groupBy("underlying", "day").agg(F.lit(1).alias("_one"))
    dates = seen.select("day").distinct()
    newest = F.max("day").over(Window.partitionBy())
    order = Window.partitionBy().orderBy(F.col("day").desc())
    recent = (
        dates.withColumn("_new", newest).withColumn("_r", F.row_number().over(order))
        .where((F.col("_r") <= days) & (F.col("day") >= F.date_sub("_new", look_back))).select("day")
    )
    traded = seen.join(recent, "day", "left_semi").groupBy("underlying").agg(
        F.concat(F.lit("1_traded_"), F.date_format(F.max("day"), "yyyy-MM-dd")).alias("provenance"))
    listed = tiers.groupBy("underlying").agg(F.concat(F.lit("2_tier_"), F.min("tier")).alias("provenance"))
    return traded.unionByName(listed).groupBy("underlying").agg(F.min("provenance").alias("provenance"))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], a_name: str, b_name: str) -> DataFrame:
    """Keys held by one side only, labelled by side."""
    keys = list(keys)
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, keys, "full").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(F.when(F.col("_b").isNull(), a_name).otherwise(b_name).alias("side"), *keys)
