"""Contract-day and underlying-day rows: mapping, aggregation, screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.constants import (
    MIN_AVG_VOLUME, MIN_OI_CHANGE, MIN_OI_CHANGE_PCT, MIN_RVOL, RVOL_DAYS, SURPRISE_DAYS, SURPRISE_PCTILE,
)
from strikeloom.functions.scalar import (
    contract_key, num, option_right, percentile_of_history, ratio, ratio_inf,
)


def map_rows(raw: DataFrame, session: Column, source: str = "chain_capture") -> DataFrame:
    """Vendor contract rows to typed contract-day rows; zero prices become null."""
    price = F.nullif(num("avg_price"), F.lit(0.0))
    whole = lambda c: num(c).cast("bigint")
    expiry = F.substring("expires", 1, 10).try_cast("date")
    missing = F.lit(None)
    return raw.select(
        session.alias("date"),
        contract_key("option_symbol").alias("occ"),
        F.upper("underlying_symbol").alias("ticker"),
        expiry.alias("expiration"),
        num("strike").alias("strike"),
        option_right("option_type").alias("right"),
        F.datediff(expiry, session).alias("dte"),
        (F.coalesce(price, F.lit(0.0)) * whole("volume") * 100.0).alias("total_premium"),
        whole("volume").alias("total_volume"),
        whole("open_interest").alias("open_interest"),
        whole("prev_oi").alias("prev_oi"),
        (whole("open_interest") - whole("prev_oi")).alias("oi_change"),
        whole("bid_volume").alias("bid_volume"),
        whole("ask_volume").alias("ask_volume"),
        whole("mid_volume").alias("mid_volume"),
        missing.cast("bigint").alias("sweep_volume"),
        missing.cast("double").alias("sweep_premium"),
        missing.cast("bigint").alias("multi_leg_volume"),
        missing.cast("double").alias("multi_leg_premium"),
        price.alias("vwap"),
        F.nullif(num("last_price"), F.lit(0.0)).alias("last_price"),
        missing.cast("double").alias("underlying_price"),
        F.nullif(num("iv"), F.lit(0.0)).alias("iv"),
        missing.cast("bigint").alias("trade_count"),
        F.lit(source).alias("source"),
    )


def relabel_session(rows: DataFrame, tape_time: str = "last_tape_time") -> DataFrame:
    """Stamp all rows with the true session: the day of the latest tape time.

    The maximum is one row, so the join with it is a bounded broadcast.
    """
    true_day = rows.agg(F.to_date(F.max(tape_time)).alias("_true"))
    moved = F.col("_true").isNotNull() & (F.col("date") != F.col("_true"))
    return (
        rows.join(F.broadcast(true_day))
        .withColumn("relabelled", moved)
        .withColumn("date", F.when(moved, F.col("_true")).otherwise(F.col("date")))
        .withColumn("dte", F.datediff("expiration", "date"))
        .drop("_true")
    )


def underlying_day(rows: DataFrame) -> DataFrame:
    """Call/put totals of a ticker-day; rows of unknown right are counted apart."""
    call, put = F.col("right") == "C", F.col("right") == "P"
    # Raw rows meet one hash aggregate; the distinct counts then expand cells, not rows.
    names = ("call_premium", "put_premium", "call_volume", "put_volume", "unknown_right")
    cells = rows.groupBy("date", "ticker", "strike", "expiration").agg(
        F.sum(F.when(call, F.col("total_premium")).otherwise(0.0)).alias("call_premium"),
        F.sum(F.when(put, F.col("total_premium")).otherwise(0.0)).alias("put_premium"),
        F.sum(F.when(call, F.col("total_volume")).otherwise(0)).alias("call_volume"),
        F.sum(F.when(put, F.col("total_volume")).otherwise(0)).alias("put_volume"),
        F.count_if(F.col("right").isNull()).alias("unknown_right"))
    agg = cells.groupBy("date", "ticker").agg(
        *[F.sum(c).alias(c) for c in names],
        F.countDistinct("strike").alias("unique_strikes"),
        F.countDistinct("expiration").alias("unique_expirations"),
    )
    return (
        agg.withColumn("total_premium", F.col("call_premium") + F.col("put_premium"))
        .withColumn("total_volume", F.col("call_volume") + F.col("put_volume"))
        .withColumn("net_premium", F.col("call_premium") - F.col("put_premium"))
        .withColumn("call_put_ratio", ratio("call_premium", "put_premium"))
    )


def bars_to_contract_day(bars: DataFrame) -> DataFrame:
    """Minute bars to contract days with a volume-weighted close over positive prices."""
    c, v = F.col("c"), F.col("v")
    return bars.groupBy("ticker", "occ", "expiry", "right", "date").agg(
        F.sum("v").alias("volume"),
        F.sum("n").alias("trade_count"),
        F.sum(v * c * 100.0).alias("premium"),
        F.sum(v * F.when(c > 0, c).otherwise(0.0)).alias("_pv"),
    ).withColumn(
        "close_price", F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume")).otherwise(0.0)
    ).drop("_pv")


def effective_price(close: Column, bid: Column, ask: Column, volume: Column) -> Column:
    return F.when((close <= 0) & (volume > 0), (bid + ask) / 2).otherwise(close)


def eod_to_contract_day(rows: DataFrame) -> DataFrame:
    px = effective_price(F.col("close"), F.col("bid"), F.col("ask"), F.col("volume"))
    return rows.select(
        F.lit("eod").alias("source"), "ticker", "occ", F.col("expiration").alias("expiry"),
        F.substring(F.upper("right"), 1, 1).alias("right"), F.substring("created", 1, 10).alias("date"),
        "volume", F.col("count").alias("trade_count"), (px * F.col("volume") * 100.0).alias("premium"),
        px.alias("close_price"), "bid", "ask",
    )


def unified(eod: DataFrame, minute_days: DataFrame) -> DataFrame:
    """Both archive sources as one table; fields a source lacks are null."""
    minute = minute_days.withColumn("source", F.lit("minute"))
    both = eod.unionByName(minute, allowMissingColumns=True)
    for name in ("oi", "prev_oi", "bid_volume", "ask_volume", "mid_volume"):
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast("double"))
    return both


def dedup_max_volume(rows: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """One row per contract key: the largest volume wins, then the tie columns."""
    others = [c for c in rows.columns if c not in keys]
    first = F.struct(F.col("volume").alias("_v"), *[(-F.col(t)).alias(f"_t{i}") for i, t in enumerate(ties)])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), first).alias("_r")).select(*keys, "_r.*")


def activity(days: DataFrame, min_obs: int = 5, with_oi: bool = True) -> DataFrame:
    """Relative volume, own-history percentile and open-interest flags per contract day.

    Windows run over the days of one contract, a few hundred rows at most. Every day is an observation, with a
    volume or without; rows without a contract or a day have no history and are left out.
    """
    days = days.where(F.col("occ").isNotNull() & F.col("day").isNotNull())
    own = Window.partitionBy("occ").orderBy("day")
    base = own.rowsBetween(-RVOL_DAYS, -1)
    hist = own.rowsBetween(-SURPRISE_DAYS, -1)
    out = (
        days.withColumn("base_obs", F.count(F.lit(1)).over(base))
        .withColumn("base_avg", F.coalesce(F.avg("volume").over(base), F.lit(0.0)))
        .withColumn("rvol", ratio_inf("volume", "base_avg"))
        .withColumn(
            "flag_rvol",
            (F.col("base_obs") >= min_obs) & (F.col("base_avg") >= MIN_AVG_VOLUME) & (F.col("rvol") >= MIN_RVOL),
        )
        # In structs, since a day without a premium counts among the days.
        .withColumn("_h", F.transform(F.collect_list(F.struct("premium")).over(hist), lambda h: h["premium"]))
        .withColumn("prem_pctile", percentile_of_history("premium", "_h"))
        .withColumn(
            "flag_surprise",
            F.coalesce((F.size("_h") >= min_obs) & (F.col("prem_pctile") >= SURPRISE_PCTILE), F.lit(False)),
        )
        .drop("_h")
    )
    if with_oi:
        out = oi_flags(out)
    return out


def oi_flags(days: DataFrame) -> DataFrame:
    change = F.col("oi").cast("double") - F.col("prev_oi").cast("double")
    pct = F.when(F.col("prev_oi") != 0, F.try_divide(F.abs(change), F.col("prev_oi").cast("double")) * 100.0).when(
        change != 0, F.lit(float("inf"))
    ).otherwise(0.0)
    flag = (F.abs(change) >= MIN_OI_CHANGE) | (pct >= MIN_OI_CHANGE_PCT)
    return (
        days.withColumn("oi_change", change)
        .withColumn("oi_change_pct", pct)
        .withColumn("flag_oi", F.coalesce(flag, F.lit(False)))
    )
