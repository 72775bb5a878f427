"""Exposure display analytics: greeks, tiers, velocity, colours, retests, presets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.functions.scalar import ratio
from strikeloom.sources.captures import node_tier

BATCH = ("ticker", "ts")
SCALINGS = ("per_point", "per_percent")


def greek_exposure(greek: Column, oi: Column, spot: Column, scaling: str = "per_percent", form: str = "gamma", multiplier: float = 100.0) -> Column:
    """Dealer exposure of one side.

    gamma: greek * oi * 100 * spot (per point) or * spot^2 / 100 (per percent);
    vanna: greek * oi * 100 * spot in both scalings.
    """
    base = greek * oi * F.lit(multiplier)
    if form == "vanna":
        return base * spot
    if scaling == "per_point":
        return base * spot
    if scaling == "per_percent":
        return base * spot * spot * F.lit(0.01)
    raise ValueError(scaling)


def percent_of_king(nodes: DataFrame) -> DataFrame:
    top = F.max(F.abs("v")).over(Window.partitionBy(*BATCH))
    return nodes.withColumn("pct_king", F.coalesce(ratio("v", top), F.lit(0.0)))


def colour(r: Column) -> Column:
    """Colour coordinate of a signed share of the king."""
    return F.when(r >= 0, F.lit(0.41) + F.lit(0.59) * F.pow(r, F.lit(1.5))).otherwise(F.lit(0.41) - F.lit(0.41) * F.pow(F.abs(r), F.lit(0.85)))


def tiers(nodes: DataFrame, gatekeepers: int = 3) -> DataFrame:
    order = Window.partitionBy(*BATCH).orderBy(F.abs("v").desc(), "strike")
    return nodes.withColumn("rank", F.row_number().over(order)).withColumn("tier", node_tier(F.col("rank"), gatekeepers))


def velocity(cells: DataFrame, keys: Sequence[str] = ("ticker", "strike", "expiry"), value: str = "g") -> DataFrame:
    """Signed change of a cell since it was last seen, as a share of the batch's largest change."""
    own = Window.partitionBy(*keys).orderBy("ts")
    rows = cells.withColumn("delta", F.col(value) - F.lag(value).over(own)).withColumn("pct", ratio("delta", F.abs(F.lag(value).over(own))))
    top = F.max(F.abs("delta")).over(Window.partitionBy(*BATCH))
    return rows.withColumn("velocity", F.when(top > 0, F.col("delta") / top))


def change_over(nodes: DataFrame, windows_s: dict[str, int], keys: Sequence[str] = ("ticker", "strike"), value: str = "v") -> DataFrame:
    """Relative change against the last value at or before each look-back time.

    A range frame over the node's own batches ends at ts - look-back.
    """
    w = Window.partitionBy(*keys).orderBy(F.unix_timestamp("ts"))
    out = {}
    for name, back in windows_s.items():
        then = F.last(value, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -back))
        out[f"chg_{name}"] = ratio(F.col(value) - then, F.abs(then))
    return nodes.withColumns(out)


def retests(touches: DataFrame) -> DataFrame:
    """Ordinal of each touch episode of a node; ``touch`` rows in a row are one episode."""
    w = Window.partitionBy("ticker", "strike").orderBy("ts")
    start = F.col("touch") & ~F.coalesce(F.lag("touch").over(w), F.lit(False))
    rows = touches.withColumn("_s", F.when(start, 1).otherwise(0))
    ordinal = F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("retest", F.when(F.col("touch"), ordinal)).drop("_s")


def rolling_levels(nodes: DataFrame) -> DataFrame:
    """Dominant node above and below the spot per batch and the way each moved."""
    def best(cond):
        return F.max_by(F.when(cond, F.col("strike")), F.when(cond, F.struct(F.abs("v"), -F.col("strike"))))

    levels = nodes.groupBy(*BATCH).agg(best(F.col("strike") > F.col("spot")).alias("ceiling"), best(F.col("strike") < F.col("spot")).alias("floor"))
    w = Window.partitionBy("ticker").orderBy("ts")
    return levels.withColumns({
        "ceiling_move": F.signum(F.col("ceiling") - F.lag("ceiling").over(w)), "floor_move": F.signum(F.col("floor") - F.lag("floor").over(w))})


def index_agreement(directions: DataFrame, tickers: Sequence[str], minimum: int = 2) -> DataFrame:
    """How many of the named indices point the same way at each time."""
    wide = directions.where(F.col("ticker").isin(list(tickers))).groupBy("ts").pivot("ticker", list(tickers)).agg(F.max("direction"))
    votes = [F.coalesce(F.col(t), F.lit(0.0)) for t in tickers]
    up = sum((F.when(v > 0, 1).otherwise(0) for v in votes), F.lit(0))
    down = sum((F.when(v < 0, 1).otherwise(0) for v in votes), F.lit(0))
    return wide.select("ts", up.alias("n_up"), down.alias("n_down")).withColumns({
        "agreement": F.greatest("n_up", "n_down"),
        "signal": F.when((F.col("n_up") >= minimum) & (F.col("n_up") > F.col("n_down")), "up").when(
            (F.col("n_down") >= minimum) & (F.col("n_down") > F.col("n_up")), "down").otherwise("none")})


def preset(cells: DataFrame, name: str, front: int = 3) -> DataFrame:
    """Expiries of a preset: the first ``front`` ones, to Friday, or to the monthly expiry."""
    day = F.to_date("ts")
    if name == "front":
        order = Window.partitionBy(*BATCH).orderBy("expiry")
        return cells.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= front).drop("_r")
    if name == "friday":
        return cells.where(F.col("expiry") <= F.next_day(F.date_sub(day, 1), "Fri"))
    if name == "monthly":
        third = F.next_day(F.date_add(F.trunc(day, "month"), 13), "Fri")
        nxt = F.next_day(F.date_add(F.trunc(F.add_months(day, 1), "month"), 13), "Fri")
        return cells.where(F.col("expiry") <= F.when(third >= day, third).otherwise(nxt))
    raise ValueError(name)


def strike_range(cells: DataFrame, percent: float) -> DataFrame:
    return cells.where(F.abs(F.col("strike") - F.col("spot")) <= F.col("spot") * percent)


def movement(velocities: DataFrame, direction: str, shares: DataFrame, min_share: float) -> DataFrame:
    """Cells moving one way, with a mark for nodes at or above a share of the king."""
    way = F.col("delta") > 0 if direction == "increasing" else F.col("delta") < 0
    marks = shares.select(*BATCH, "strike", (F.abs("pct_king") >= min_share).alias("marked"))
    return velocities.where(way).join(marks, [*BATCH, "strike"], "left")
