"""Flow analytics over prints and contract days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.functions.ordered import running_sum
from strikeloom.functions.scalar import ratio
from strikeloom.operators.asof import last_before

_UPTO = (Window.unboundedPreceding, 0)


def sweeps(prints: DataFrame, gap_s: float = 1.0) -> DataFrame:
    """Prints of one contract closer than ``gap_s`` to the next form one sweep (gaps chain).

    Prints inside one gap-wide slot always belong together, so they are summed
    first; the ordered pass sees one row per slot, whatever the number of prints.
    """
    slot = F.floor(F.unix_micros("ts") / F.lit(int(gap_s * 1e6)))
    slots = prints.groupBy("occ", slot.alias("_slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("premium").alias("premium"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    w = Window.partitionBy("occ").orderBy("_slot")
    far = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(w)) > int(gap_s * 1e6)
    marked = slots.withColumn("_new", F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0))
    marked = marked.withColumn("_id", F.sum("_new").over(w.rowsBetween(*_UPTO)))
    return marked.groupBy("occ", "_id").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("premium").alias("premium"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")).drop("_id")


def _slot_of_day(ts: str, width_s: int) -> Column:
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.floor(second / F.lit(width_s)).cast("int")


def _by_right(c: Column, right: str) -> Column:
    return F.sum(F.when(F.col("right") == right, c).otherwise(0))


def relative_volume_bars(prints: DataFrame, width_s: int = 3600, days_back: int = 20) -> DataFrame:
    """Call and put volume and premium per time slot with the same slot's mean over prior days."""
    bars = prints.withColumn("slot", _slot_of_day("ts", width_s)).groupBy("ticker", "day", "slot").agg(
        _by_right(F.col("size"), "C").alias("call_volume"), _by_right(F.col("size"), "P").alias("put_volume"),
        _by_right(F.col("premium"), "C").alias("call_premium"), _by_right(F.col("premium"), "P").alias("put_premium"))
    prior = Window.partitionBy("ticker", "slot").orderBy("day").rowsBetween(-days_back, -1)
    total = F.col("call_volume") + F.col("put_volume")
    bars = bars.withColumns({
        "avg_volume": F.avg(total).over(prior), "avg_call_volume": F.avg("call_volume").over(prior), "avg_put_volume": F.avg("put_volume").over(prior),
        "avg_premium": F.avg(F.col("call_premium") + F.col("put_premium")).over(prior), "days": F.count(F.lit(1)).over(prior)})
    return bars.withColumns({
        "rvol": ratio(total, "avg_volume"), "call_rvol": ratio("call_volume", "avg_call_volume"), "put_rvol": ratio("put_volume", "avg_put_volume")})


def day_rvol(bars: DataFrame, days_back: int = 20) -> DataFrame:
    day = bars.groupBy("ticker", "day").agg(F.sum(F.col("call_volume") + F.col("put_volume")).alias("volume"))
    prior = Window.partitionBy("ticker").orderBy("day").rowsBetween(-days_back, -1)
    return day.withColumn("rvol", ratio("volume", F.avg("volume").over(prior)))


def latest_sessions(rows: DataFrame, count: int) -> DataFrame:
    """(day, back): the last ``count`` days that hold a row, ``back`` 0 for the latest."""
    order = Window.orderBy(F.col("day").desc())  # one row per day
    return rows.select("day").distinct().withColumn("back", F.row_number().over(order) - 1).where(F.col("back") < count)


def time_of_day_baseline(prints: DataFrame, width_s: int = 3600, sessions: int = 20) -> DataFrame:
    """Mean and sample deviation per slot over the sessions before the latest, and the latest session's z-score.

    A session without a trade in a slot counts with zero, so sums over the traded
    slots are divided by the number of sessions.
    """
    bars = prints.withColumn("slot", _slot_of_day("ts", width_s)).groupBy("ticker", "day", "slot").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("premium").alias("premium"))
    calendar = latest_sessions(bars, sessions + 1)
    held = calendar.agg((F.count(F.lit(1)) - 1).alias("n_days"))
    bars = bars.join(calendar, "day")
    past = F.col("back") > 0

    def over(x):
        return F.coalesce(F.sum(F.when(past, x)), F.lit(0))

    sums = bars.groupBy("ticker", "slot").agg(
        *[over(F.col(c)).alias(f"_{c}") for c in ("trades", "premium")], *[over(F.col(c) * F.col(c)).alias(f"_{c}2") for c in ("trades", "premium")],
        *[F.coalesce(F.sum(F.when(~past, F.col(c))), F.lit(0)).alias(c) for c in ("trades", "premium")])
    out = sums.join(F.broadcast(held))
    for c in ("trades", "premium"):
        mean = F.col(f"_{c}") / F.col("n_days")
        spread = (F.col(f"_{c}2") - F.col("n_days") * mean * mean) / (F.col("n_days") - 1)
        out = out.withColumns({f"{c}_avg": mean, f"{c}_std": F.when(F.col("n_days") > 1, F.sqrt(F.greatest(spread, F.lit(0.0))))})
    return out.withColumns({
        "trades_z": ratio(F.col("trades") - F.col("trades_avg"), "trades_std"), "premium_z": ratio(F.col("premium") - F.col("premium_avg"), "premium_std")})


def moneyness_band(right: Column, strike: Column, spot: Column) -> Column:
    out = F.when(right == "C", (strike - spot) / spot).otherwise((spot - strike) / spot)
    return F.when(out >= 0.10, "otm_10plus").when(out >= 0.05, "otm_5_10").when(out >= 0.03, "otm_3_5").otherwise("atm_itm")


def volume_oi_bands(days: DataFrame, spot: Column, min_oi: int = 100) -> DataFrame:
    band = moneyness_band(F.col("right"), F.col("strike"), spot)
    return days.where(F.col("oi") >= min_oi).groupBy("day", "right", band.alias("band")).agg(
        F.sum("volume").alias("volume"), F.sum("oi").alias("oi"), F.count(F.lit(1)).alias("contracts")).withColumn("vol_oi", ratio("volume", "oi"))


def market_overview(prints: DataFrame, days_back: int = 20) -> DataFrame:
    day = prints.groupBy("day").agg(
        _by_right(F.col("premium"), "C").alias("call_premium"), _by_right(F.col("premium"), "P").alias("put_premium"),
        _by_right(F.col("size"), "C").alias("call_volume"), _by_right(F.col("size"), "P").alias("put_volume"), F.countDistinct("underlying").alias("active"))
    total = F.col("call_premium") + F.col("put_premium")
    prior = Window.partitionBy().orderBy("day").rowsBetween(-days_back, -1)  # one row per day
    return day.withColumns({
        "net_premium": F.col("call_premium") - F.col("put_premium"), "ratio": ratio("call_premium", "put_premium"), "vs_base": ratio(total, F.avg(total).over(prior))})


def premium_so_far(prints: DataFrame, width_s: int = 3600, sessions: int = 20) -> DataFrame:
    """Premium of all prints of a day up to each slot's end, against the mean of the prior sessions up to the same slot.

    Slots without a print carry the sum of the slots before them.
    """
    slots = -(-86_400 // width_s)
    held = prints.groupBy("day", _slot_of_day("ts", width_s).alias("slot")).agg(F.sum("premium").alias("premium"))
    grid = held.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    run = Window.partitionBy("day").orderBy("slot").rowsBetween(*_UPTO)
    prior = Window.partitionBy("slot").orderBy("day").rowsBetween(-sessions, -1)  # one row per day
    out = grid.join(held, ["day", "slot"], "left").withColumn("so_far", F.sum(F.coalesce("premium", F.lit(0.0))).over(run))
    return out.withColumn("base", F.avg("so_far").over(prior)).withColumn("rvol", ratio("so_far", "base")).select("day", "slot", "so_far", "base", "rvol")


def top_by(rows: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], k: int) -> DataFrame:
    """First k rows per key; the rank filter limits rows before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def daily_history(prints: DataFrame, since, until) -> DataFrame:
    used = prints.where(F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    return used.groupBy("ticker", "day").agg(
        F.sum("premium").alias("premium"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"),
        (_by_right(F.col("premium"), "C") - _by_right(F.col("premium"), "P")).alias("net_premium"))


def daily_statistics(nodes: DataFrame, session: Column, expected_frames: int) -> DataFrame:
    """Per day: spot open/high/low/close, extreme cells, mean and max of the frame peaks, frame count."""
    frames = nodes.groupBy("ticker", "ts").agg(F.max("spot").alias("spot"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    frames = frames.withColumns({"peak": F.greatest(F.abs("lo"), F.abs("hi")), "day": session})
    return frames.groupBy("ticker", "day").agg(
        F.min_by("spot", "ts").alias("open"), F.max("spot").alias("high"), F.min("spot").alias("low"), F.max_by("spot", "ts").alias("close"),
        F.min("lo").alias("min_cell"), F.max("hi").alias("max_cell"), F.avg("peak").alias("peak_mean"), F.max("peak").alias("peak_max"),
        F.count(F.lit(1)).alias("frames")).withColumn("complete", F.col("frames") >= expected_frames)


def side_of(price: Column, bid: Column, ask: Column) -> Column:
    """Buyer side at or above the ask or nearer to it than to the bid; mid stays mid."""
    mid = (bid + ask) / 2
    return F.when(price >= ask, "ask").when(price <= bid, "bid").when(price > mid, "ask").when(price < mid, "bid").otherwise("mid")


def signed_premium() -> dict[str, Column]:
    sign = F.when(F.col("side") == "ask", 1).when(F.col("side") == "bid", -1).otherwise(0)
    return {"ncp": F.when(F.col("right") == "C", sign * F.col("premium")).otherwise(0.0),
            "npp": F.when(F.col("right") == "P", sign * F.col("premium")).otherwise(0.0)}


def net_flow(prints: DataFrame, width: str = "minute") -> DataFrame:
    """Net call and put premium, net impact, and the tide: their running sums through the session.

    Prints are summed per minute first, so the running sums see at most one row
    per minute of a day.
    """
    parts = signed_premium()
    bars = prints.groupBy("ticker", "day", F.date_trunc(width, "ts").alias("at")).agg(*[F.sum(c).alias(n) for n, c in parts.items()])
    run = Window.partitionBy("ticker", "day").orderBy("at").rowsBetween(*_UPTO)
    bars = bars.withColumn("net_impact", F.col("ncp") - F.col("npp"))
    return bars.withColumns({f"tide_{c}": F.sum(c).over(run) for c in ("ncp", "npp", "net_impact")})


def bull_bear(prints: DataFrame, keys: Sequence[str]) -> DataFrame:
    buy, sell, call = F.col("side") == "ask", F.col("side") == "bid", F.col("right") == "C"
    bull, bear = (call & buy) | (~call & sell), (call & sell) | (~call & buy)
    return prints.groupBy(*keys).agg(
        F.sum(F.when(bull, F.col("premium")).otherwise(0.0)).alias("bull"), F.sum(F.when(bear, F.col("premium")).otherwise(0.0)).alias("bear")
    ).withColumn("bull_share", ratio("bull", F.col("bull") + F.col("bear")))


def strike_ladder(prints: DataFrame, keys: Sequence[str]) -> DataFrame:
    def part(right, side):
        hit = (F.col("right") == right) & (F.col("side") == side)
        return F.sum(F.when(hit, F.col("premium")).otherwise(0.0))

    return prints.groupBy(*keys, "strike").agg(
        part("C", "ask").alias("calls_bought"), part("C", "bid").alias("calls_sold"), part("P", "ask").alias("puts_bought"), part("P", "bid").alias("puts_sold"))


def repeated_hits(prints: DataFrame, band: Column, days: int = 7, min_hits: int = 3) -> DataFrame:
    """Ask-side prints of one contract and size band with at least ``min_hits`` in the last days.

    The count in (t - days, t] is a running sum where each print adds one at its
    time and takes it back when it leaves the window, so a busy contract is cut
    by day like any running sum.
    """
    span = days * 86_400_000_000
    hits = prints.where(F.col("side") == "ask").withColumns({"band": band, "_t": F.unix_micros("ts")})
    # Prints at one instant see each other: count per instant first, then run.
    steps = F.array(F.struct(F.col("_t").alias("t"), F.lit(1).alias("one")), F.struct((F.col("_t") + span).alias("t"), F.lit(-1).alias("one")))
    points = hits.select("occ", "band", F.explode(steps).alias("p")).groupBy("occ", "band", F.col("p.t").alias("_t")).agg(F.sum("p.one").alias("_one"))
    run = running_sum(points, ["occ", "band"], ["_t"], {"hits": F.col("_one")}, F.floor(F.col("_t") / 86_400_000_000))
    return hits.join(run.select("occ", "band", "_t", "hits"), ["occ", "band", "_t"]).where(F.col("hits") >= min_hits).drop("_t")


def contract_boards(days: DataFrame, as_of: Column, spans: dict[str, int]) -> DataFrame:
    """Sums of each contract over several look-back spans ending at ``as_of``, in one pass."""
    labels = F.array(*[F.struct(F.lit(n).alias("span"), F.lit(k).alias("k")) for n, k in spans.items()])
    rows = days.withColumn("s", F.explode(labels)).where((F.col("day") > F.date_sub(as_of, F.col("s.k"))) & (F.col("day") <= as_of))
    return rows.groupBy("s.span", "occ").agg(
        F.sum("volume").alias("volume"), F.sum("premium").alias("premium"), F.max_by("oi", "day").alias("oi"), F.sum("sweep_premium").alias("sweep_premium"),
        F.sum("sweep_volume").alias("sweep_volume")
    ).withColumns({"vol_oi": ratio("volume", "oi"), "sweep_share": ratio("sweep_volume", "volume")})


#: Boards and the column each is ordered by.
BOARDS = {"volume": "volume", "premium": "premium", "open_interest": "oi", "unusual": "vol_oi", "sweeps": "sweep_premium"}


def ranked_boards(contracts: DataFrame, keys: Sequence[str], orders: dict[str, str], ties: Sequence[str], k: int) -> DataFrame:
    """The first k rows of every order in one pass: a row meets each order once, then one rank by (keys, order)."""
    each = F.array(*[F.struct(F.lit(name).alias("board"), F.col(c).cast("double").alias("by")) for name, c in orders.items()])
    long = contracts.withColumn("_o", F.explode(each)).select("*", "_o.board", "_o.by").drop("_o").where("by is not null")
    return top_by(long, [*keys, "board"], "by", ties, k)


def dark_pool(prints: DataFrame, min_notional: float = 1_000_000.0) -> DataFrame:
    """Large off-exchange prints with their share of the ticker's average daily volume over the days before."""
    before = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    adv = prints.groupBy("ticker", "day").agg(F.sum("size").alias("_v")).select("ticker", "day", F.avg("_v").over(before).alias("adv"))
    big = prints.withColumn("notional", F.col("price") * F.col("size")).where(F.col("notional") >= min_notional)
    return big.join(adv, ["ticker", "day"]).withColumn("adv_share", ratio("size", "adv"))


def alert_outcomes(alerts: DataFrame, bars: DataFrame, horizons: Sequence[int] = (5, 15, 30), minute_us: int = 60_000_000) -> DataFrame:
    """Price at each horizon and at day end, and the best and worst move until day end.

    ``bars`` has ticker, day, ts, close, high, low. The excursions come from
    running maxima and minima taken backwards from the day's end; the bar of an
    alert is the last one at or before it.
    """
    keys = ["ticker", "day"]
    back = Window.partitionBy(*keys).orderBy(F.col("ts").desc()).rowsBetween(*_UPTO)
    b = bars.withColumns({"max_after": F.max("high").over(back), "min_after": F.min("low").over(back)})
    eod = bars.groupBy(*keys).agg(F.max_by("close", "ts").alias("price_eod"))
    marks = F.array(*[F.struct(F.lit(h).alias("h"), F.timestamp_micros(F.unix_micros("ts") + h * minute_us).alias("t")) for h in (0, *horizons)])
    asks = alerts.select(*keys, "alert_id", F.explode(marks).alias("m")).select(*keys, "alert_id", F.col("m.h").alias("h"), F.col("m.t").alias("t"))
    both = last_before(asks, b, keys, "t", "ts", ["close", "max_after", "min_after"], "at")
    pick = lambda h, f: F.max(F.when(F.col("h") == h, F.col(f"at.{f}")))
    out = both.groupBy(*keys, "alert_id").agg(
        pick(0, "close").alias("price_0"), *[pick(h, "close").alias(f"price_{h}") for h in horizons], pick(0, "max_after").alias("_hi"), pick(0, "min_after").alias("_lo"))
    return out.join(eod, keys, "left").withColumns({
        "mfe": F.col("_hi") - F.col("price_0"), "mae": F.col("_lo") - F.col("price_0")}).drop("_hi", "_lo")


def hit_rates(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of alerts up by half after 30 minutes, and doubled at the day's end; alerts without a price are not counted."""
    def share(price: str, factor: float):
        known = F.col("price_0").isNotNull() & (F.col("price_0") > 0) & F.col(price).isNotNull()
        return F.avg(F.when(known, (F.col(price) >= factor * F.col("price_0")).cast("double")))

    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts"), share("price_30", 1.5).alias("up_half_30m"), share("price_eod", 2.0).alias("doubled_eod"))


def breadth(bars: DataFrame, sectors: DataFrame, days: int = 20) -> DataFrame:
    """Share of names per sector and day closing above their own moving average."""
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(-(days - 1), 0)
    above = bars.withColumn("_above", F.when(F.col("close") > F.avg("close").over(w), 1.0).otherwise(0.0))
    return above.join(sectors, "ticker").groupBy("sector", "day").agg(F.avg("_above").alias("breadth"), F.count(F.lit(1)).alias("names"))


def put_call_ratio(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    return days.groupBy(*keys).agg(
        _by_right(F.col("volume"), "C").alias("calls"), _by_right(F.col("volume"), "P").alias("puts")).withColumn("put_call", ratio("puts", "calls"))


def max_pain(chain: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strike with the least payout to holders, ties to the smaller strike.

    Payout at K is K*sum(call OI below) - sum(call OI*s below) + sum(put OI*s above)
    - K*sum(put OI above), so prefix sums over the strikes replace comparing all
    pairs of strikes.
    """
    keys = list(keys)
    per = chain.groupBy(*keys, "strike").agg(F.sum("call_oi").alias("c"), F.sum("put_oi").alias("p"))
    below = Window.partitionBy(*keys).orderBy("strike").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy("strike").rowsBetween(1, Window.unboundedFollowing)
    s = F.col("strike")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    pain = (s * z(F.sum("c").over(below)) - z(F.sum(F.col("c") * s).over(below))
            + z(F.sum(F.col("p") * s).over(above)) - s * z(F.sum("p").over(above)))
    return per.withColumn("pain", pain).groupBy(*keys).agg(
        F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("payout"))
