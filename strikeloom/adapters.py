"""Views that read the driver tables as option chains, prints and daily series.

Each view keeps the whole table and only renames or combines columns, so the
work of every query built on it grows with the table it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions.scalar import contract_id
from strikeloom.session import table

CHAIN_NUMBERS = (
    "call_gex", "put_gex", "call_oi", "put_oi", "call_prev_oi", "put_prev_oi",
    "call_volume", "put_volume", "call_ask_vol", "call_bid_vol", "put_ask_vol", "put_bid_vol",
)


def chain(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    """Option-chain rows from lineitem; ``grain`` sets the batch time."""
    call = "l_suppkey % 2 = 0"

    def side(name, value):
        value = f"CAST({value} AS DOUBLE)"
        return [f"CASE WHEN {call} THEN {value} ELSE 0D END AS call_{name}", f"CASE WHEN {call} THEN 0D ELSE {value} END AS put_{name}"]

    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS ticker",
        f"date_trunc('{grain}', l_shipdate) AS ts",
        "l_quantity AS strike",
        "make_date(2002, l_linenumber, 15) AS expiry",
        *side("gex", "l_extendedprice * l_discount"),
        *side("oi", "l_partkey % 500 + 1"),
        *side("prev_oi", "l_orderkey % 500"),
        *side("volume", "l_partkey % 90 + 10"),
        *side("ask_vol", "l_orderkey % 41"),
        *side("bid_vol", "l_partkey % 37"),
        "l_tax + 0.1D AS iv",
        # The batch spot is the quantity, here the strike, of the first row in key order. One
        # number holds order and line (of any int), so that a hash aggregate can take the minimum.
        "CAST(l_orderkey AS DECIMAL(38,0)) * 10000000000 + l_linenumber AS row_key",
        "l_orderkey AS row_a",
    )


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade prints from events: one row per event, contract = user."""
    return prints_of(table(spark, sf_dir, "events"))


def prints_of(ev: DataFrame) -> DataFrame:
    with_size = ev.selectExpr("*", r"CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k")
    return with_size.selectExpr(
        "event_id AS seq", "ts", "event_type AS ticker",
        "concat('T', CAST(user_id % 40 AS STRING)) AS underlying",
        "CASE WHEN user_id IS NOT NULL THEN format_string('C%06d', user_id) END AS occ",
        "user_id AS contract",
        "CASE WHEN user_id % 2 = 0 THEN 'C' ELSE 'P' END AS right",
        "50D + user_id % 50 AS strike",
        "date_add(DATE '2024-02-02', CAST((user_id % 4) * 7 AS INT)) AS expiry",
        "value AS price", "k AS size", "value AS premium",
        "CASE k % 3 WHEN 0 THEN 'ask' WHEN 1 THEN 'bid' ELSE 'mid' END AS side",
        "k % 5 = 0 AS is_sweep",
        "to_date(ts) AS day",
    )


def contract_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily contract rows with open interest that opens and closes."""
    # A sum of doubles depends on its order, and equal sums tie in an own history: the premiums of a day
    # are added in event order, however the table is cut. The frame is the whole day, so this is linear.
    in_order = "sum(premium) OVER (PARTITION BY contract, day ORDER BY seq, ts, premium ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    rows = prints(spark, sf_dir).selectExpr("*", f"{in_order} AS _premium")
    days = rows.groupBy("underlying", "occ", "contract", "right", "strike", "expiry", "day").agg(
        F.expr("sum(size) AS volume"), F.expr("max(_premium) AS premium"), F.expr("count(1) AS trades"),
        *[F.expr(f"sum(CASE WHEN side = '{x}' THEN size ELSE 0 END) AS {x}_volume") for x in ("ask", "bid", "mid")],
        F.expr("sum(CASE WHEN is_sweep THEN premium ELSE 0D END) AS sweep_premium"),
        F.expr("sum(CASE WHEN is_sweep THEN size ELSE 0 END) AS sweep_volume"),
        F.expr("sum(CASE WHEN size % 4 <> 0 THEN size ELSE -size END) AS _net"),
    )
    # One contract trades on at most a few hundred days, so its days fit one window.
    run = "1000 + sum(_net) OVER (PARTITION BY occ ORDER BY day NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return days.selectExpr("*", f"{run} AS oi").selectExpr("* EXCEPT (_net)", "oi - _net AS prev_oi")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price and volatility series per order priority, from orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("day")
    ).agg(
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        (F.lit(0.1) + F.min(F.col("o_custkey") % 50) / 100.0).alias("iv"),
        F.count(F.lit(1)).alias("volume"),
    )


def spot_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prints(spark, sf_dir)
    return p.select("ticker", "ts", "seq", "price", "size")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underlying to sector: nations label underlyings, regions are sectors."""
    cu = table(spark, sf_dir, "customer")
    na = table(spark, sf_dir, "nation")
    re = table(spark, sf_dir, "region")
    names = na.join(re, na.n_regionkey == re.r_regionkey).select("n_nationkey", F.col("r_name").alias("sector"))
    ticker = F.concat(F.lit("T"), (F.col("c_custkey") % 40).cast("string"))
    return (
        cu.join(names, cu.c_nationkey == names.n_nationkey)
        .groupBy(ticker.alias("underlying"))
        .agg(
            F.min_by("sector", "c_custkey").alias("sector"),
            F.min_by(
                F.date_add(F.lit("2024-02-01").cast("date"), (F.col("c_custkey") % 60).cast("int")), "c_custkey"
            ).alias("report_date"),
            F.min_by("c_acctbal", "c_custkey").alias("market_cap"),
        )
    )


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-of-day option quotes shaped like archive files, from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    close = F.when(F.col("l_partkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice") / 100)
    return li.select(
        F.col("l_returnflag").alias("ticker"),
        F.date_format("l_shipdate", "yyyy").alias("year"),
        F.make_date(F.lit(2002), F.col("l_linenumber"), F.lit(15)).alias("expiration"),
        F.col("l_quantity").alias("strike"),
        F.when(F.col("l_suppkey") % 2 == 0, "CALL").otherwise("PUT").alias("right"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"),
        (F.col("l_partkey") % 90).cast("double").alias("volume"),
        (F.col("l_partkey") % 9).cast("double").alias("count"),
        close.alias("close"),
        (F.col("l_extendedprice") / 128).alias("bid"),
        (F.col("l_extendedprice") / 64).alias("ask"),
        contract_id(
            F.col("l_returnflag"), F.make_date(F.lit(2002), F.col("l_linenumber"), F.lit(15)),
            F.when(F.col("l_suppkey") % 2 == 0, "C").otherwise("P"), F.col("l_quantity"),
        ).alias("occ"),
    )


def raw_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclean chain rows: text numbers, missing strikes and expiries, late fetches."""
    li = table(spark, sf_dir, "lineitem")
    ts = F.date_trunc("month", "l_shipdate")
    fetched = F.when(F.col("l_orderkey") % 7 == 0, F.lit(None).cast("string")).when(
        F.col("l_orderkey") % 11 == 0, "not a time"
    ).otherwise(F.date_format(F.timestamp_seconds(F.unix_timestamp(ts) + F.col("l_partkey") % 600),
                              "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    strike = F.when(F.col("l_partkey") % 101 == 0, F.lit(None).cast("string")).when(
        F.col("l_partkey") % 103 == 0, "n/a"
    ).otherwise(F.col("l_quantity").cast("string"))
    return li.select(
        F.col("l_returnflag").alias("ticker"),
        ts.alias("ts"),
        strike.alias("strike"),
        F.when(F.col("l_suppkey") % 53 != 0, F.make_date(F.lit(2002), F.col("l_linenumber"), F.lit(15))).alias("expiry"),
        fetched.alias("fetched_text"),
        F.when(F.col("l_orderkey") % 5 == 0, "bad").otherwise(F.col("l_extendedprice").cast("string")).alias("call_gex"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_quantity") + 100).alias("spot_price"),
    )


def raw_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows as a vendor would send them: numbers as text, separators in symbols."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_suppkey") % 3 == 0, "call").when(F.col("l_suppkey") % 3 == 1, "PUT").otherwise("other")
    return li.select(
        F.concat(F.lower("l_returnflag"), F.lit("__"), F.col("l_partkey").cast("string"), F.lit(" "),
                 F.col("l_linenumber").cast("string")).alias("option_symbol"),
        F.lower("l_returnflag").alias("underlying_symbol"),
        kind.alias("option_type"),
        F.col("l_quantity").cast("string").alias("strike"),
        F.date_format(F.make_date(F.lit(2002), F.col("l_linenumber"), F.lit(15)), "yyyy-MM-dd").alias("expires"),
        F.when(F.col("l_partkey") % 17 == 0, "0").otherwise(
            (F.col("l_partkey") % 1000 / F.lit(4.0)).cast("string")).alias("avg_price"),
        F.when(F.col("l_partkey") % 19 == 0, "0").otherwise(
            (F.col("l_orderkey") % 100 / F.lit(8.0)).cast("string")).alias("last_price"),
        (F.col("l_partkey") % 90).cast("string").alias("volume"),
        (F.col("l_partkey") % 500).cast("string").alias("open_interest"),
        F.when(F.col("l_orderkey") % 23 != 0, (F.col("l_orderkey") % 500).cast("string")).alias("prev_oi"),
        (F.col("l_orderkey") % 41).alias("bid_volume"),
        (F.col("l_partkey") % 37).alias("ask_volume"),
        (F.col("l_suppkey") % 29).alias("mid_volume"),
        F.when(F.col("l_linenumber") == 3, 0.0).otherwise(F.col("l_tax") + F.lit(0.1)).alias("iv"),
        F.col("l_shipdate").alias("last_tape_time"),
        F.col("l_orderkey").alias("src_order"),
    )


def snapshots(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Raw option snapshots from events, batch or streaming."""
    p = prints(spark, sf_dir) if source is None else prints_of(source)
    size, price = F.col("size"), F.col("price")
    return p.select(
        "ticker", "expiry", "strike", "ts", "seq", price.alias("spot"),
        (size * 10 + F.col("seq") % 7).alias("call_oi"), (F.lit(1000) - size).alias("put_oi"),
        (F.col("seq") % 1000).alias("call_volume"), size.alias("put_volume"),
        (price / 1000).alias("call_gamma"), (price / 2000).alias("put_gamma"),
        (F.lit(0.1) + size / 200).alias("call_iv"), (F.lit(0.2) + size / 200).alias("put_iv"),
        (price * size).alias("call_gex"), (price * (F.lit(100) - size) / 2).alias("put_gex"),
        (price * 0.5).alias("call_vex"), (price * 0.25).alias("put_vex"),
        (size / 100.0).alias("call_delta"), (size / 100.0 - 1).alias("put_delta"),
    )
