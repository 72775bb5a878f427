"""Shared pieces of the registered queries: cached view builders and output rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.functions.scalar import col
from strikeloom.operators import grid
from strikeloom.plans.registry import ROUND_SHIFT, view
from strikeloom.session import materialize

DAY_S = 86400.0


def r(c, digits: int = 6) -> Column:
    value = col(c).cast("double")
    return F.round(value + F.lit(ROUND_SHIFT * 10.0 ** -digits) if digits > 0 else value, digits)


def d(c) -> Column:
    """Date as text."""
    return F.date_format(col(c), "yyyy-MM-dd")


def t(c) -> Column:
    """Time as text to the second."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def n(c) -> Column:
    return col(c).cast("bigint")


def m_cells(spark, sf) -> DataFrame:
    return grid.with_first_spot(grid.cells(adapters.chain(spark, sf, "month")))


def d_cells(spark, sf) -> DataFrame:
    return grid.with_first_spot(grid.cells(adapters.chain(spark, sf, "day")))


def m_psi(spark, sf, gamma: float = 0.7) -> DataFrame:
    return grid.psi(grid.features(grid.columns(m_cells(spark, sf))), gamma)


def d_psi(spark, sf, gamma: float = 0.7) -> DataFrame:
    return grid.psi(grid.features(grid.columns(d_cells(spark, sf))), gamma)


MONTH_GAP_S = 31 * DAY_S
DAY_GAP_S = DAY_S


def valued(spark, sf, gamma: float = 0.7, p: float = 1.25) -> DataFrame:
    """Monthly cell values under smoothed weights, from one pass over the chain."""
    cells = materialize(m_cells(spark, sf), "cells")
    w = grid.smoothed_weights(grid.psi(grid.features(grid.columns(cells)), gamma), MONTH_GAP_S)
    # One shuffle by batch serves the column windows, the node sums and the ranks.
    return grid.cell_values(grid.shaped(cells.repartition("ticker", "ts"), p), w)


# --- SQL counterparts -----------------------------------------------------------

_CHAIN = """
SELECT l_returnflag AS ticker, CAST(date_trunc('{grain}', l_shipdate) AS TIMESTAMP) AS ts, l_quantity AS strike,
       make_date(2002, l_linenumber, 15) AS expiry,
       CASE WHEN l_suppkey % 2 = 0 THEN l_extendedprice * l_discount ELSE 0.0::DOUBLE END AS call_gex,
       CASE WHEN l_suppkey % 2 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice * l_discount END AS put_gex,
       CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 500 + 1 ELSE 0 END::DOUBLE AS call_oi,
       CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_partkey % 500 + 1 END::DOUBLE AS put_oi,
       CASE WHEN l_suppkey % 2 = 0 THEN l_orderkey % 500 ELSE 0 END::DOUBLE AS call_prev_oi,
       CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_orderkey % 500 END::DOUBLE AS put_prev_oi,
       CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 90 + 10 ELSE 0 END::DOUBLE AS call_volume,
       CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_partkey % 90 + 10 END::DOUBLE AS put_volume,
       CASE WHEN l_suppkey % 2 = 0 THEN l_orderkey % 41 ELSE 0 END::DOUBLE AS call_ask_vol,
       CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 37 ELSE 0 END::DOUBLE AS call_bid_vol,
       CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_orderkey % 41 END::DOUBLE AS put_ask_vol,
       CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_partkey % 37 END::DOUBLE AS put_bid_vol,
       l_tax + 0.1::DOUBLE AS iv,
       l_quantity AS row_spot, l_orderkey AS row_a, l_linenumber AS row_l
FROM lineitem
"""

_SPOT = """
SELECT ticker, ts, row_spot AS spot FROM (
  SELECT ticker, ts, row_spot, row_number() OVER (
    PARTITION BY ticker, ts ORDER BY row_a, row_l, row_spot) AS rn FROM chain_{g}) WHERE rn = 1
"""

_CELLS = """
SELECT c.*, s.spot FROM (
  SELECT ticker, ts, strike, expiry, sum(call_gex) AS call_gex, sum(put_gex) AS put_gex,
         sum(call_oi) AS call_oi, sum(put_oi) AS put_oi, sum(call_prev_oi) AS call_prev_oi,
         sum(put_prev_oi) AS put_prev_oi, sum(call_volume) AS call_volume, sum(put_volume) AS put_volume,
         sum(call_ask_vol) AS call_ask_vol, sum(call_bid_vol) AS call_bid_vol,
         sum(put_ask_vol) AS put_ask_vol, sum(put_bid_vol) AS put_bid_vol,
         sum(call_gex - put_gex) AS g, sum(abs(call_gex - put_gex)) AS abs_rows, count(*) AS n_rows,
         avg(iv) AS iv
  FROM chain_{g} GROUP BY ALL) c JOIN spot_{g} s USING (ticker, ts)
"""

_COLS = """
SELECT ticker, ts, expiry, sum(abs_rows) AS gmag, sum(g) AS net_col, sum(abs_rows * strike) AS com_num,
       sum(call_ask_vol + put_ask_vol) AS ask, sum(call_bid_vol + put_bid_vol) AS bid,
       sum(call_oi - call_prev_oi + put_oi - put_prev_oi) AS doi, max(spot) AS spot
FROM cells_{g} GROUP BY ticker, ts, expiry
"""

_FEATS = """
SELECT *, ln(greatest(date_diff('day', CAST(ts AS DATE), expiry), 0.25::DOUBLE)) AS log_dte,
       ln(gmag + 1) AS log_gmag, sign(net_col) * ln(1 + abs(net_col)) AS net_col_sign_log,
       (ask - bid) / (ask + bid + 1) AS askbid_imbalance, sign(doi) * ln(1 + abs(doi)) AS doi_migration,
       CASE WHEN gmag > 0 AND spot > 0 THEN abs(com_num / gmag - spot) / spot ELSE 0.0::DOUBLE END AS com_dist_rel,
       (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE AS tod_frac
FROM cols_{g}
"""

_PSI = """
SELECT *, CASE WHEN gmag = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN net_col >= 0 THEN 1 ELSE -1 END) * exp({gamma} * (
    25.345046::DOUBLE - 0.982964 * log_dte - 0.674570 * log_gmag - 0.674570 * net_col_sign_log
    - 0.300289 * askbid_imbalance + 0.077756 * doi_migration - 12.066771 * com_dist_rel
    + 1.449352 * tod_frac)) END AS psi
FROM feats_{g}
"""

_BATCHES = """
SELECT ticker, ts, spot, lag(ts) OVER (PARTITION BY ticker ORDER BY ts) AS prev_ts,
       row_number() OVER (PARTITION BY ticker ORDER BY ts) AS seq
FROM (SELECT ticker, ts, max(spot) AS spot FROM cols_{g} GROUP BY ticker, ts)
"""

_SEGS = """
SELECT *, row_number() OVER (PARTITION BY ticker, expiry, seg ORDER BY ts) - 1 AS k FROM (
  SELECT *, sum(st) OVER (PARTITION BY ticker, expiry ORDER BY ts) AS seg FROM (
    SELECT p.*, b.prev_ts, CASE WHEN lag(p.ts) OVER w IS NULL OR lag(p.ts) OVER w <> b.prev_ts
           OR date_diff('second', b.prev_ts, p.ts) > {gap} OR p.gmag = 0 THEN 1 ELSE 0 END AS st
    FROM psi_{g} p JOIN batches_{g} b USING (ticker, ts)
    WINDOW w AS (PARTITION BY p.ticker, p.expiry ORDER BY p.ts)))
"""

_WEIGHTS = """
SELECT s.ticker, s.ts, s.expiry, any_value(s.psi) AS psi, any_value(s.st) AS st, any_value(s.gmag) AS gmag,
       any_value(s.net_col) AS net_col,
       sum(q.psi * CASE WHEN q.k = 0 THEN pow(0.79::DOUBLE, s.k) ELSE 0.21::DOUBLE * pow(0.79::DOUBLE, s.k - q.k) END) AS a
FROM segs_{g} s JOIN segs_{g} q ON s.ticker = q.ticker AND s.expiry = q.expiry AND s.seg = q.seg AND q.k <= s.k
GROUP BY s.ticker, s.ts, s.expiry
"""

_SHAPED = """
SELECT *, CASE WHEN col_max > 0 THEN col_max * sign(g) * pow(abs(g) / col_max, {p}) ELSE 0.0::DOUBLE END AS h
FROM (SELECT *, max(abs(g)) OVER (PARTITION BY ticker, ts, expiry) AS col_max FROM cells_{g})
"""

_VALUED = """
SELECT s.*, w.a, coalesce(w.a, 0.0::DOUBLE) * s.h AS c
FROM shaped_{g} s LEFT JOIN weights_{g} w USING (ticker, ts, expiry)
"""

for _g, _grain, _gap in (("m", "month", 31 * 86400), ("d", "day", 86400)):
    view(f"chain_{_g}", _CHAIN.format(grain=_grain))
    view(f"spot_{_g}", _SPOT.format(g=_g))
    view(f"cells_{_g}", _CELLS.format(g=_g))
    view(f"cols_{_g}", _COLS.format(g=_g))
    view(f"feats_{_g}", _FEATS.format(g=_g))
    view(f"psi_{_g}", _PSI.format(g=_g, gamma="0.7::DOUBLE"))
    view(f"batches_{_g}", _BATCHES.format(g=_g))
    view(f"segs_{_g}", _SEGS.format(g=_g, gap=_gap))
    view(f"weights_{_g}", _WEIGHTS.format(g=_g))
    view(f"shaped_{_g}", _SHAPED.format(g=_g, p="1.25::DOUBLE"))
    view(f"valued_{_g}", _VALUED.format(g=_g))
    view(f"nodes_{_g}", f"SELECT ticker, ts, strike, sum(c) AS v, max(spot) AS spot FROM valued_{_g} GROUP BY ALL")

view("prints", r"""
SELECT event_id AS seq, ts, event_type AS ticker, 'T' || (user_id % 40)::VARCHAR AS underlying,
       printf('C%06d', user_id) AS occ, user_id AS contract,
       CASE WHEN user_id % 2 = 0 THEN 'C' ELSE 'P' END AS cp, 50.0::DOUBLE + user_id % 50 AS strike,
       CAST(DATE '2024-02-02' + CAST((user_id % 4) * 7 AS INTEGER) AS DATE) AS expiry, value AS price,
       k AS size, value AS premium,
       CASE k % 3 WHEN 0 THEN 'ask' WHEN 1 THEN 'bid' ELSE 'mid' END AS side, k % 5 = 0 AS is_sweep,
       CAST(ts AS DATE) AS day
FROM (SELECT *, regexp_extract(props, '\d+')::BIGINT AS k FROM events)
""")

view("cday", """
SELECT *, oi - net AS prev_oi FROM (
  SELECT *, 1000 + CAST(sum(net) OVER (PARTITION BY occ ORDER BY day) AS BIGINT) AS oi FROM (
    SELECT underlying, occ, contract, cp, strike, expiry, day, CAST(sum(size) AS BIGINT) AS volume,
           sum(premium) AS premium, count(*) AS trades,
           CAST(sum(CASE WHEN side = 'ask' THEN size ELSE 0 END) AS BIGINT) AS ask_volume,
           CAST(sum(CASE WHEN side = 'bid' THEN size ELSE 0 END) AS BIGINT) AS bid_volume,
           CAST(sum(CASE WHEN side = 'mid' THEN size ELSE 0 END) AS BIGINT) AS mid_volume,
           sum(CASE WHEN is_sweep THEN premium ELSE 0.0::DOUBLE END) AS sweep_premium,
           CAST(sum(CASE WHEN is_sweep THEN size ELSE 0 END) AS BIGINT) AS sweep_volume,
           CAST(sum(CASE WHEN size % 4 <> 0 THEN size ELSE -size END) AS BIGINT) AS net
    FROM prints GROUP BY underlying, occ, contract, cp, strike, expiry, day))
""")

view("bars", """
SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS day, min(o_totalprice) AS low,
       max(o_totalprice) AS high, arg_min(o_totalprice, o_orderkey) AS open,
       arg_max(o_totalprice, o_orderkey) AS "close", 0.1::DOUBLE + min(o_custkey % 50) / 100.0::DOUBLE AS iv,
       count(*) AS volume
FROM orders GROUP BY ALL
""")

view("sectors", """
SELECT 'T' || (c_custkey % 40)::VARCHAR AS underlying, arg_min(r_name, c_custkey) AS sector,
       arg_min(CAST(DATE '2024-02-01' + CAST(c_custkey % 60 AS INTEGER) AS DATE), c_custkey) AS report_date,
       arg_min(c_acctbal, c_custkey) AS market_cap
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
