"""From raw chain rows to smoothed weights, column ranges and node state, as chained streams.

    raw rows --(watermark closes a batch)--> columns or nodes of whole batches
             --(clock per ticker)----------> spot, previous batch time and spot, strike bands
             --(keyed state)---------------> weights, ranges, cell averages and interaction counts

A batch is the rows of one ticker and batch time. Its rows may come in any order and number
of micro-batches; Spark's streaming aggregation holds it until the watermark passes its time,
so every later operator sees whole batches, each once and in order. Rows for a batch that is
closed are late: Spark drops them, and ``late_rows`` counts them. The last batches of a
source close when its end is marked (``run_to_end``).

What follows a closed batch is as small as the grid. A busy ticker's clock sees its grid,
never its rows; the rest is keyed by (ticker, expiry) or (ticker, strike).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strikeloom.constants import CADENCE_S, LAMBDA_CELL
from strikeloom.operators import grid
from strikeloom.streaming.jobs import RANGE_OUTPUT, WEIGHT_OUTPUT, RangeProcessor, WeightProcessor, open_rows, stateful

_COLUMN = "ticker string, ts timestamp, expiry date, gmag double, net_col double, com_num double, ask double, bid double, doi double, n_rows bigint"
_NODE = "ticker string, ts timestamp, strike double, expiries array<int>, g array<double>, f array<double>"
_CLOCK = ", spot double, prev_ts timestamp, prev_spot double"

NODE_OUTPUT = "ticker string, strike double, expiry date, ts timestamp, q_g double, q_f double, n_tch bigint, n_del bigint, n_rej bigint"


def closed_columns(rows: DataFrame, delay: str) -> DataFrame:
    """Column sums of every batch the watermark has passed."""
    g = F.col("call_gex") - F.col("put_gex")
    cells = open_rows(rows, delay).groupBy("ticker", "ts", "strike", "expiry").agg(
        F.sum(F.abs(g)).alias("gmag"), F.sum(g).alias("net_col"), F.sum(F.abs(g) * F.col("strike")).alias("com_num"),
        F.sum(F.col("call_ask_vol") + F.col("put_ask_vol")).alias("ask"), F.sum(F.col("call_bid_vol") + F.col("put_bid_vol")).alias("bid"),
        F.sum(grid.cell_flow()).alias("doi"), F.count(F.lit(1)).alias("n_rows"), F.min("row_key").alias("order_key"))
    # Of equal keys the least strike counts. Only cells meet this pair: no hash aggregate takes its minimum.
    first = F.min(F.when(F.col("order_key").isNotNull(), F.struct("order_key", F.col("strike").isNull().alias("bare"), "strike")))
    cols = cells.groupBy("ticker", "ts", "expiry").agg(*[F.sum(c).alias(c) for c in ("gmag", "net_col", "com_num", "ask", "bid", "doi", "n_rows")], first.alias("first"))
    return cols.select("*", F.col("first.order_key").alias("order_key"), F.col("first.strike").alias("order_spot")).drop("first")


def closed_nodes(rows: DataFrame, delay: str) -> DataFrame:
    """The cells of every strike of every batch the watermark has passed, as arrays by expiry (days since 1970)."""
    cells = open_rows(rows, delay).groupBy("ticker", "ts", "strike", F.unix_date("expiry").alias("expiry")).agg(
        F.sum(F.col("call_gex") - F.col("put_gex")).alias("g"), F.sum(grid.cell_flow()).alias("f"),
        F.min("row_key").alias("order_key"))
    nodes = cells.groupBy("ticker", "ts", "strike").agg(
        F.array_sort(F.collect_list(F.struct("expiry", "g", "f"))).alias("c"), F.min("order_key").alias("order_key"))
    return nodes.select("ticker", "ts", "strike", F.col("c.expiry").alias("expiries"), F.col("c.g").alias("g"), F.col("c.f").alias("f"), "order_key",
                        F.col("strike").alias("order_spot"))


class BatchClock(StatefulProcessor):
    """Spot of each closed batch of one ticker, with the time and the spot of the batch before it.

    The spot is that of the batch's first row, of equal keys the least; a batch without one leaves the last known
    spot standing. With ``bands`` each strike gets half the gap to its nearest neighbour in the
    batch, 2.5 when alone.
    """

    def __init__(self, bands: bool = False):
        self.bands = bands

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", "ts_us bigint, spot double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        held = self.state.get() if self.state.exists() else (None, None)
        last, known = held
        done = []
        for ts, batch in new.groupby("ts", sort=True):
            batch = batch.sort_values(["order_key", "order_spot"])
            spot = batch["order_spot"].dropna()
            out = batch.drop(columns=["order_key", "order_spot"])
            out["spot"] = float(spot.iloc[0]) if len(spot) else np.nan
            out["prev_ts"] = pd.Timestamp(last * 1000) if last is not None else pd.NaT
            out["prev_spot"] = np.nan if known is None else known
            if self.bands:
                out = out.sort_values("strike")
                gaps = np.diff(out["strike"].to_numpy())
                edge = np.concatenate([[np.inf], gaps, [np.inf]])
                near = np.minimum(edge[:-1], edge[1:])
                out["band"] = np.where(np.isinf(near), 2.5, near / 2)
            done.append(out)
            last = int(pd.Timestamp(ts).value // 1000)
            known = float(spot.iloc[0]) if len(spot) else known
        self.state.update((last, known))
        yield pd.concat(done)

    def close(self) -> None:
        pass


class NodeState(StatefulProcessor):
    """Cell averages and interaction counts of one (ticker, strike): one value of arrays by expiry, updated in numpy."""

    def __init__(self, lam: float = LAMBDA_CELL, cadence_s: float = CADENCE_S):
        self.rate, self.cadence_s = -math.log(lam), cadence_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("node", "tch bigint, del bigint, rej bigint, expiries array<int>, q_g array<double>, q_f array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts")
        held = self.state.get() if self.state.exists() else (0, 0, 0, [], [], [])
        tch, dlv, rej = held[:3]
        days, q_g, q_f = np.array(held[3], np.int64), np.array(held[4], float), np.array(held[5], float)
        strike, out = float(key[1]), []
        for row in new.itertuples():
            if not (np.isnan(row.spot) or np.isnan(row.prev_spot)):
                now, before = abs(row.spot - strike) <= row.band, abs(row.prev_spot - strike) <= row.band
                crossed = (row.prev_spot - strike) * (row.spot - strike) < 0
                tch, dlv, rej = tch + int(now), dlv + int(crossed), rej + int(before and not now and not crossed)
            dt = self.cadence_s if pd.isna(row.prev_ts) else max((row.ts - row.prev_ts).total_seconds(), 1.0)
            keep = math.exp(-self.rate * dt / self.cadence_s)
            seen, g, f = np.asarray(row.expiries, np.int64), np.asarray(row.g, float), np.asarray(row.f, float)
            fresh = np.setdiff1d(seen, days)
            order = np.argsort(np.concatenate([days, fresh]), kind="stable")
            blank = np.full(fresh.size, np.nan)
            days, q_g, q_f = (np.concatenate(x)[order] for x in ((days, fresh), (q_g, blank), (q_f, blank)))
            at = np.searchsorted(days, seen)
            q_g[at] = np.where(np.isnan(q_g[at]), g, keep * q_g[at] + (1 - keep) * g)
            q_f[at] = np.where(np.isnan(q_f[at]), f, keep * q_f[at] + (1 - keep) * f)
            out.append(pd.DataFrame({
                "ticker": row.ticker, "strike": strike, "expiry": seen.astype("datetime64[D]").astype(object), "ts": row.ts, "q_g": q_g[at], "q_f": q_f[at],
                "n_tch": tch, "n_del": dlv, "n_rej": rej}))
        self.state.update((int(tch), int(dlv), int(rej), days.tolist(), q_g.tolist(), q_f.tolist()))
        yield pd.concat(out)

    def close(self) -> None:
        pass


def weights(rows: DataFrame, delay: str, gap_s: float, gamma: float = 0.7) -> DataFrame:
    """Smoothed column weights from raw rows; ``n_rows`` says how many of them a column has."""
    clocked = stateful(closed_columns(rows, delay), ["ticker"], BatchClock(), _COLUMN + _CLOCK)
    psi = grid.psi(grid.features(clocked), gamma).select("ticker", "expiry", "ts", "prev_ts", "gmag", "psi")
    return stateful(psi, ["ticker", "expiry"], WeightProcessor(gap_s), WEIGHT_OUTPUT)


def ranges(rows: DataFrame, delay: str, session) -> DataFrame:
    """Running ceiling and floor of the columns within a session, from raw rows."""
    cols = closed_columns(rows, delay).select("ticker", "expiry", "ts", session.alias("session"), "gmag")
    return stateful(cols, ["ticker", "expiry"], RangeProcessor(), RANGE_OUTPUT)


def node_state(rows: DataFrame, delay: str, lam: float = LAMBDA_CELL, cadence_s: float = CADENCE_S) -> DataFrame:
    """Cell averages and interaction counts from raw rows."""
    clocked = stateful(closed_nodes(rows, delay), ["ticker"], BatchClock(bands=True), _NODE + _CLOCK + ", band double")
    return stateful(clocked, ["ticker", "strike"], NodeState(lam, cadence_s), NODE_OUTPUT)


def closed_counts(rows: DataFrame, delay: str) -> DataFrame:
    """Rows of every closed batch."""
    return open_rows(rows, delay).groupBy("ticker", "ts").agg(F.count(F.lit(1)).alias("n_rows"))
