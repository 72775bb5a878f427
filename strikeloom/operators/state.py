"""Per-cell and per-node state carried between batches, as ordered windows.

All windows here run over the batches of one cell, node or column, after the
chain has been reduced to cells, so their length is the number of batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.constants import CADENCE_S, EWMA_FAST, EWMA_SLOW, LAMBDA_CELL, STATE_BETA
from strikeloom.functions.ordered import ewma_scan
from strikeloom.functions.scalar import ratio_or, seconds_between
from strikeloom.operators.grid import BATCH, COLUMN, cell_flow

CELL = ("ticker", "strike", "expiry")


def cell_state(cells: DataFrame, batches: DataFrame, lam: float = LAMBDA_CELL, cadence_s: float = CADENCE_S) -> DataFrame:
    """Time-aware averages q_g and q_f of each cell.

    The decay uses the time since the ticker's previous batch, at least one
    second. A cell missing from a batch keeps its value; nothing resets it.
    """
    dt = F.greatest(seconds_between("ts", "prev_ts"), F.lit(1.0))
    step = F.coalesce(dt, F.lit(cadence_s)) / F.lit(cadence_s) * F.lit(-math.log(lam))
    info = batches.select("ticker", "ts", step.alias("_step"))
    own = Window.partitionBy(*CELL).orderBy("ts")
    rows = (
        cells.withColumn("f", cell_flow())
        .join(info, list(BATCH))
        .withColumn("_first", F.row_number().over(own) == 1)
    )
    rows = ewma_scan(rows, CELL, "ts", {"q_g": "g", "q_f": "f"}, "_step", "_first")
    return rows.drop("_step", "_first")


def session_range(cols: DataFrame, session: Column | None = None) -> DataFrame:
    """Running ceiling and floor of the column size within a session and its position."""
    session = F.to_date("ts") if session is None else session
    w = Window.partitionBy("ticker", "expiry", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cols.withColumn("session", session)
        .withColumn("ceil", F.max("gmag").over(w))
        .withColumn("floor", F.min("gmag").over(w))
        .withColumn("rho", (F.col("gmag") - F.col("floor")) / (F.col("ceil") - F.col("floor") + 1))
    )


def strike_bands(nodes: DataFrame) -> DataFrame:
    """Half the gap to the nearest neighbouring strike of the batch; 2.5 when alone."""
    w = Window.partitionBy(*BATCH).orderBy("strike")
    below = F.col("strike") - F.lag("strike").over(w)
    above = F.lead("strike").over(w) - F.col("strike")
    return nodes.withColumn("band", F.coalesce(F.least(below, above) / 2, F.lit(2.5)))


def interactions(nodes: DataFrame, batches: DataFrame) -> DataFrame:
    """Cumulative touch, deliver and reject counts per strike from consecutive spots.

    Only strikes present in a batch can change; their counts carry over batches
    they are missing from. A batch without a spot changes nothing.
    """
    seen = Window.partitionBy("ticker").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    path = batches.withColumn("prev_spot", F.last("spot", ignorenulls=True).over(seen)).select(
        "ticker", "ts", "spot", "prev_spot"
    )
    rows = strike_bands(nodes.select(*BATCH, "strike").distinct()).join(path, list(BATCH))
    both = F.col("spot").isNotNull() & F.col("prev_spot").isNotNull()
    now = both & (F.abs(F.col("spot") - F.col("strike")) <= F.col("band"))
    before = both & (F.abs(F.col("prev_spot") - F.col("strike")) <= F.col("band"))
    crossed = both & ((F.col("prev_spot") - F.col("strike")) * (F.col("spot") - F.col("strike")) < 0)
    w = Window.partitionBy("ticker", "strike").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)

    def total(flag):
        return F.sum(F.when(flag, 1).otherwise(0)).over(w)

    return rows.select(
        *BATCH, "strike", "band",
        total(now).alias("n_tch"),
        total(crossed).alias("n_del"),
        total(before & ~now & ~crossed).alias("n_rej"),
    )


def scores(counts: DataFrame) -> DataFrame:
    base = F.col("n_tch") + F.lit(1.0)
    return (
        counts.withColumn("s_del", F.col("n_del") / base)
        .withColumn("s_rej", F.col("n_rej") / base)
        .withColumn("s_tch", F.log1p(F.col("n_tch").cast("double")))
    )


def state_cells(cell_rows: DataFrame, weights: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells with weight ``a`` and column position ``rho`` attached."""
    col_info = weights.select(*COLUMN, "a").join(ranges.select(*COLUMN, "rho"), list(COLUMN), "full")
    return cell_rows.join(col_info, list(COLUMN), "left").withColumn("a", F.coalesce("a", F.lit(0.0)))


def node_design(rows: DataFrame, node_scores: DataFrame) -> DataFrame:
    """Eight design terms per node; the value is linear in the coefficients."""
    a = F.col("a")
    sums = rows.groupBy(*BATCH, "strike").agg(
        F.sum(a * F.col("g")).alias("x1"), F.sum(a * F.col("q_g")).alias("x2"),
        F.sum(a * F.col("f")).alias("x3"), F.sum(a * F.col("q_f")).alias("x4"),
        F.sum(a * F.col("g") * F.col("rho")).alias("x5"),
    )
    s = node_scores.select(*BATCH, "strike", "s_del", "s_rej", "s_tch")
    out = sums.join(s, [*BATCH, "strike"], "left")
    for i, name in ((6, "s_del"), (7, "s_rej"), (8, "s_tch")):
        out = out.withColumn(f"x{i}", F.coalesce(name, F.lit(0.0)))
    return out.drop("s_del", "s_rej", "s_tch")


def linear_value(beta: Sequence[float] = STATE_BETA) -> Column:
    out = F.lit(0.0)
    for i, b in enumerate(beta, start=1):
        out = out + F.lit(b) * F.col(f"x{i}")
    return out


def state_cell_values(rows: DataFrame, node_scores: DataFrame, beta: Sequence[float] = STATE_BETA) -> DataFrame:
    """Cell values of the state model; node scores are shared over the batch's expiries."""
    n_exp = rows.groupBy(*BATCH).agg(F.countDistinct("expiry").alias("_n"))
    s = node_scores.select(*BATCH, "strike", "s_del", "s_rej", "s_tch")
    out = rows.join(n_exp, list(BATCH)).join(s, [*BATCH, "strike"], "left")
    terms = ("g", "q_g", "f", "q_f")
    core = F.lit(0.0)
    for b, name in zip(beta, terms):
        core = core + F.lit(b) * F.col(name)
    core = core + F.lit(beta[4]) * F.col("g") * F.col("rho")
    shared = F.lit(0.0)
    for b, name in zip(beta[5:], ("s_del", "s_rej", "s_tch")):
        shared = shared + F.lit(b) * F.coalesce(name, F.lit(0.0))
    return out.withColumn("c", F.col("a") * core + shared / F.col("_n")).drop("_n")


def accumulators(cells: DataFrame) -> DataFrame:
    """Running sums and step averages of each cell over its own batches."""
    own = Window.partitionBy(*CELL).orderBy("ts")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    imb = (F.col("call_ask_vol") - F.col("call_bid_vol")) - (F.col("put_ask_vol") - F.col("put_bid_vol"))
    doi = (F.col("call_oi") - F.col("call_prev_oi")) - (F.col("put_oi") - F.col("put_prev_oi"))
    rows = cells.withColumns({
        "cum_net_volume": F.sum(F.col("call_volume") - F.col("put_volume")).over(run),
        "cum_imb": F.sum(imb).over(run),
        "cum_doi_net": F.sum(doi).over(run),
        "n_batches": F.count(F.lit(1)).over(run).cast("double"),
        "_first": F.row_number().over(own) == 1,
    })
    for name, lam in (("slow", EWMA_SLOW), ("fast", EWMA_FAST)):
        rows = ewma_scan(rows, CELL, "ts", {f"ewma_g_{name}": "g"}, f"{-math.log(lam)!r}D", "_first")
    dev = {
        f"g_dev_{n}": F.coalesce(F.col("g") - F.lag(f"ewma_g_{n}").over(own), F.lit(0.0)) for n in ("slow", "fast")
    }
    return rows.withColumns(dev).drop("_first")


def column_stats(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*COLUMN).agg(
        F.sum(F.abs("g")).alias("g_abs_sum"), F.avg("g").alias("g_mean"), F.stddev_pop("g").alias("g_std"),
        (F.min("g") == F.max("g")).alias("g_constant"),
    )


CELL_FEATURES = (
    "g", "call_gex", "put_gex", "gex_value", "abs_gex", "dex_value", "net_dex", "call_dex", "put_dex",
    "net_oi", "tot_oi", "abs_oi", "doi_net", "doi_gross", "net_volume", "tot_volume", "cab", "pab", "imb", "iv",
    "x", "ax", "x2", "sgx", "expd", "g_x", "g_sgx", "abs_g_expd", "g_expd", "net_oi_expd", "net_oi_x",
    "g_colnorm", "g_z", "cum_net_volume", "cum_imb", "cum_doi_net", "ewma_g_slow", "g_dev_slow",
    "ewma_g_fast", "g_dev_fast", "n_batches",
)


def cell_features(cells: DataFrame) -> DataFrame:
    """The 41 model inputs of each cell.

    Greek exposures the chain does not carry (``call_dex``, ``put_dex``) are
    taken from columns of that name when present, else 0.
    """
    rows = accumulators(cells).join(column_stats(cells), list(COLUMN))
    for name in ("call_dex", "put_dex"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0.0))
    g = F.col("g")
    x = F.when(F.col("spot") != 0, (F.col("strike") - F.col("spot")) / F.col("spot")).otherwise(0.0)
    rows = rows.withColumn("x", x).withColumn("expd", F.exp(-F.abs("x") / F.lit(0.02))).withColumn(
        "sgx", F.signum("x"))
    dcoi = F.col("call_oi") - F.col("call_prev_oi")
    dpoi = F.col("put_oi") - F.col("put_prev_oi")
    net_oi = F.col("call_oi") - F.col("put_oi")
    cab = F.col("call_ask_vol") - F.col("call_bid_vol")
    pab = F.col("put_ask_vol") - F.col("put_bid_vol")
    made = {
        "gex_value": F.col("call_gex") - F.col("put_gex"),
        "abs_gex": F.col("abs_rows"),
        "dex_value": F.col("call_dex") + F.col("put_dex"),
        "net_dex": F.col("call_dex") - F.col("put_dex"),
        "net_oi": net_oi, "tot_oi": F.col("call_oi") + F.col("put_oi"), "abs_oi": F.col("call_oi") + F.col("put_oi"),
        "doi_net": dcoi - dpoi, "doi_gross": F.abs(dcoi) + F.abs(dpoi),
        "net_volume": F.col("call_volume") - F.col("put_volume"),
        "tot_volume": F.col("call_volume") + F.col("put_volume"),
        "cab": cab, "pab": pab, "imb": cab - pab,
        "ax": F.abs("x"), "x2": F.col("x") * F.col("x"),
        "g_x": g * F.col("x"), "g_sgx": g * F.col("sgx"), "abs_g_expd": F.col("abs_rows") * F.col("expd"),
        "g_expd": g * F.col("expd"), "net_oi_expd": net_oi * F.col("expd"), "net_oi_x": net_oi * F.col("x"),
        "g_colnorm": g / (F.col("g_abs_sum") + 1e-30),
        # A constant column has no deviation; what rounding leaves of it must not be divided by.
        "g_z": F.when(F.col("g_constant"), 0.0).otherwise((g - F.col("g_mean")) / (F.col("g_std") + 1e-30)),
    }
    rows = rows.withColumns(made)
    return rows.select("ticker", "ts", "strike", "expiry", "spot", *CELL_FEATURES)
