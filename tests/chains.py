"""Small chains with hand-computed results."""

import datetime as dt

NUMBERS = ("call_gex", "put_gex", "call_oi", "put_oi", "call_prev_oi", "put_prev_oi", "call_volume", "put_volume",
           "call_ask_vol", "call_bid_vol", "put_ask_vol", "put_bid_vol")
SCHEMA = "ticker string, ts timestamp, strike double, expiry date, spot double, " + ", ".join(f"{c} double" for c in NUMBERS)
T1 = dt.datetime(2026, 9, 30, 14, 30, tzinfo=dt.timezone.utc)
E1, E2 = dt.date(2026, 10, 15), dt.date(2026, 11, 20)


def row(ts, strike, expiry, spot=105.0, **values):
    return ("X", ts, float(strike), expiry, spot, *[float(values.get(c, 0)) for c in NUMBERS])


def psi_rows(ts=T1):
    return [
        row(ts, 100, E1, call_gex=10, put_gex=4, call_oi=50, put_oi=20, call_ask_vol=8, call_bid_vol=3, put_ask_vol=2, put_bid_vol=1, call_prev_oi=45, put_prev_oi=25),
        row(ts, 110, E1, call_gex=2, put_gex=7, call_oi=30, put_oi=10, call_ask_vol=1, call_bid_vol=4, put_ask_vol=3, put_bid_vol=2, call_prev_oi=30, put_prev_oi=12),
    ]


def second_rows(ts):
    return [
        row(ts, 100, E1, call_gex=4, put_gex=10, call_oi=55, put_oi=15, call_prev_oi=45, put_prev_oi=20),
        row(ts, 110, E1, call_gex=2, put_gex=7, call_oi=30, put_oi=10, call_prev_oi=30, put_prev_oi=12),
    ]


def grid_rows(ts=T1):
    return [row(ts, 100, E1, call_gex=10, put_gex=4), row(ts, 110, E1, call_gex=2, put_gex=7),
            row(ts, 100, E2, call_gex=3, put_gex=1), row(ts, 110, E2, call_gex=1, put_gex=4)]


def cells(spark, rows):
    from strikeloom.operators import grid

    return grid.cells(spark.createDataFrame(rows, SCHEMA))
