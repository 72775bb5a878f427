"""Alarms about sources that fall silent, from timers that fire without input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAYLOAD_LIMIT_S, LAG_LIMIT_S = 900.0, 1800.0
HEARTBEAT = "source string, tier string, payload_ts timestamp"
ALARM = "source string, event string, payload_ts timestamp"


class SilenceProcessor(StatefulProcessor):
    """Freshness of one source by the time of its payload, never by its row counts.

    A newer payload restarts a processing-time timer; rows that repeat an older payload do
    not. If the timer fires the source is ``silent``, said once; the next newer payload says
    ``recovered``. Apart from that the rollup of the source (tier ``t1``) is compared with its raw
    rows (``t0``): a lag beyond the limit is said once as ``rollup_lag`` and its end as ``rollup_ok``.
    """

    def __init__(self, payload_limit_s: float = PAYLOAD_LIMIT_S, lag_limit_s: float = LAG_LIMIT_S):
        self.limit_ms, self.lag_us = int(payload_limit_s * 1000), int(lag_limit_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "t0_us bigint, t1_us bigint, timer_ms bigint, silent boolean, lagging boolean")

    def _rows(self, key, events: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({
            "source": pd.Series([key[0]] * len(events), dtype=object), "event": pd.Series([e for e, _ in events], dtype=object),
            "payload_ts": pd.Series([pd.Timestamp(t, unit="us") for _, t in events], dtype="datetime64[us]")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).dropna(subset=["payload_ts"])
        t0, t1, timer, silent, lagging = self.state.get() if self.state.exists() else (None, None, None, False, False)
        times = {tier: int(part.max().value // 1000) for tier, part in new.groupby("tier")["payload_ts"]}
        events = []
        if "t0" in times and (t0 is None or times["t0"] > t0):
            t0 = times["t0"]
            if silent:
                events.append(("recovered", t0))
            elif timer is not None:
                self.handle.deleteTimer(timer)
            timer, silent = int(timerValues.getCurrentProcessingTimeInMs()) + self.limit_ms, False
            self.handle.registerTimer(timer)
        t1 = max(t1 if t1 is not None else times.get("t1", 0), times.get("t1", 0)) if t1 is not None or "t1" in times else None
        late = t0 is not None and t1 is not None and t0 - t1 > self.lag_us
        if late != lagging:
            events.append(("rollup_lag" if late else "rollup_ok", t0))
        self.state.update((t0, t1, timer, silent, late))
        yield self._rows(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t0, t1, timer, silent, lagging = self.state.get()
        fired = not silent and timer == expiredTimerInfo.getExpiryTimeInMs()
        if fired:
            self.state.update((t0, t1, None, True, lagging))
        yield self._rows(key, [("silent", t0)] if fired else [])

    def close(self) -> None:
        pass


def alarms(heartbeats: DataFrame, payload_limit_s: float = PAYLOAD_LIMIT_S, lag_limit_s: float = LAG_LIMIT_S) -> DataFrame:
    """One row per change of a source's state. ``heartbeats``: source, tier, payload_ts."""
    return heartbeats.groupBy("source").transformWithStateInPandas(SilenceProcessor(payload_limit_s, lag_limit_s), ALARM, "append", "ProcessingTime")
