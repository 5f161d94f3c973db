"""Hourly panes of a stream: one on time, one more for each late reading, none beyond the tolerance.

Spark's own windows give neither panes nor lateness counted from the window's end, so
this is a stateful processor. With tolerance L and window H the query's watermark is
delayed by D = L + H, so that Spark never drops a reading that is still due, and the
processor holds the exact rule against ``watermark + D``. State is a running count,
sum, least and greatest for each hour and series, cleared when the tolerance ends.
A batch's readings are added one after another in the order of their instants, so that
the sum depends neither on how the shuffle brings them nor on the cut into batches
of a stream in order; readings of one instant stay as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000
TOLERANCE_MS = 48 * HOUR_MS
PER_HOUR = 12
OUTPUT = "hora timestamp, indicador_id bigint, potencia_media_mw double, potencia_min_mw double, potencia_max_mw double, lecturas bigint, hora_completa boolean, panel bigint, es_tardio boolean, emitido_en timestamp"
STATE = "n bigint, total double, low double, high double, panel bigint"


class HourlyPanes(StatefulProcessor):
    """Panes of one (indicador_id, hour)."""

    def __init__(self, tolerance_ms: int = TOLERANCE_MS, per_hour: int = PER_HOUR) -> None:
        self.tolerance_ms, self.per_hour = tolerance_ms, per_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hour = handle.getValueState("hour", STATE)

    def _pane(self, key: tuple, state: tuple, late: bool) -> dict:
        n, total, low, high, panel = state
        return {
            "hora": datetime.fromtimestamp(key[1] / 1000, timezone.utc), "indicador_id": key[0], "potencia_media_mw": total / n, "potencia_min_mw": low, "potencia_max_mw": high,
            "lecturas": n, "hora_completa": n == self.per_hour, "panel": panel, "es_tardio": late, "emitido_en": datetime.now(timezone.utc),
        }

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = key[1] + HOUR_MS
        now = timerValues.getCurrentWatermarkInMs() + self.tolerance_ms + HOUR_MS
        parts = list(rows)
        values = np.concatenate([np.zeros(0), *(part["valor"].to_numpy(dtype=float) for part in parts)])
        if parts:
            values = values[np.argsort(np.concatenate([part["instante"].to_numpy() for part in parts]), kind="stable")]
        if now >= end + self.tolerance_ms or not len(values):
            return
        panes = []
        if self.hour.exists():
            state = self.hour.get()
        else:
            state = (0, 0.0, float("inf"), float("-inf"), -1)
            self.handle.registerTimer(end - self.tolerance_ms - HOUR_MS)  # fires when the hour has ended
            self.handle.registerTimer(end - HOUR_MS)  # fires when the tolerance has
        late = now >= end
        if late and state[0] and state[4] < 0:  # the batch's rows come before its timers
            state = (*state[:4], 0)
            panes.append(self._pane(key, state, False))
        for some in np.split(values, len(values)) if late else [values]:  # a late reading is a pane of its own
            total = float(np.cumsum([state[1], *some])[-1])  # unlike sum(), one after another
            state = (state[0] + len(some), total, min(state[2], float(some.min())), max(state[3], float(some.max())), state[4] + 1 if late else state[4])
            if late:
                panes.append(self._pane(key, state, True))
        self.hour.update(state)
        if panes:
            yield pd.DataFrame(panes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.hour.exists():
            return
        if expiredTimerInfo.getExpiryTimeInMs() >= key[1]:
            self.hour.clear()
            return
        state = self.hour.get()
        if state[4] < 0:
            state = (*state[:4], 0)
            self.hour.update(state)
            yield pd.DataFrame([self._pane(key, state, False)])

    def close(self) -> None:
        pass


def hourly_panes(readings: DataFrame, tolerance_ms: int = TOLERANCE_MS, per_hour: int = PER_HOUR, distinct: bool = False) -> DataFrame:
    """Streaming panes of readings (indicador_id, instante, valor). With distinct, a repeated reading counts once.

    The state store must be RocksDB's, which the engine's session sets.
    """
    delay = f"{(tolerance_ms + HOUR_MS) // 1000} seconds"
    timed = readings.withColumn("instante", F.col("instante").cast("timestamp")).withWatermark("instante", delay)
    if distinct:
        timed = timed.dropDuplicatesWithinWatermark(["indicador_id", "instante", "valor"])
    keyed = timed.withColumn("hour_ms", F.unix_millis(F.date_trunc("hour", "instante")))
    return keyed.groupBy("indicador_id", "hour_ms").transformWithStateInPandas(statefulProcessor=HourlyPanes(tolerance_ms, per_hour), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
