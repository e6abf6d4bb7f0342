"""Causal features of signal streams that arrive in any order: the streaming form of ``operators.history.history``.

Rows wait in state, by their day, until the watermark has passed it; then they go on in order of (day, tie), each with the count, means and last day of the key's earlier rows, which are all the state a key keeps for good. So
the result doesn't depend on how rows arrive, as long as none is later than the watermark allows; later ones are dropped by the engine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, day date, tie long, conf double, sev double, prior_count long, days_since int, prior_conf double, prior_sev double"
DAY_MS = 86_400_000


def mean(total: int, n: int) -> float:
    """A mean of thousandths to six places, half up, as the batch form has it."""
    return math.floor((total * 2000 + n) / (n * 2)) / 1_000_000 if n else 0.0


class History(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long, last long, conf long, sev long")
        self.waiting = handle.getMapState("waiting", "day long", "rows array<struct<tie: long, conf: double, sev: double>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[tuple]] = {}
        for f in rows:
            for day, tie, conf, sev in zip(f["ms"], f["tie"], f["conf"], f["sev"], strict=True):
                new.setdefault(int(day), []).append((int(tie), float(conf), float(sev)))
        for day, more in new.items():
            held = self.waiting.getValue((day,)) if self.waiting.containsKey((day,)) else None
            self.waiting.updateValue((day,), ([tuple(r) for r in held[0]] + more if held else more,))
            self.handle.registerTimer(day)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = sorted(k[0] for k in self.waiting.keys() if k[0] <= expiredTimerInfo.getExpiryTimeInMs())
        n, last, conf, sev = tuple(self.total.get()) if self.total.exists() else (0, None, 0, 0)
        out = []
        for day in past:
            for tie, c, s in sorted(tuple(r) for r in self.waiting.getValue((day,))[0]):
                out.append((key[0], datetime.fromtimestamp(day / 1000, UTC).date(), tie, c, s, n, (day - last) // DAY_MS if last is not None else 0, mean(conf, n), mean(sev, n)))
                n, last, conf, sev = n + 1, day, conf + round(c * 1000), sev + round(s * 1000)
            self.waiting.removeKey((day,))
        if out:
            self.total.update((n, last, conf, sev))
            yield pd.DataFrame(out, columns=["key", "day", "tie", "conf", "sev", "prior_count", "days_since", "prior_conf", "prior_sev"])

    def close(self) -> None:
        pass


def history_stream(rows: DataFrame, late: str = "14 days") -> DataFrame:
    """A stream (key string, day date, tie long, conf double, sev double) with prior_count, days_since, prior_conf and prior_sev. The session needs the RocksDB state store."""
    timed = rows.withColumn("ts", F.col("day").cast("timestamp")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(History(), OUT, "Append", "EventTime")
