"""Search sessions as a stream: each with a budget of calls, the results that it has seen, and an end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWER = "session string, at timestamp, used int, left int, ok boolean, fresh array<string>"


class Sessions(StatefulProcessor):
    """State of a session: when it began, the calls it made, and the ids that it has seen, an entry each.

    A timer ends it; a call that comes after the end begins a new session of that name.
    """

    def __init__(self, budget: int, ttl: float):
        self.budget, self.ttl = budget, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "began long, used int")
        self.seen = handle.getMapState("seen", "id string", "n int")

    def _clear(self) -> None:
        self.state.clear()
        self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["at", "call"])
        began, used = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for at, ids in zip(calls["at"], calls["ids"], strict=True):
            now = int(at.timestamp() * 1000)
            if began is not None and now - began > self.ttl * 1000:
                self._clear()
                began, used = None, 0
            if began is None:
                began = now
                self.handle.registerTimer(began + int(self.ttl * 1000) + 1)
            ok = used < self.budget
            fresh = []
            if ok:
                used += 1
                for i in ids if ids is not None else []:
                    if not self.seen.containsKey((i,)):
                        self.seen.updateValue((i,), (1,))
                        fresh.append(i)
            out.append((key[0], at, used, self.budget - used, ok, fresh))
        self.state.update((began, used))
        yield pd.DataFrame(out, columns=["session", "at", "used", "left", "ok", "fresh"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and expiredTimerInfo.getExpiryTimeInMs() > self.state.get()[0] + self.ttl * 1000:
            self._clear()
        yield from ()

    def close(self) -> None:
        pass


def spend(calls: DataFrame, budget: int = 20, ttl: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """A stream's calls (session, call, at timestamp, ids array<string>) with what each may give: rows (session, at, used, left, ok, fresh).

    fresh are the ids that the session has not seen; a call beyond the budget is refused and gives none. Sessions end ttl
    seconds after they began, by event time. The stream needs the RocksDB state store.
    """
    timed = calls.withWatermark("at", late)
    return timed.groupBy("session").transformWithStateInPandas(Sessions(budget, ttl), ANSWER, "append", "eventTime")


def spent(calls: DataFrame, budget: int = 20) -> DataFrame:
    """The same of a finished table of calls, all within one session's time: rows (session, call, used, left, ok, fresh)."""
    order = Window.partitionBy("session").orderBy("at", "call")
    numbered = calls.withColumn("n", F.row_number().over(order)).withColumn("ok", F.col("n") <= budget)
    shown = numbered.where("ok").select("session", "call", "n", F.posexplode("ids").alias("place", "id"))
    first = shown.withColumn("_f", F.row_number().over(Window.partitionBy("session", "id").orderBy("n", "place"))).where("_f = 1")
    fresh = first.groupBy("session", "call").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("fresh"))
    none = F.array().cast("array<string>")
    used = F.least("n", F.lit(budget))
    return numbered.join(fresh, ["session", "call"], "left").select("session", "call", used.alias("used"), (budget - used).alias("left"), "ok", F.coalesce("fresh", none).alias("fresh"))
