"""A rate limiter with state per provider: cooldown, rolling limit per role, daily cap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = T.StructType([T.StructField(n, t) for n, t in (("provider", T.StringType()), ("role", T.StringType()), ("ts", T.TimestampType()), ("allowed", T.BooleanType()), ("reason", T.StringType()))])


class Limiter(StatefulProcessor):
    """State: the last call's time, the recent calls' times per role, the day's count.
    A new day resets the count and keeps the others. Calls of a batch are taken in the
    order of their times; a refused call leaves the state as it is."""

    def __init__(self, cooldown_s: float, per_span: int, span_s: float, per_day: int, hard_cap: int) -> None:
        self.cooldown, self.per_span, self.span = cooldown_s, per_span, span_s
        self.cap = min(per_day, hard_cap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double")
        self.day = handle.getValueState("day", "day string, n int")
        self.recent = handle.getMapState("recent", "role string", "times array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["ts", "role"])
        last = self.last.get()[0] if self.last.exists() else None
        day, count = self.day.get() if self.day.exists() else ("", 0)
        seen: dict[str, list[float]] = {}
        out = []
        for role, ts in zip(calls["role"], calls["ts"]):
            t, today = ts.timestamp(), str(ts.date())
            if today != day:
                day, count = today, 0
            if role not in seen:
                seen[role] = list(self.recent.getValue((role,))[0]) if self.recent.containsKey((role,)) else []
            seen[role] = [x for x in seen[role] if x > t - self.span]
            why = "daily cap" if count >= self.cap else "cooldown" if last is not None and t - last < self.cooldown else "rolling limit" if len(seen[role]) >= self.per_span else ""
            if not why:
                last, count = t, count + 1
                seen[role].append(t)
            out.append((key[0], role, ts, not why, why))
        if last is not None:
            self.last.update((last,))
        self.day.update((day, count))
        for role, times in seen.items():
            self.recent.updateValue((role,), (times,))
        yield pd.DataFrame(out, columns=["provider", "role", "ts", "allowed", "reason"])

    def close(self) -> None:
        pass


def limited(calls: DataFrame, cooldown_s: float, per_span: int, span_s: float, per_day: int, hard_cap: int) -> DataFrame:
    """A stream of calls (provider, role, ts) with the limiter's verdict. Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return calls.groupBy("provider").transformWithStateInPandas(
        statefulProcessor=Limiter(cooldown_s, per_span, span_s, per_day, hard_cap), outputStructType=OUT, outputMode="Append", timeMode="None"
    )
