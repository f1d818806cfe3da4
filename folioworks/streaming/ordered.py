"""Events of each key in order of event time, whatever order they arrive in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: (state before, event) to (state after, values of the output row or None); states and values are JSON's.
Fold = Callable[[Any, dict], tuple[Any, tuple | None]]

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds a key's events by millisecond in the state store, and folds each millisecond's when
    the watermark has passed it: a timer a millisecond, and timers expire in order.

    Events go to the store as they come, an Arrow batch at a time, so a trigger's rows of
    one key are never together in memory."""

    def __init__(self, fold: Fold, names: list[str], idle_ms: int | None):
        self.fold, self.names, self.idle_ms = fold, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "ms long", "events string")
        self.state = handle.getValueState("state", "state string, last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            fresh: dict[int, list[str]] = {}
            for ms, event in zip(batch["ms"], batch["event"]):
                fresh.setdefault(int(ms), []).append(event)
            for ms, events in fresh.items():
                old = json.loads(self.held.getValue((ms,))[0]) if self.held.containsKey((ms,)) else []
                self.held.updateValue((ms,), (json.dumps(old + events),))
                self.handle.registerTimer(ms + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state, last = (json.loads(x[0]), x[1]) if self.state.exists() and (x := self.state.get()) else (None, None)
        out = []
        if self.held.containsKey((now - 1,)):
            events = [json.loads(x) for x in json.loads(self.held.getValue((now - 1,))[0])]
            for event in sorted(events, key=lambda e: (e["us"], e["event_id"])):
                state, row = self.fold(state, event)
                if row is not None:
                    out.append(row)
            last = now - 1
            self.held.removeKey((now - 1,))
            self.state.update((json.dumps(state), last))
            if self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms)
        elif last is not None and self.idle_ms is not None and now >= last + self.idle_ms:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, keys: list[str], columns: list[str], fold: Fold, out: str, delay: str, idle_ms: int | None = None) -> DataFrame:
    """The rows (of the schema `out`) that fold gives over each key's events(ts, event_id, *keys, *columns) in order of (ts, event_id).

    An event's row comes out once the watermark, `delay` behind the latest event, has passed
    it; what comes later than that is dropped by Spark. fold gets the named columns, without
    nulls; integers of any size are exact. With idle_ms, a key's state goes when no event
    came for so long in event time. The session's state store becomes RocksDB, which such
    state needs; a restarted query goes on from its checkpoint."""
    events.sparkSession.conf.set(PROVIDER, ROCKSDB)
    event = F.to_json(F.struct(F.unix_micros("ts").alias("us"), F.col("event_id"), *[F.col(c) for c in {*keys, *columns} - {"event_id"}]))
    rows = events.withWatermark("ts", delay).select(*keys, "ts", F.unix_millis("ts").alias("ms"), event.alias("event"))
    names = [x.split()[0] for x in out.split(",")]
    return rows.groupBy(*keys).transformWithStateInPandas(InOrder(fold, names, idle_ms), out, "Append", "EventTime")
