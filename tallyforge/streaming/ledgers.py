"""Budget ledgers on streams whose calls may come late and in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.functions import ledger as lg
from tallyforge.operators.ledger import CALL, _value

#: The state store that keeps maps and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "key {kind}, seq long, rejected string, cap long, violations array<string>"
_STATE = "calls long, input long, output long, latency double, cost double, unknown boolean, reported boolean, overrun array<string>, last long"
_NAMES = [x.split()[0] for x in _STATE.split(", ")][:-1]
_HELD = "estimate long, most_output long, input long, output long, latency double, cost double, reported boolean"

_KINDS = [tuple(x.split()) for x in _HELD.split(", ")]


def _typed(x, kind: str):
    """Pandas gives whole numbers beside nulls as floats, which a state of longs would lose."""
    return None if _value(x) is None else {"long": int, "double": float, "boolean": bool}[kind](x)


class _Replay(StatefulProcessor):
    """A key's ledger, and the calls that the watermark has not passed, by time and sequence."""

    def __init__(self, limits: lg.Limits, idle_ms: int):
        self.limits, self.idle = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ledger = handle.getValueState("ledger", _STATE)
        self.held = handle.getMapState("held", "at long, seq long", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for c in part.to_dict("records"):
                at = int(c["at"])
                place = (at, int(c["seq"]))
                if not self.held.containsKey(place):
                    self.held.updateValue(place, tuple(_typed(c[k], kind) for k, kind in _KINDS))
                    self.handle.registerTimer(at)
        yield pd.DataFrame(columns=["key", "seq", "rejected", "cap", "violations"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All calls up to the timer are there: what comes later with such a time is dropped by the watermark."""
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        due = sorted(k for k in self.held.keys() if k[0] <= now)
        ledger, last = lg.Ledger(self.limits), None
        if self.ledger.exists():
            *kept, last = self.ledger.get()
            for name, x in zip(_NAMES, kept, strict=True):
                setattr(ledger, name, list(x) if name == "overrun" else x)
        for k in due:
            c = dict(zip(CALL, self.held.getValue(tuple(k)), strict=True))
            why, cap = ledger.admission(int(c["estimate"]), c["most_output"])
            found = [] if why else ledger.complete(c["input"], c["output"], c["latency"], c["cost"], bool(c["reported"]))
            out.append((key[0], k[1], why, cap, found))
            self.held.removeKey(tuple(k))
            last = k[0]
        if due:
            kept = lg.state(ledger)
            self.ledger.update((*(kept[name] for name in _NAMES), last))
            self.handle.registerTimer(last + self.idle)
        elif last is not None and now >= last + self.idle and not any(True for _ in self.held.keys()):
            self.ledger.clear()
        yield pd.DataFrame(out, columns=["key", "seq", "rejected", "cap", "violations"]).astype({"cap": "Int64", "seq": "int64"})

    def close(self) -> None:
        pass


def replay_late(calls: DataFrame, key: str, ts: str, limits: lg.Limits, late: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """``key, seq, rejected, cap, violations``: each call's decision in the order of (``ts``, seq), however the calls arrive.

    ``calls`` is a stream with ``key``, ``ts`` (timestamp), ``seq`` and the columns of ``operators.ledger.replay``.  A call is
    held until the watermark, ``late`` behind the newest ``ts`` of all, has passed it: then none can come before
    it, and it is decided.  Calls that come later than that are dropped; repeats (same ts and seq) while the first is held
    count once.  A ledger that has had no call for ``idle_ms`` is forgotten.  Times count in milliseconds.

    The session must keep its state in ``PROVIDER`` (spark.sql.streaming.stateStore.providerClass).
    """
    at = F.unix_millis(F.col(ts)).alias("at")
    rows = calls.withWatermark(ts, late).select(F.col(key).alias("key"), ts, at, "seq", *CALL)
    kind = calls.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(_Replay(limits, idle_ms), DECISIONS.format(kind=kind), "Append", "EventTime")
