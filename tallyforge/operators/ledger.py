"""Budget ledgers over tables and streams of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import ledger as lg

_DECISION = T.StructType().add("rejected", T.StringType()).add("cap", T.LongType()).add("violations", T.ArrayType(T.StringType()))
_LONG, _DOUBLE = ("attempts", "used_input", "used_output", "exact_total", "overrun_tokens", "rejected"), ("used_latency", "used_cost", *(f"left_{r}" for r in lg.RESOURCES))
_SUMMARY = T.StructType()
for _name in _LONG:
    _SUMMARY = _SUMMARY.add(_name, T.LongType())
for _name in _DOUBLE:
    _SUMMARY = _SUMMARY.add(_name, T.DoubleType())
_SUMMARY = _SUMMARY.add("overrun", T.ArrayType(T.StringType())).add("unknown_usage", T.BooleanType()).add("may_call", T.BooleanType()).add("decisions", T.ArrayType(_DECISION))
CALL = ("estimate", "most_output", "input", "output", "latency", "cost", "reported")


def admit(calls: DataFrame, keys: list[str], order: list[str], est: str, act: str, cap: int) -> DataFrame:
    """``keys, calls, admitted, used, overrun`` of each sequence of calls under one ceiling of tokens.

    A call is admitted if no overrun came before and something of the cap stays above its
    estimate; a rejected call consumes nothing, an admitted one what it really took, and taking
    more than the cap blocks what follows.  That makes each decision depend on all before it, so
    it is a fold over the sorted calls of a key, not a running sum.  The calls of one key are
    one ledger, which a budget bounds.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("admitted"), F.lit(False).alias("overrun"))

    def step(state: F.Column, call: F.Column) -> F.Column:
        go = ~state["overrun"] & (F.lit(cap) - state["used"] - call["est"] > 0)
        used = state["used"] + F.when(go, call["act"]).otherwise(0)
        return F.struct(used.cast("long").alias("used"), (state["admitted"] + go.cast("long")).alias("admitted"), (state["overrun"] | (used > cap)).alias("overrun"))

    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(est).cast("long").alias("est"), F.col(act).cast("long").alias("act"))))
    folded = calls.groupBy(*keys).agg(rows.alias("__rows")).select(*keys, F.size("__rows").cast("long").alias("calls"), F.aggregate("__rows", start, step).alias("__s"))
    return folded.select(*keys, "calls", "__s.admitted", "__s.used", "__s.overrun")


def _value(x):
    return None if x is None or x != x else x


def replay(calls: DataFrame, keys: list[str], order: list[str], limits: lg.Limits) -> DataFrame:
    """``keys`` and the summary of each ledger, with its decisions in order.

    Needs ``estimate, most_output, input, output`` (tokens, null where unknown), ``latency, cost, reported``.  Each
    decision depends on all before it, so the calls of a key are folded in order; a ledger is one example's, so
    they are few.  Ledgers without any call don't appear.
    """

    sorted_calls = F.array_sort(F.collect_list(F.struct(*order, *CALL)))
    folded = calls.groupBy(*keys).agg(sorted_calls.alias("__calls"))
    return folded.select(*keys, F.pandas_udf(_fold(limits), _SUMMARY)("__calls").alias("s")).select(*keys, "s.*")


def _fold(limits: lg.Limits):
    def fold(rows: pd.Series) -> pd.DataFrame:
        out = [lg.run(limits, [{k: _value(c[k]) for k in CALL} for c in calls]) for calls in rows]
        return pd.DataFrame([[r[f.name] for f in _SUMMARY] for r in out], columns=[f.name for f in _SUMMARY], dtype=object)

    return fold


def replay_stream(calls: DataFrame, key: str, limits: lg.Limits) -> DataFrame:
    """``key, seq, rejected, cap, violations``: each call's decision, on a stream whose calls come in order per key.

    The state of a key is its ledger, some numbers.
    """
    fields = "calls long, input long, output long, latency double, cost double, unknown boolean, reported boolean, overrun array<string>"
    names = [f.split()[0] for f in fields.split(", ")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ledger = lg.Ledger(limits)
        if state.exists:
            for name, x in zip(names, state.get, strict=True):
                setattr(ledger, name, list(x) if name == "overrun" else x)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for c in rows.to_dict("records"):
            why, cap = ledger.admission(int(c["estimate"]), _value(c["most_output"]))
            found = [] if why else ledger.complete(_value(c["input"]), _value(c["output"]), c["latency"], c["cost"], bool(c["reported"]))
            out.append((k[0], c["seq"], why, cap, found))
        kept = lg.state(ledger)
        state.update(tuple(kept[name] for name in names))
        yield pd.DataFrame(out, columns=["key", "seq", "rejected", "cap", "violations"])

    return calls.groupBy(key).applyInPandasWithState(step, "key long, seq long, rejected string, cap long, violations array<string>", fields, "append", "NoTimeout")
