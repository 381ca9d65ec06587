"""Started attempts and what became of them, on streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The outcome of an attempt that never ended within its time: whether it was charged is not known.
UNKNOWN = "UNKNOWN_USAGE"


def _once(rows: DataFrame, ts: str, late: str) -> DataFrame:
    if rows.isStreaming:
        return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(["attempt_id"])
    rest = [c for c in rows.columns if c not in ("attempt_id", ts)]
    first = rows.groupBy("attempt_id").agg(F.min(ts).alias(ts), F.min_by(F.struct(*rest), ts).alias("r") if rest else F.lit(None).alias("r"))
    return first.select("attempt_id", ts, "r.*") if rest else first.select("attempt_id", ts)


def lifecycles(started: DataFrame, finished: DataFrame, limit: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """``started``'s columns, ``ended_at`` and ``outcome`` of each attempt.

    ``started`` has attempt_id and started_at, ``finished`` attempt_id, ended_at and outcome, both times timestamps.  An
    attempt meets its end if that comes within ``limit`` of its start; else it comes out as ``UNKNOWN`` with a null
    end: on a stream once both watermarks, ``late`` behind the newest times, have passed its limit, so state is bounded by
    limit and lateness.  Repeats of an attempt on either side count once: the first to arrive within ``late`` on a
    stream, the earliest in a table.  A null attempt_id meets nothing.  Rows later than the watermark are dropped.
    """
    a, b = _once(started, "started_at", late).alias("a"), _once(finished.select("attempt_id", "ended_at", "outcome"), "ended_at", late).alias("b")
    near = F.expr(f"a.attempt_id = b.attempt_id and b.ended_at >= a.started_at and b.ended_at <= a.started_at + interval {limit}")
    return a.join(b, near, "left_outer").select("a.*", "b.ended_at", F.coalesce("b.outcome", F.lit(UNKNOWN)).alias("outcome"))
