"""Spans found in texts, as columns: array<struct<kind string, start int, end int, base boolean>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def text_of(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then by the order of ``kinds`` (others last), comma-joined."""
    rank = F.array(*[F.lit(k) for k in kinds])

    def key(s: Column) -> Column:
        at = F.array_position(rank, s["kind"])
        return F.struct(s["start"].alias("start"), F.when(at == 0, len(kinds) + 1).otherwise(at).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    def show(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(F.array_sort(F.transform(spans, key)), show), ",")


def digest_columns(spans: str, kinds: list[str]) -> list[Column]:
    """``n_<kind>`` of base spans, base_sha256 and spans."""
    base = F.filter(F.col(spans), lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return [*counts, F.sha2(text_of(base, kinds), 256).alias("base_sha256"), text_of(F.col(spans), kinds).alias("spans")]
