"""Mixing sources to target weights, in DataFrame functions only.

Sizes are aggregated per source, each source gets a target by capped proportional sharing,
and a document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with
probability equal to the fraction, where ``rate`` is target / source size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.stages import free_name

#: Fixed: a word is a run of anything but space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Fixed: 13 hex digits of MD5 are 52 bits, exact in a double.
HASH_DIGITS = 13
#: Equal rows that are made again at a time.
COPIES = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``copy`` that numbers equal rows from 1, so that each can draw for itself.

    Equal rows are counted before the shuffle and made again behind it, some at a time, so none are gathered.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    some = counted.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    each = F.sequence(F.col("some") * COPIES + 1, F.least(F.col("copies"), (F.col("some") + 1) * COPIES))
    return some.withColumn("copy", F.explode(each)).drop("copies", "some")


def source_targets(sizes: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Sources in code-point order, null last, take the weights in turn.  All of them share the
    total size by weight; none gets more than ``cap`` times its own size, and what is above
    goes to the others by weight until none is above.  That sharing has a closed form: with
    sources in order of cap / weight, a source is capped exactly if its cap is below its share
    of what the capped sources before it have left.  The window runs over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.select("source", "source_size", F.element_at(table, ((rank - 1) % len(weights) + 1).cast("int")).alias("w"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.select(
        "source", "source_size", "w",
        ((total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap)) / F.sum("w").over(after)).alias("level"),
        (F.col("source_size") * F.lit(cap)).alias("most"),
        F.row_number().over(by_ratio).alias("k"),
    )
    capped = F.col("most") <= F.col("level") * F.col("w")
    per = per.withColumn("is_capped", capped)
    # the level of those not capped is the one at the first of them
    first = F.min(F.when(~F.col("is_capped"), F.struct("k", "level"))).over(
        Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return per.select(
        "source", "source_size",
        F.when(F.col("is_capped"), F.col("most")).otherwise(F.col("w") * first["level"]).alias("target"),
    )


def mix(docs: DataFrame, weights: list[float] = (1, 2, 3), cap: float = 3.0, seed: int = 7, key: Column | None = None, size: str | None = None) -> DataFrame:
    """Every row of ``docs`` (needs doc_id, source and text, or its size) with its repetitions.

    Adds ``mix_size, mix_source_size, mix_target, mix_rate, mix_copies``; other columns stay,
    save that earlier columns of these names are replaced.  Null text has size 0, a null
    source is a source of its own, sources of size 0 get target and rate 0, a null doc_id
    hashes as the word null, repeated rows get equal copies, an empty table gives no rows.
    ``size`` names a column that has the words already; otherwise texts are counted twice over.
    Rows of equal ``key`` (doc_id, as the SQL has it, if none is given) share a draw.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
    sized = docs.withColumn("mix_size", F.col(size).cast("long") if size else word_count(F.col("text")))
    targets = source_targets(sized.select("source", F.col("mix_size").alias("size")), list(weights), cap)
    targets = targets.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("mix_rate", rate)
    extra = (unit_hash(F.col("doc_id") if key is None else key, seed) < F.col("mix_rate") - F.floor("mix_rate")).cast("int")
    return joined.withColumn("mix_copies", (F.floor("mix_rate") + extra).cast("int"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy of each document of ``mix``'s result, without the added columns."""
    added = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
    columns = [c for c in mixed.columns if c not in added]
    copy = F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias(free_name(mixed, "copy"))
    return mixed.where("mix_copies > 0").select(*columns, copy).select(*columns)
