"""JSON trees as relations: one row per node, and differences of two tables of trees as joins on paths."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.storage import Scratch

# A whole number beyond 64 bits is a decimal without places; shorter ones without places were written with some.
_KIND = """case when v is null then 'unreadable' when is_variant_null(v) then 'null' when s like 'OBJECT%' then 'object' when s like 'ARRAY%' then 'array'
  when s = 'STRING' then 'string' when s = 'BOOLEAN' then 'boolean' when s = 'BIGINT' or s rlike 'DECIMAL.(19|[23][0-9]),0.' then 'integer' else 'number' end"""
_VALUE = """case when k = 'unreadable' then raw when k in ('object', 'array', 'null') then null when k = 'number' then cast(cast(v as double) as string)
  else cast(v as string) end"""
_CONTAINER = "kind in ('object', 'array')"


@contextmanager
def _whole_variants(spark: SparkSession) -> Iterator[None]:
    """Variants are written as they are: split into typed columns, 1 comes back as 1.0 beside other numbers."""
    name = "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shred(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, pointer, parent, path, depth, kind, value`` of every node of the JSON in column ``text``.

    ``pointer`` names a node without doubt (keys after "/", "~" and "/" in them as ~0 and ~1), ``path``
    reads like ``a.b[0]``; the root has both empty, and a null parent.  Kinds are object, array,
    string, boolean, integer, number (with a point or exponent), null and, for text that is no JSON (two
    values of one key included), unreadable, which keeps the text as value.  A null text gives no rows.

    One level is exploded at a time and written, with its containers as VARIANT, until a
    level has none, so trees may be of any depth, and a lost task reads one table again.
    """
    keep, levels = Scratch(df.sparkSession, "trees"), []
    nodes = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).cast("string").alias("raw"), F.lit("").alias("pointer"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("path"))
    nodes = nodes.withColumn("v", F.expr("try_parse_json(raw)"))
    while True:
        kinds = nodes.withColumn("s", F.expr("schema_of_variant(v)")).withColumn("k", F.expr(_KIND))
        level = kinds.select(*keys, "pointer", "parent", "path", F.lit(len(levels)).alias("depth"), F.col("k").alias("kind"), F.expr(_VALUE).alias("value"), F.expr("if(k in ('object', 'array'), v, null)").alias("v"))
        with _whole_variants(df.sparkSession):
            level = keep.table(level, f"level-{len(levels)}")
        levels.append(level.drop("v"))
        inner = level.where(_CONTAINER)
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        nodes = df.sparkSession.sql(
            f"""select {", ".join(f"c.`{k}`" for k in keys)}, cast(null as string) as raw, e.value as v, c.pointer as parent,
              concat(c.pointer, '/', if(e.key is null, cast(e.pos as string), replace(replace(e.key, '~', '~0'), '/', '~1'))) as pointer,
              if(e.key is null, concat(c.path, '[', e.pos, ']'), if(c.path = '', e.key, concat(c.path, '.', e.key))) as path
            from {{c}} c, lateral variant_explode(c.v) e""",
            c=inner,
        )


def _side(nodes: DataFrame, keys: list[str], name: str) -> DataFrame:
    return nodes.select(*keys, "pointer", "parent", "path", F.struct("kind", "value").alias(name))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pointer, parent, path, l, r`` of all nodes of two shredded tables; a struct of kind and value for each side, null where missing."""
    a, b = _side(left, keys, "l"), _side(right, keys, "r")
    on = [*keys, "pointer"]
    both = a.join(b.withColumnsRenamed({"parent": "parent_r", "path": "path_r"}), on, "full_outer")
    return both.select(*on, F.coalesce("parent", "parent_r").alias("parent"), F.coalesce("path", "path_r").alias("path"), "l", "r")


def diff(left: DataFrame, right: DataFrame, keys: list[str], text: str, deep: bool = False) -> DataFrame:
    """``keys, path, issue, left_kind, left_value, right_kind, right_value`` where the JSON of two tables differs.

    ``keys`` name a row of either table, null matching nothing.  Issues: ``value``, ``type`` (a number with places is another
    type than one without), ``keys`` (an object's keys differ), ``length`` (an array's) and ``side`` (no such row on one
    side).  Below a node with an issue nothing more is said.  With ``deep`` nodes that one side
    lacks are named themselves, as ``missing``, in place of ``keys`` and ``length``, but not what lies below them.

    One full outer join on key and path finds all; what only follows from an issue above is
    taken out by an anti join of the few rows that differ with their own paths' beginnings.
    """
    a, b = shred(left, keys, text), shred(right, keys, text)
    both = joined(a, b, keys)
    kind = F.when(F.col("l").isNull() | F.col("r").isNull(), F.when(F.col("parent").isNull(), "side").otherwise("missing"))
    issue = kind.when(F.col("l.kind") != F.col("r.kind"), "type").when(~F.col("l.value").eqNullSafe(F.col("r.value")), "value")
    columns = [*keys, "pointer", "path", "issue", F.col("l.kind").alias("left_kind"), F.col("l.value").alias("left_value"), F.col("r.kind").alias("right_kind"), F.col("r.value").alias("right_value"), "parent"]
    found = Scratch(left.sparkSession, "diff").table(both.withColumn("issue", issue).where("issue is not null").select(*columns), "found")
    if not deep:
        above = found.where("issue = 'missing'").select(*keys, F.col("parent").alias("pointer")).distinct()
        on = [*keys, "pointer"]
        holders = a.where(_CONTAINER).join(above, on, "left_semi").join(b.where(_CONTAINER).select(*on, F.col("kind").alias("right_kind")), on).where("kind = right_kind")
        none = F.lit(None).cast("string")
        holders = holders.withColumn("issue", F.expr("if(kind = 'object', 'keys', 'length')"))
        holders = holders.select(*on, "path", "issue", F.col("kind").alias("left_kind"), none.alias("left_value"), "right_kind", none.alias("right_value"), "parent")
        found = Scratch(left.sparkSession, "diff").table(found.where("issue <> 'missing'").unionByName(holders), "found")
    # every beginning of a pointer at a slash names a node above it
    steps = F.split("pointer", "/")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    below = found.where("pointer <> ''").select(*keys, "pointer", F.explode(beginnings).alias("above"))
    cause = found.select(*keys, F.col("pointer").alias("above"))
    follows = below.join(cause, [*keys, "above"], "left_semi").select(*keys, "pointer").distinct()
    return found.join(follows, [*keys, "pointer"], "left_anti").drop("pointer", "parent")
