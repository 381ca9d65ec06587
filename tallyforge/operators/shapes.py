"""Shapes of outputs as relations: rules are joins of the output's nodes with those of its schema, without Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.outputs import ACTION, EXTRACTION, LISTS, QA_TASKS, SUMMARY
from tallyforge.operators.trees import shred
from tallyforge.storage import Scratch

#: Types of the schema language that a kind of node satisfies; fixed names.
SATISFIES = {"string": ("string",), "integer": ("integer", "number"), "number": ("number",), "boolean": ("boolean",), "array": ("array",), "object": ("object",), "null": ("null",)}


def _name(pointer: str = "pointer") -> Column:
    """The last key of a pointer."""
    return F.replace(F.replace(F.element_at(F.split(pointer, "/"), -1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def _below(nodes: DataFrame, keys: list[str], parent: str, kind: str) -> DataFrame:
    """Children of the nodes at ``parent`` that are of a kind."""
    holders = nodes.where((F.col("pointer") == parent) & (F.col("kind") == kind)).select(*keys)
    return nodes.where(F.col("parent") == parent).join(holders, keys, "left_semi")


def _iso(text: str) -> Column:
    return F.col(text).rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & F.try_to_date(F.col(text), "yyyy-M-d").isNotNull()


def schema_issues(values: DataFrame, schemas: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """``keys, issue`` of objects against the JSON Schemas of their rows; both sides shredded by ``trees.shred``.

    The schema language has required, additionalProperties and properties with type (one or a list) and format
    date, on the first level of fields.  Values that are no objects, and rows without a schema, have no issues here.  Properties
    that are no object are the only issue of their row.
    """
    fields = _below(values, keys, "", "object").select(*keys, _name().alias("field"), F.col("kind").alias("v_kind"), F.col("value").alias("v"))
    objects = values.where("pointer = '' and kind = 'object'").select(*keys).join(schemas.where("pointer = ''").select(*keys), keys, "left_semi")
    bad = schemas.where("pointer = '/properties' and kind <> 'object'").select(*keys).join(objects, keys, "left_semi")
    said = bad.withColumn("issue", F.lit(f"{prefix}: schema properties must be an object"))

    required = _below(schemas, keys, "/required", "array").select(*keys, F.col("value").alias("field")).join(objects, keys, "left_semi")
    missing = required.join(fields, [*keys, "field"], "left_anti").withColumn("issue", F.concat(F.lit(f"{prefix}: missing required field "), "field"))

    full = schemas.where("parent = '/additionalProperties'").select(*keys).distinct().withColumn("full", F.lit(True))
    false = "kind = 'null' or value in ('false', '') or (kind in ('integer', 'number') and cast(value as double) = 0) or (kind in ('object', 'array') and full is null)"
    closed = schemas.where("pointer = '/additionalProperties'").join(full, keys, "left").where(false).select(*keys)
    specs = _below(schemas, keys, "/properties", "object").select(*keys, _name().alias("field"), "pointer", F.col("kind").alias("spec"))
    beyond = fields.join(closed, keys, "left_semi").join(specs, [*keys, "field"], "left_anti").withColumn("issue", F.concat(F.lit(f"{prefix}: unexpected field "), "field"))

    # what a property's spec says: its type as a text, or the list's texts in order, and its format
    inner = schemas.where("depth = 3 and path like 'properties%'")
    own = inner.select(*keys, F.col("parent").alias("pointer"), _name().alias("what"), "kind", "value")
    says = own.groupBy(*keys, "pointer").agg(
        F.max(F.when((F.col("what") == "type") & (F.col("kind") == "string"), F.col("value"))).alias("one"), F.max(F.when((F.col("what") == "type") & (F.col("kind") == "array"), F.lit(True))).alias("listed"),
        F.max(F.when((F.col("what") == "format") & (F.col("kind") == "string"), F.col("value"))).alias("format"),
    )
    options = schemas.where("depth = 4 and path like 'properties%'").select(*keys, F.regexp_extract("parent", "^(.*)/([^/]*)$", 1).alias("pointer"), F.regexp_extract("parent", "([^/]*)$", 1).alias("what"), _name().cast("int").alias("i"), "value")
    many = options.where("what = 'type'").groupBy(*keys, "pointer").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("many"))
    rules = specs.join(says, [*keys, "pointer"], "left").join(many, [*keys, "pointer"], "left")
    held = fields.join(rules, [*keys, "field"])
    allowed = F.when(F.col("listed"), F.coalesce("many", F.array().cast("array<string>"))).otherwise(F.array("one"))
    fits = reduce(lambda a, b: a | b, [(F.col("v_kind") == kind) & F.arrays_overlap(allowed, F.array(*[F.lit(t) for t in types])) for kind, types in SATISFIES.items()])
    shown = F.when(F.col("listed"), F.concat(F.lit("["), F.array_join(F.transform(allowed, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))).otherwise(F.coalesce("one", F.lit("None")))
    at = F.concat(F.lit(f"{prefix}."), "field")
    issue = F.when(F.col("spec") != "object", F.concat(F.lit(f"{prefix}: schema for "), "field", F.lit(" must be an object"))).when(~F.coalesce(fits, F.lit(False)), F.concat(at, F.lit(": expected "), shown))
    issue = issue.when((F.col("v_kind") != "null") & (F.col("format") == "date") & ~F.coalesce(_iso("v"), F.lit(False)), F.concat(at, F.lit(": malformed date")))
    wrong = held.withColumn("issue", issue).where("issue is not null")

    found = reduce(DataFrame.unionByName, [x.select(*keys, "issue") for x in (missing, beyond, wrong)])
    return found.join(bad, keys, "left_anti").unionByName(said.select(*keys, "issue"))


def output_issues(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, issue`` of each output's shape for its task; ``df`` has task_type, gold and output (JSON texts).

    ``keys`` tell rows apart.  An output that is no object (null, too) has ``output_must_be_object`` as its only issue.
    """
    keep, names = Scratch(df.sparkSession, "shapes"), keys
    keys = [f"__key_{n}" for n in range(len(names))]  # so that none is named like a column in here
    df = df.select(*[F.col(a).alias(b) for a, b in zip(names, keys, strict=True)], "task_type", "gold", "output")
    rows = df.select(*keys, "task_type", "output", F.get_json_object("gold", "$.json_schema").alias("schema"), F.get_json_object("gold", "$.schema_required").alias("listed"))
    nodes = keep.table(shred(rows, [*keys, "task_type"], "output"), "output")
    schemas = shred(rows.where((F.col("task_type") == EXTRACTION) & F.col("schema").startswith("{")), keys, "schema")
    objects = nodes.where("pointer = '' and kind = 'object'").select(*keys)
    no_object = rows.join(objects, keys, "left_anti").select(*keys, F.lit("output_must_be_object").alias("issue"))

    of = lambda *tasks: nodes.where(F.col("task_type").isin(*tasks)).drop("task_type").join(objects, keys, "left_semi")
    at = lambda name, what: F.max(F.when(F.col("pointer") == f"/{name}", F.col(what)))

    def told(n: DataFrame, names: tuple[str, ...], rules: dict[str, Column]) -> DataFrame:
        per = n.groupBy(*keys).agg(*[at(f, "kind").alias(f) for f in names], at("confidence", "value").alias("number"))
        return per.select(*keys, F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), issue) for issue, rule in rules.items()]))).alias("issue"))

    kind = lambda name, *kinds: F.col(name).isin(*kinds)
    answers = told(of(*QA_TASKS), ("answer", "citations", "abstain", "confidence"), {
        "answer_must_be_string": kind("answer", "string"), "citations_must_be_list": F.col("citations").isNull() | kind("citations", "array"),
        "abstain_must_be_boolean": F.col("abstain").isNull() | kind("abstain", "boolean"),
        "confidence_must_be_number_between_0_and_1": kind("confidence", "boolean") | (kind("confidence", "integer", "number") & F.col("number").try_cast("double").between(0, 1)),
    })
    summary = of(SUMMARY)
    lists = told(summary, ("summary", *LISTS), {
        **{f"missing_{f}": F.col(f).isNotNull() for f in ("summary", *LISTS)}, "summary_must_be_string": F.col("summary").isNull() | kind("summary", "string"),
        **{f"{f}_must_be_list": F.col(f).isNull() | kind(f, "array") for f in LISTS},
    })
    items = _below(summary, keys, "/action_items", "array").select(*keys, _name().alias("i"), F.col("pointer").alias("item"), F.col("kind").alias("item_kind"))
    parts = summary.where("depth = 3 and pointer like '/action_items/%'").groupBy(*keys, F.col("parent").alias("item")).agg(*[F.max(F.when(_name() == f, F.col("kind"))).alias(f) for f in ACTION])
    each = items.join(parts, [*keys, "item"], "left")
    named = lambda text: F.concat(F.lit("action_items_"), "i", F.lit(text))
    ok = F.col("item_kind") == "object"
    late = F.col("deadline").isNotNull() & ~kind("deadline", "string", "null")
    texts = [F.when(~ok, named("_must_be_object")), *[F.when(ok & F.col(f).isNull(), named(f"_missing_{f}")) for f in ACTION], F.when(ok & late, named("_deadline_must_be_string_or_null"))]
    actions = each.select(*keys, F.explode(F.array_compact(F.array(*texts))).alias("issue"))

    extraction = of(EXTRACTION)
    typed = schema_issues(extraction, keep.table(schemas, "schema"), keys, "output")
    plain = rows.where((F.col("task_type") == EXTRACTION) & ~F.coalesce(F.col("schema").startswith("{"), F.lit(False))).join(objects, keys, "left_semi")
    plain = plain.select(*keys, F.explode(F.from_json("listed", "array<string>")).alias("field"))
    fields = extraction.where("parent = ''").select(*keys, _name().alias("field"))
    bare = plain.join(fields, [*keys, "field"], "left_anti").select(*keys, F.concat(F.lit("missing_"), "field").alias("issue"))
    found = reduce(DataFrame.unionByName, [no_object, answers, lists, actions, typed, bare])
    return found.withColumnsRenamed(dict(zip(keys, names, strict=True)))
