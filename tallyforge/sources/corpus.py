"""A deterministic benchmark corpus: families of surfaces, cases and tasks, made in tasks from their numbers alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = ("grounded_qa", "structured_extraction", "business_summarization", "robustness")
#: Surfaces and cases of a surface, and the surfaces that are held out; fixed.
SURFACES, CASES, HELD_OUT = 12, 10, (1, 4, 6, 9, 11)
OWNERS, COMPANIES = ("佐藤", "鈴木", "高橋", "田中", "伊藤"), ("青葉商事", "白樺工業", "緑川物産", "朝日精機")
#: By difficulty: the operations that an example declares, and its share of ten cases.
PROFILES = {"easy": (("direct_lookup",), 3), "medium": (("paraphrase_normalization", "direct_lookup"), 3), "hard": (("cross_sentence_composition", "exception_rule_resolution"), 4)}


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def difficulty(case: Column) -> Column:
    """Easy cases first, then medium, then hard ones."""
    top, out = 0, F.lit("hard")
    for name, (_, share) in reversed(list(PROFILES.items())[:-1]):
        top = sum(s for n, (_, s) in PROFILES.items() if list(PROFILES).index(n) <= list(PROFILES).index(name))
        out = F.when(case < top, name).otherwise(out)
    return out


def build(spark: SparkSession, surfaces: int = SURFACES, cases: int = CASES) -> DataFrame:
    """``id, task_type, language, input, gold, metadata``: one example of each task, surface and case.

    Everything follows from the three numbers, so any part of the corpus can be made anywhere, alike.  The default gives
    480 examples, of which the held-out surfaces are the test split.
    """
    n = surfaces * cases
    k = F.col("k")
    rows = spark.range(len(TASKS) * n).select(_pick(TASKS, F.floor(F.col("id") / n)).alias("task_type"), (F.col("id") % n).alias("k"), F.col("id").alias("seq"))
    rows = rows.select("*", F.floor(k / cases).cast("int").alias("surface"), (k % cases).cast("int").alias("case"))
    level = difficulty(F.col("case"))
    operations = F.create_map(*[F.lit(x) for name, (ops, _) in PROFILES.items() for x in (name, ",".join(ops))])
    day = lambda shift: F.date_format(F.date_add(F.lit("2026-04-01").cast("date"), (F.col("k") + shift).cast("int")), "yyyy-MM-dd")
    rows = rows.withColumns({"level": level, "owner": _pick(OWNERS, k), "company": _pick(COMPANIES, k + F.col("surface")), "issued": day(0), "due": day(30), "amount": (k + 1) * 10_000})
    fact = F.format_string("%sは通常%sまでに納品する。ただし緊急の場合は%sが対応を要する。", "company", "due", "owner")
    text = F.format_string("%sの請求書。発行日は%s。金額は%d万円。期限は%s。担当は%s。", "company", "issued", k + 1, "due", "owner")
    minutes = F.format_string("%sは%sまでに%sへ見積を送る。予算を承認。納期の遅れに注意。", "owner", "due", "company")
    quoted = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    unit = lambda i, c: F.struct(F.lit(i).alias("id"), c.alias("text"))
    question = F.format_string("%sの納期はいつですか。", "company")
    qa = (quoted(question.alias("question"), F.array(unit("e1", fact), unit("e2", text)).alias("evidence_units")), quoted(F.lit(True).alias("answerable"), F.col("due").alias("answer"), F.array(F.lit("e1"), F.lit("e2")).alias("evidence"), F.array("due").alias("acceptable_answers")))
    spec = '{"type":"object","required":["company","amount_jpy"],"additionalProperties":false,"properties":{"company":{"type":"string"},"amount_jpy":{"type":"integer"},"issue_date":{"type":"string","format":"date"},"due_date":{"type":["string","null"],"format":"date"}}}'
    expected = quoted("company", F.col("amount").alias("amount_jpy"), F.col("issued").alias("issue_date"), F.col("due").alias("due_date"))
    extraction = (quoted(text.alias("text")), F.concat(F.lit('{"expected":'), expected, F.lit(f',"json_schema":{spec}}}')))
    action = F.struct(F.col("owner").alias("owner"), F.format_string("%sへ見積を送る", "company").alias("action"), F.col("due").alias("deadline"))
    facts = F.array(F.lit("予算を承認"), F.lit("納期の遅れ"), F.col("owner"), F.format_string("%sへ見積を送る", "company"), F.col("due"))
    summary = (quoted(minutes.alias("text")), quoted(minutes.alias("summary"), F.array(F.lit("予算を承認")).alias("decisions"), F.array(F.lit("納期の遅れ")).alias("risks"), F.array(action).alias("action_items"), facts.alias("supported_facts")))
    by_task = lambda i: F.when(F.col("task_type") == "structured_extraction", extraction[i]).when(F.col("task_type") == "business_summarization", summary[i]).otherwise(qa[i])
    ops = F.split(F.element_at(operations, F.col("level")), ",")
    ops = F.when(F.col("task_type").isin("structured_extraction", "business_summarization"), F.when(F.col("level") == "hard", F.array(F.lit("arithmetic_or_normalization"))).otherwise(F.array(F.lit("direct_lookup")))).otherwise(ops)
    ops = F.when((F.col("task_type") == "business_summarization") & (F.col("level") == "hard"), F.array(F.lit("negation_affects_answer"))).otherwise(ops)
    meta = quoted(
        F.lit("generated").alias("source"), F.col("level").alias("difficulty"), F.array(F.lower("task_type")).alias("tags"), F.when(F.col("surface").isin(*HELD_OUT), "test").otherwise("dev").alias("split"),
        F.lit("heldout_template_family").alias("split_policy"), F.concat_ws("_", "task_type", F.col("surface").cast("string")).alias("template_family"), F.concat_ws("_", F.lit("scenario"), F.col("surface").cast("string")).alias("scenario_family"),
        F.concat_ws("_", F.lit("surface"), F.col("surface").cast("string")).alias("surface_form_family"), F.concat_ws("_", F.lit("reasoning"), (k % 9).cast("string")).alias("reasoning_family"), F.lit("3").alias("generator_version"),
        ops.alias("generator_operations"), ops.alias("difficulty_factors"), F.md5(F.concat_ws("/", "task_type", "surface", "level")).alias("structural_signature"), F.col("company").alias("target_entity"), F.lit("memo").alias("document_type"), F.col("issued").alias("document_date"),
    )
    name = F.format_string("%s-%02d-%02d", "task_type", "surface", "case")
    return rows.select(name.alias("id"), "task_type", F.lit("ja").alias("language"), by_task(0).alias("input"), by_task(1).alias("gold"), meta.alias("metadata"))
