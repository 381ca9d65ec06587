"""Scores and failures of outputs; the SQL computes them from the orders' keys, without JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import outputs
from tallyforge.operators import failures, scoring, shapes
from tallyforge.plans.examples import ORDERS_CTE, examples, failed_examples
from tallyforge.plans.registry import register

# what an answer scores: answerable, k % 5, exact match, token F1, citation precision, recall and F1, unsupported, abstains, task score
_QA = """answers(answerable, r, em, f1, cp, cr, cf, un, ab, score) as (values
  (true, 0, 1, 1, 1, 1, 1, 0, 0, 1.0::double), (true, 1, 1, 1, 0.5, 1, 2.0::double / 3, 0, 0, 11.0::double / 12), (true, 2, 1, 1, 0, 0, 0, 0, 0, 0.75), (true,
    3, 0, 0, 0, 0, 0, 0, 1, 0), (true, 4, 0, 0, 0, 0, 0, 1, 0, 0),
  (false, 0, 0, 0, 0, 0, 0, 0, 0, 0), (false, 1, 0, 0, 0, 0, 0, 0, 0, 0), (false, 2, 0, 0, 1, 1, 1, 1, 0, 0), (false, 3, 1, 1, 1, 1, 1, 0, 1, 1), (false, 4, 0,
    0, 0, 0, 0, 1, 0, 0)),
qa as (select o.*, a.*, case when k % 5 = 1 and k % 11 = 1 then 0 else 1 end as valid from o join answers a on a.answerable = (k % 7 <> 0) and a.r = k % 5 where k % 4 in (0, 3))"""
_EX = """ex as (select *, (valid + (2.0::double + amt + ren) / 4 + amt + 1) / 4 as score from (select *, case when k % 3 = 2 then 0 else 1 end as amt, case when k % 5 = 2 then 0 else 1 end as ren,
  case when k % 3 <> 0 and k % 5 not in (1, 3) then 1 else 0 end as valid, case when k % 3 = 1 and k % 5 = 4 then 1 else 0 end as em, case when k % 5 = 3 then 1 else 0 end as extra from o where k % 4 = 1))"""
_SU = """su as (select *, (2.0::double + dec + act + cov) / 5 as score from (select *, case k % 3 when 0 then 1.0::double when 1 then 2.0::double / 3 else 0 end as dec,
  2.0::double * (case when k % 3 <> 1 then 1 else 0 end + case when k % 5 = 1 then 1 else 0 end) / (3 + case when k % 5 = 1 then 1 else 0 end) as act,
  case when k % 5 = 1 then 1.0::double else 2.0::double / 3 end as own,
    (1.0::double + case when k % 3 <> 2 or k % 5 = 1 then 1 else 0 end + case when k % 3 = 0 and k % 7 <> 0 then 1 else 0 end) / 3 as cov,
  case when k % 5 = 0 then 1 else 0 end as em from o where k % 4 = 2))"""
_ALL = f"{ORDERS_CTE}, {_QA}, {_EX}, {_SU}"


def _metrics(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select("example_id", *[F.round(F.element_at("scores", F.lit(metric)), 6).alias(name) for name, metric in names.items()])


def _doubles(names: dict[str, str], values: list[str]) -> str:
    return ", ".join(f"round(({x})::double, 6) as {name}" for name, x in zip(names, values, strict=True))


_QA_NAMES = {x: x for x in ("exact_match", "token_f1", "citation_precision", "citation_recall", "citation_f1", "unsupported_answer_claims_heuristic", "predicted_abstain", "should_abstain", "abstention_correct", "schema_compliance", "task_score")}
_QA_VALUES = ["em", "f1", "cp", "cr", "cf", "un", "ab", "case when answerable then 0 else 1 end", "case when (ab = 1) = not answerable then 1 else 0 end", "valid", "score"]


@register("scored_answers", f"with {_ALL} select k as example_id, {_doubles(_QA_NAMES, _QA_VALUES)} from qa")
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(scoring.score(examples(spark, sf_dir).where(F.col("task_type").isin(*outputs.QA_TASKS))), _QA_NAMES)


@register("robustness_errors", f"""
with {_ALL} select k as example_id, 'robustness_error_tag_' || unnest(case k % 3 when 0 then ['negation'] when 1 then ['era', 'long_context'] else ['plain'] end) as metric, round(1 - score, 6) as value from qa where k % 4 = 3""")
def robustness_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.score(examples(spark, sf_dir).where("task_type = 'robustness'")).select("example_id", F.explode("scores").alias("metric", "value"))
    return rows.where(F.col("metric").startswith("robustness_error_tag_")).withColumn("value", F.round("value", 6))


_EX_NAMES = {x: x for x in ("field_exact_match_mean", "numeric_field_accuracy", "date_field_accuracy", "hallucinated_field_count", "exact_match", "json_schema_validity", "task_score")}
_EX_VALUES = ["(2.0::double + amt + ren) / 4", "amt", "1", "extra", "em", "valid", "score"]


@register("scored_extractions", f"with {_ALL} select k as example_id, {_doubles(_EX_NAMES, _EX_VALUES)} from ex")
def scored_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(scoring.score(examples(spark, sf_dir).where("task_type = 'structured_extraction'")), _EX_NAMES)


_SU_NAMES = {x: x for x in (*outputs.COMPONENTS[outputs.SUMMARY], "task_score")}
_SU_VALUES = ["dec", "act", "own", "own", "1", "cov", "em", "em", "score"]


@register("scored_summaries", f"with {_ALL} select k as example_id, {_doubles(_SU_NAMES, _SU_VALUES)} from su")
def scored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(scoring.score(examples(spark, sf_dir).where("task_type = 'business_summarization'")), _SU_NAMES)


_SCORED = "scored as (select k, em, score, valid from qa union all select k, em, score, valid from ex union all select k, em, score, 1 from su)"
_FAILED = {x: x for x in ("json_parse_success", "schema_compliance", "schema_validity", "json_schema_validity", "exact_match", "task_score")}
_FAILED_VALUES = ["case when k % 3 = 0 then 0 else 1 end", "0", "0", "case when k % 4 = 1 then 0 end", "case when k % 3 = 2 then em end", "case when k % 3 = 2 then score else 0 end"]


@register("failed_output_scores", f"with {_ALL}, {_SCORED} select k as example_id, {_doubles(_FAILED, _FAILED_VALUES)} from scored")
def failed_output_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(scoring.score(failed_examples(spark, sf_dir)), _FAILED)


@register("component_names", """
select t as task_type, list_sort(list_distinct(m)) as names from (values
  ('grounded_qa', ['exact_match', 'token_f1', 'citation_precision', 'citation_recall', 'citation_f1', 'citation_correctness', 'evidence_coverage',
    'unsupported_answer_claims_heuristic', 'unsupported_claim_rate_heuristic', 'predicted_abstain', 'should_abstain', 'abstention_correct',
    'over_abstention_rate', 'under_abstention_rate']),
  ('structured_extraction', ['field_exact_match_mean', 'numeric_field_accuracy', 'date_field_accuracy', 'hallucinated_field_count', 'exact_match']),
  ('business_summarization', ['decision_extraction_correctness', 'action_item_correctness', 'owner_correctness', 'deadline_correctness', 'risk_extraction_correctness', 'supported_fact_coverage', 'exact_match', 'token_f1'])) x(t, m)""")
def component_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components that failed outputs of each task leave null, from the scores themselves."""
    rows = scoring.score(failed_examples(spark, sf_dir).where("task_type <> 'robustness'")).select("task_type", F.explode("scores").alias("metric", "value")).where("value is null")
    return rows.groupBy("task_type").agg(F.array_sort(F.collect_set("metric")).alias("names"))


_LABELS = """labels as (
  select k, 'UNKNOWN_PROVIDER_USAGE' as label from o where k % 13 = 0 union all select k, 'INTERRUPTED_TRAJECTORY' from o where k % 17 = 0 union all
  select k, 'SCHEMA_FAILURE' from scored where valid = 0 union all
  select k, 'OVER_ABSTENTION' from qa where answerable and ab = 1 union all select k, 'UNDER_ABSTENTION' from qa where not answerable and ab = 0 union all
  select k, 'WRONG_CITATION' from qa where cp < 1 union all select k, 'MISSED_EVIDENCE' from qa where answerable and ab = 0 and cr < 1 union all
  select k, 'HALLUCINATION' from qa where answerable and ab = 0 and score < 1 union all
  select k, 'NUMERIC_ERROR' from ex where score < 1 and (k % 3 <> 1 or ren = 0) union all
  select k, 'NEGATION_ERROR' from scored where score < 1 and k % 3 = 0 union all select k, 'DATE_NORMALIZATION_ERROR' from scored
    where score < 1 and k % 3 = 1 union all
  select k, 'MAJORITY_WRONG' from facts where strategy = 'multi_agent_debate' and score < 1 and best >= 1 union all
  select k, 'PEER_ERROR_PROPAGATION' from facts where strategy = 'multi_agent_debate' and score < 1 and k % 4 = 2 union all
  select k, 'CRITIC_REGRESSION' from facts where strategy = 'critic_reviser' and score < first union all
  select k, 'ROUTER_UNDER_ESCALATION' from facts where strategy = 'adaptive_router' and k % 8 < 4 and score < 1 union all
  select k, 'ROUTER_OVER_ESCALATION' from facts where strategy = 'adaptive_router' and k % 8 >= 4 and first >= score)"""
_FACTS = """facts as (select s.k, o.strategy, s.score, case when s.k % 4 = 1 then 1.0::double when s.k % 4 = 2 then 0.2::double when s.k % 7 = 0 then 0.0::double else 1.0::double end as best,
  case when s.k % 4 = 1 then case when s.k % 2 = 0 then 1.0::double else 0.6875::double end when s.k % 4 = 2 then 0.2::double when s.k % 7 = 0 then 0.0::double when s.k % 3 = 0 then 1.0::double else 0.25::double end as first from scored s join o on s.k = o.k)"""


@register("failure_labels", f"with {_ALL}, {_SCORED}, {_FACTS}, {_LABELS} select k as example_id, label from labels")
def failure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.annotate(examples(spark, sf_dir), ["example_id"])


@register("failure_by_task", f"""
with {_ALL}, {_SCORED}, {_FACTS}, {_LABELS} select o.task_type, label, count(*) as n, count(*) filter (where o.strategy = 'adaptive_router') as routed from labels join o on o.k = labels.k group by o.task_type, label""")
def failure_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = failures.annotate(examples(spark, sf_dir), ["example_id", "strategy", "task_type"])
    return rows.groupBy("task_type", "label").agg(F.count("*").alias("n"), F.count_if(F.col("strategy") == "adaptive_router").alias("routed"))


@register("output_schema_issues", f"""
with {_ALL}, listed as (
  select k, 'confidence_must_be_number_between_0_and_1' as issue from qa where valid = 0 union all
  select k, 'output.amount_jpy: expected [''integer'', ''null'']' from ex where k % 3 = 0 union all
  select k, 'output.issue_date: malformed date' from ex where k % 5 = 1 union all
  select k, 'output: unexpected field note' from ex where k % 5 = 3)
select k as example_id, issue from listed""")
def output_schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.output_issues(examples(spark, sf_dir), ["example_id"])


@register("parsed_outputs", f"""
with {_ALL}, {_SCORED} select k as example_id, case when k % 3 = 2 or (k % 3 = 1 and k % 2 = 0) or valid = 0 then 'PARSE_ERROR' when k % 3 = 0 then 'OK' else 'REPAIRED' end as status from scored""")
def parsed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("example_id")
    raw = F.when(k % 3 == 0, F.col("output")).when(k % 3 == 2, F.lit("no braces here")).when(k % 2 == 1, F.concat(F.lit("Sure:\n"), "output", F.lit("\n done"))).otherwise(F.concat(F.lit("} "), F.substring("output", 1, 8)))
    e = examples(spark, sf_dir).withColumn("p", scoring.accept_output("task_type", "gold", raw))
    return e.select("example_id", "p.status")
