"""Audits of examples made from ``orders`` with one known flaw each; the SQL lists the flaws by key."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import quality
from tallyforge.plans.bindings import spread, table
from tallyforge.plans.registry import register

_CORPUS = r"""
select cast(k as string) as id, k, task_type, input, gold, concat('{', concat_ws(',',
    '"source":"orders","split":"dev","split_policy":"heldout_template_family"', concat('"difficulty":"',
    case k % 3 when 0 then 'hard' when 1 then 'medium' else 'easy' end, '"'), concat('"template_family":"t', c % 12, '"'),
    concat('"split":"', if(k % 2 = 0, 'dev', 'test'), '"'), '"scenario_family":"s","generator_version":"1","structural_signature":"x"',
    concat('"surface_form_family":"f', c % 5, '"'), concat('"reasoning_family":"r', c % 9, '"'),
    concat('"document_type":"', if(k % 100 = 0, concat('t', c % 12), 'd'), '"'), concat('"tags":[', if(f = 8 and task_type = 'grounded_qa', '"Long Tag"',
    '"tag"'), ']'),
    concat('"generator_operations":["', if(k % 3 = 0 and f <> 6, 'cross_sentence_composition', 'direct_lookup'), '"]'), concat('"difficulty_factors":["',
    if(f = 7, 'other', if(k % 3 = 0 and f <> 6, 'cross_sentence_composition', 'direct_lookup')), '"]'),
    concat('"target_entity":"Customer ', c, '"'), if(f = 5 and k % 4 = 2, '"document_date":"2031-01-01"', null), if(f = 6 and k % 4 = 2,
    '"chronology":{"ordered_pairs":[{"label":"x","earlier":"2030-02-01","later":"2030-01-01"}]}', null)), '}') as metadata
from (select k, c, f, case when k % 4 in (0, 3) then 'grounded_qa' when k % 4 = 1 then 'structured_extraction' else 'business_summarization' end as task_type,
  case when k % 4 in (0, 3) then concat('{"question":"who is ', if(f = 5, 'it', concat('Customer ', c)), '?",', if(f = 3, concat('"source_text":"Customer ', c,
    ' ordered"}'),
        concat('"evidence_units":[{"id":"e1","text":"Customer ', c, ' ordered"},{"id":"', if(f = 1, 'e1', 'e2'), '","text":"status ', s, '"}]}')))
    when k % 4 = 1 then concat('{"text":"C', c, 'は', iso, 'に発行。金額は', c, '万円。期限は2030-01-01まで"}')
    else concat('{"text":"佐藤は出荷', c, 'を2030-02-01までに行う。支払を決定。遅延の恐れ。田中は確認を行う"}') end as input,
  case when k % 4 in (0, 3) then concat('{"answerable":true,"answer":"', if(f = 0, ' ', concat('customer ', c)), '","evidence":["',
    case f when 2 then 'e9' when 4 then 'e2' else 'e1' end, '"]}')
    when k % 4 = 1 then concat('{"expected":{"company":"', if(f = 3, 'ZZ', concat('C', c)), '","amount_jpy":', if(f = 6, concat('"', c, '万円"'),
    cast(c * 10000 as string)), ',"issue_date":"', iso, '","due_date":', case f when 1 then 'null' when 2 then '"1990-01-01"' else '"2030-01-01"' end,
        '},"json_schema":{"type":"object","required":["company"', if(f = 4, ',"nope"', ''), '],"properties":{"company":{"type":"', if(f = 5, 'text', 'string'),
    '"},"amount_jpy":{"type":"integer"},"issue_date":{"type":"string","format":"date"},"due_date":{"type":["string","null"],"format":"date"}}}}')
    else concat('{"summary":"ok","decisions":["', if(f = 3, '却下', '支払を決定'), '"],"risks":["遅延"],"action_items":[{"owner":"', if(f = 2, '鈴木', '佐藤'),
    '","action":"', if(f = 4, '廃棄', concat('出荷', c)), '","deadline":', if(f = 1, 'null', '"2030-02-01"'),
        '},{"owner":"田中","action":"確認","deadline":null}],"supported_facts":["佐藤","出荷', c, '","2030-02-01","田中","確認",', if(f = 7, '', '"支払を決定",'),
    '"遅延"]}') end as gold
  from (select o_orderkey as k, o_custkey as c, o_orderkey % 9 as f, o_orderstatus as s, date_format(o_orderdate, 'yyyy-MM-dd') as iso from {orders}))
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, k, task_type, input, gold, metadata``."""
    text = _CORPUS.replace("{", "{{").replace("}", "}}").replace("{{orders}}", "{orders}").replace('"split":"dev",', "")
    return spark.sql(text, orders=spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")))


def _flaws(where: str, *flaws: tuple[str, str, str]) -> str:
    """SQL of (rule, issue) pairs, each with its condition on f = k % 9."""
    rows = [f"select k::varchar as id, '{rule}' as rule, {issue} as issue from o where {where} and ({condition})" for rule, issue, condition in flaws]
    return "with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 9 as f from {orders}) " + " union all ".join(rows)


_QA = _flaws(
    "k % 4 in (0, 3)", ("payload", "'answer_required'", "f = 0"), ("evidence", "'evidence_ids_not_unique'", "f = 1"), ("evidence", "'evidence_ids_unknown'", "f = 2"),
    ("evidence", "'evidence_units_missing'", "f = 3"), ("support", "'answer_not_in_evidence'", "f in (1, 2, 3, 4)"), ("target", "'entity_mismatch'", "f in (1, 2, 3, 4, 5)"),
    ("v3_metadata", "'hard_without_hard_operation'", "f = 6"), ("v3_metadata", "'factors_not_operations'", "f = 7"), ("v3_metadata", "'tags_not_canonical'", "f = 8"),
)
_EXTRACTION = _flaws(
    "k % 4 = 1", ("support", "'due_date_null_despite_deadline'", "f = 1"), ("support", "'field_unsupported:due_date'", "f = 2"), ("chronology", "'due_before_issue'", "f = 2"),
    ("support", "'field_unsupported:company'", "f = 3"), ("payload", "'schema_required_unknown'", "f = 4"), ("expected", "'expected: missing required field nope'", "f = 4"),
    ("payload", "'schema_type_unsupported:company'", "f = 5"), ("expected", "'expected.company: expected text'", "f = 5"), ("expected", "'expected.amount_jpy: expected integer'", "f = 6"),
)
_SUMMARY = _flaws(
    "k % 4 = 2", ("support", "'deadline_null_despite_deadline:佐藤'", "f = 1"), ("support", "'owner_unsupported:鈴木'", "f = 2"), ("support", "'deadline_unsupported:鈴木'", "f = 2"),
    ("support", "'decisions_unsupported'", "f = 3"), ("actions", "'action_unsupported:廃棄'", "f = 4"), ("chronology", "'deadline_before_document'", "f = 5"),
    ("chronology", "'pair_out_of_order:x'", "f = 6"), ("facts", "'supported_facts_incomplete'", "f in (2, 3, 4, 7)"),
)


@register("grounded_quality", _QA)
def grounded_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.example_issues(corpus(spark, sf_dir).where("task_type = 'grounded_qa'"), ["payload", "evidence", "support", "target", "v2_metadata", "v3_metadata"])


@register("extraction_quality", _EXTRACTION)
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.example_issues(corpus(spark, sf_dir).where("task_type = 'structured_extraction'"), ["payload", "expected", "support", "chronology"])


@register("summary_quality", _SUMMARY)
def summary_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.example_issues(corpus(spark, sf_dir).where("task_type = 'business_summarization'"), ["payload", "support", "chronology", "actions", "facts"])


@register("witness_violations", """
with o as (select o_orderkey as k, o_orderkey % 9 as f from {orders} where o_orderkey % 4 in (0, 3) and o_orderkey % 3 = 0),
x as (select k, 'hard_without_witnessed_operation' as operation from o union all select k, 'cross_sentence_composition' from o where f <> 6)
select operation, count(*) as n, list_sort(list(k::varchar)) as ids from x group by operation""")
def witness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.witness_report(corpus(spark, sf_dir).where("task_type = 'grounded_qa'"))


@register("collection_quality", """
with o as (select o_custkey % 5 as s, o_custkey % 9 as r, o_orderkey % 100 = 0 as nominal from {orders})
select count(distinct s) as surfaces, count(distinct r) as reasonings, count(*) filter (where nominal) as nominal,
  list_filter([case when count(distinct s) < 8 then 'surface_diversity_low' end, case when count(distinct r) < 8 then 'reasoning_diversity_low' end, case when count(*) filter (where nominal) > 0 then 'nominal_templates' end], lambda x: x is not null) as issues from o""")
def collection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.collection_issues(corpus(spark, sf_dir))


@register("template_split_leaks", """
select 't' || o_custkey % 12 as template_family, ['dev', 'test'] as splits from {orders} group by 1 having count(distinct o_orderkey % 2) > 1""")
def template_split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.split_leaks(corpus(spark, sf_dir))


@register("family_overlaps", """
select 't' || o_custkey % 12 as family, count(*) filter (where o_orderkey % 2 = 0) as n_dev, count(*) filter (where o_orderkey % 2 = 1) as n_test from {orders} group by 1 having n_dev > 0 and n_test > 0""")
def family_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return quality.family_overlaps(rows.where("k % 2 = 0"), rows.where("k % 2 = 1"))


@register("duplicate_examples", "select l_orderkey::varchar as id, count(*) as n from {lineitem} group by 1 having count(*) > 1")
def duplicate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_ids(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id")))
