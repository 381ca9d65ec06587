"""Examples and outputs made from ``orders``: JSON as the reference's corpora have it, with known flaws.

Each output's flaw follows from the order's key, so SQL that never sees the JSON tells what its scores must be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.bindings import spread, table

_EXAMPLES = r"""
select k as example_id, task_type, strategy, output, input, gold, metadata, candidates, result_metadata from (
  select k, c, strategy, case k % 4 when 0 then 'grounded_qa' when 1 then 'structured_extraction' when 2 then 'business_summarization'
    else 'robustness' end as task_type,
    case k % 4 when 1 then concat('{"text":"C', c, ' owes"}') when 2 then '{"text":"meeting"}' else
      concat('{"question":"who?","evidence_units":[{"id":"e1","text":"Customer ', c, ' ordered"},{"id":"e2","text":"status ', s, '"}]}') end as input,
    case k % 4
      when 1 then concat('{"expected":{"company":"C', c, '","amount_jpy":', c * 10000, ',"issue_date":"', iso, '","auto_renewal":', k % 2 = 1,
    '},"json_schema":{"type":"object","required":["company","amount_jpy"],"additionalProperties":false,"properties":{"company":{"type":"string"},"amount_jpy":{"type":["integer","null"]},"issue_date":{"type":"string","format":"date"},"auto_renewal":{"type":"boolean"}}}}')
      when 2 then concat('{"summary":"order ', k, '","decisions":["ship ', c,
    '","pay"],"risks":["late"],"action_items":[{"owner":"Sato","action":"ship","deadline":"', iso,
    '"},{"owner":"Kato","action":"pay","deadline":null}],"supported_facts":["pay","late","fact', k % 3, '"]}')
      else concat('{"answerable":', k % 7 <> 0, if(k % 7 <> 0, concat(',"answer":"customer ', c, '","acceptable_answers":["', c, '"],"evidence":["e1"]}'),
    ',"answer":"","evidence":[]}')) end as gold,
    concat('{"tags":[', case k % 3 when 0 then '"Negation"' when 1 then '"era","long context"' else '"plain"' end, '],"difficulty":"',
    case k % 3 when 0 then 'hard' when 1 then 'medium' else 'easy' end, '"}') as metadata,
    transform(sequence(0, 2), j -> case k % 4
      when 1 then concat('{"company":"C', c, '","amount_jpy":', (c + (k + j) % 2) * 10000, ',"issue_date":"', iso, '","auto_renewal":', k % 2 = 1, '}')
      when 2 then '{"summary":"none","decisions":[],"risks":[],"action_items":[]}'
      else concat('{"answer":"', if((k + j) % 3 = 0, concat('customer ', c), 'nobody'),
    '","citations":["e1"],"abstain":false,"confidence":0.5}') end) as candidates,
    case k % 4
      when 1 then concat('{"company":"', if(k % 5 = 0, concat('ｃ', c), concat('C', c)), '","amount_jpy":', case k % 3 when 0 then concat('"', c,
    '万円"') when 1 then cast(c * 10000 as string) else cast((c + 1) * 10000 as string) end,
        ',"issue_date":"', if(k % 5 = 1, concat(y, '年', m, '月', d, '日'), iso), '","auto_renewal":', if(k % 5 = 2, k % 2 = 0, k % 2 = 1), if(k % 5 = 3,
    ',"note":"x"', ''), '}')
      when 2 then concat('{"summary":"', if(k % 5 = 0, concat('Order  ', k), 'other'), '","decisions":', case k % 3 when 0 then concat('["pay","SHIP ', c,
    '"]') when 1 then '["pay"]' else '[]' end,
        ',"risks":["Late"],"action_items":[{"owner":"sato","action":"ship","deadline":"', if(k % 3 = 1, concat(y, '/', m, '/', d), iso), '"}', if(k % 5 = 1,
    ',{"owner":"Kato","action":"pay","deadline":null}', ''), ']', if(k % 7 = 0, '', ',"extra":"fact0"'), '}')
      else case k % 5 when 0 then concat('{"answer":"customer ', c, '","citations":["e1"],"abstain":false,"confidence":0.9}')
        when 1 then concat('{"answer":"', c, '","citations":["e1","e2"],"confidence":', if(k % 11 = 1, '1.5', '0.4'),
    '}') when 2 then concat('{"answer":" Customer  ', c, '","citations":[],"abstain":false,"confidence":1}')
        when 3 then '{"answer":"","citations":[],"abstain":true,"confidence":0.2}'
    else '{"answer":"nobody","citations":["e2"],"abstain":false,"confidence":0.3}' end end as output,
    concat('{"unknown_usage_stop":', k % 13 = 0, ',"interrupted_trajectory_stop":', k % 17 = 0, if(k % 8 < 4, '', ',"route":"critic"'), '}') as result_metadata
  from (select o_orderkey as k, o_custkey as c, o_orderstatus as s, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d,
    date_format(o_orderdate, 'yyyy-MM-dd') as iso,
    case o_orderkey % 6 when 0 then 'single_agent' when 1 then 'critic_reviser' when 2 then 'multi_agent_debate' when 3 then 'adaptive_router' when 4
    then 'multi_agent_debate' else 'adaptive_router' end as strategy from {orders}))
"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``example_id, task_type, strategy, output, input, gold, metadata, candidates, result_metadata``."""
    # the JSON's braces are no parameters
    text = _EXAMPLES.replace("{", "{{").replace("}", "}}").replace("{{orders}}", "{orders}")
    return spark.sql(text, orders=spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")))


def failed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with outputs that failed: every third text is cut, every third is a bare JSON text."""
    k = F.col("example_id") % 3
    raw = F.when(k == 0, F.substring("output", 1, 9)).when(k == 1, F.lit('"just a text"')).otherwise(F.col("output"))
    return examples(spark, sf_dir).withColumns({"output": raw, "failed": F.lit(True)})


#: What the SQL knows of an order: keys and dates, no JSON.
ORDERS_CTE = """o as (select o_orderkey as k, o_custkey as c, case o_orderkey % 4 when 0 then 'grounded_qa' when 1 then 'structured_extraction' when 2 then 'business_summarization' else 'robustness' end as task_type,
  case o_orderkey % 6 when 0 then 'single_agent' when 1 then 'critic_reviser' when 2 then 'multi_agent_debate' when 3 then 'adaptive_router' when 4 then 'multi_agent_debate' else 'adaptive_router' end as strategy from {orders})"""
