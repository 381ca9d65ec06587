"""Differences of two versions of a table, of JSON documents or of rows, and relations of intervals."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import digests, intervals, sketches, skyline, trees
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import register
from tallyforge.streaming import attempts

_TREE = """concat('{{"id":', k, ',"cost":{{"per.unit":', {per}, ',"cap":', c, {places}, '}},"steps":[{{"role":"', {role}, '","n":', k % 5, '}},{{"role":"b","n":', {n}, '}}', {more}, '],"flag":', {flag}, {note}, '}}')"""
_FROZEN = _TREE.format(per="'0.000001'", places="''", role="'a/b'", n="2", more="''", flag="'true'", note="',\"note\":null'")
_EXECUTED = _TREE.format(
    per="if(m = 1, '\"1e-06\"', if(m = 6, '1e-6', '0.000001'))", places="if(m = 7, '.0', '')", role="if(m = 7, 'A', 'a/b')", n="if(m = 4, 3, 2)",
    more="if(m = 3, ',[1,{\"x\":2}]', '')", flag="if(m = 5, '1', 'true')", note="if(m = 2, '', ',\"note\":null')",
)


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Configurations made from orders, as frozen and as executed; every ninth order lacks one of the two."""
    o = b.spread(b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 8).alias("m")))
    cut = F.when(F.col("k") % 50 == 3, F.lit("{cut")).otherwise(F.expr(_EXECUTED))
    return o.where("k % 9 <> 1").select(F.col("k").alias("example_id"), F.expr(_FROZEN).alias("tree")), o.where("k % 9 <> 2").select(F.col("k").alias("example_id"), cut.alias("tree"))


_ROWS = """o as (select o_orderkey as k, o_custkey as c, o_orderkey % 8 as m, o_orderkey % 9 as side, o_orderkey % 50 = 3 as bad from {orders}),
pairs as (select * from o where side not in (1, 2) and not bad)"""
_NAMES = "select k as example_id, path, issue, lk as left_kind, lv as left_value, rk as right_kind, rv as right_value from x"
_SAME = """
  select k, '' as path, 'side' as issue, case side when 2 then 'object' end as lk, null::varchar as lv, case side when 1 then case when bad then 'unreadable' else 'object' end end as rk,
    case when side = 1 and bad then '{{cut' end as rv from o where side in (1, 2)
  union all select k, '', 'type', 'object', null, 'unreadable', '{{cut' from o where bad and side not in (1, 2)
  union all select k, 'cost.per.unit', 'type', 'number', '1.0E-6', 'string', '1e-06' from pairs where m = 1
  union all select k, 'steps[1].n', 'value', 'integer', '2', 'integer', '3' from pairs where m = 4
  union all select k, 'flag', 'type', 'boolean', 'true', 'integer', '1' from pairs where m = 5
  union all select k, 'cost.cap', 'type', 'integer', c::varchar, 'number', c::double::varchar from pairs where m = 7
  union all select k, 'steps[0].role', 'value', 'string', 'a/b', 'string', 'A' from pairs where m = 7"""


@register("representation_diff", f"with {_ROWS}, x as ({_SAME}" + """
  union all select k, '', 'keys', 'object', null, 'object', null from pairs where m = 2
  union all select k, 'steps', 'length', 'array', null, 'array', null from pairs where m = 3)
""" + _NAMES)
def representation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.diff(*versions(spark, sf_dir), ["example_id"], "tree")


@register("tree_changes", f"with {_ROWS}, x as ({_SAME}" + """
  union all select k, 'note', 'missing', 'null', null, null, null from pairs where m = 2
  union all select k, 'steps[2]', 'missing', null, null, 'array', null from pairs where m = 3)
""" + _NAMES)
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.diff(*versions(spark, sf_dir), ["example_id"], "tree", deep=True)


def _edited(df: DataFrame) -> DataFrame:
    """Line items with some changed, some gone and some twice, all in a few stretches of orders."""
    near = "l_orderkey % 9001 between 100 and 140"
    kept = df.where(f"not ({near} and l_linenumber = 2 and l_orderkey % 3 = 0)")
    changed = kept.withColumn("l_comment_rank", F.lit(0)).withColumn("l_quantity", F.when(F.expr(f"{near} and l_linenumber = 1"), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    twice = df.where(f"{near} and l_linenumber = 3").withColumn("l_comment_rank", F.lit(1))
    return changed.unionByName(twice).drop("l_comment_rank")


@register("digest_tree_diff", """
with a as (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate from {lineitem}),
near as (select *, l_orderkey % 9001 between 100 and 140 as near from a),
e as (
  select l_orderkey, l_linenumber, l_partkey, case when near and l_linenumber = 1 then l_quantity + 1 else l_quantity end as l_quantity, l_shipdate from near
    where not (near and l_linenumber = 2 and l_orderkey % 3 = 0)
  union all select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate from near where near and l_linenumber = 3)
select 'left' as side, * from (select * from a except all select * from e) x union all select 'right', * from (select * from e except all select * from a) y""")
def digest_tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    return digests.compare(a, _edited(a), "l_orderkey")


_SESSIONS = """
with s as (select example_id, attempt_id, {start} as s, {start} + latency_ms * 1000 as e, case when lag(ts) over w >= ts - interval 30 minutes then 0 else 1 end as opens from {{attempts}}
    window w as (partition by example_id order by ts, attempt_id)),
n as (select *, sum(opens) over (partition by example_id order by s, attempt_id rows between unbounded preceding and current row) as session from s)
"""


@register("interval_relations", _SESSIONS.format(start="epoch_us(ts)").replace("{{", "{").replace("}}", "}") + """,
c as (select example_id, session, min(s) as s, max(e) as e from n group by example_id, session)
select c.example_id as example_id, case when n.s = c.s and n.e = c.e then 'equal' when n.s >= c.s and n.e <= c.e then 'inside' when c.s >= n.s and c.e <= n.e then 'around'
  else 'overlap' end as relation, count(*) as pairs, cast(sum(n.attempt_id % 1000) as bigint) as marks
from n join c on n.example_id = c.example_id and n.s <= c.e and c.s <= n.e group by 1, 2""")
def interval_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts against sessions of the same example: a session runs till its longest attempt ends, so it may reach into the next."""
    n = spark.sql(_SESSIONS.format(start="unix_micros(cast(ts as timestamp))").replace("{{", "{").replace("}}", "}") + "select example_id, attempt_id, s, e, session from n", attempts=b.attempts(spark, sf_dir))
    calls = n.select("example_id", "attempt_id", "s", "e")
    sessions = n.groupBy("example_id", "session").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    met = intervals.overlaps(calls, sessions, ["example_id"], ("s", "e"), ("s", "e"))
    return met.groupBy("example_id", "relation").agg(F.count("*").alias("pairs"), F.sum(F.col("l.attempt_id") % 1000).cast("long").alias("marks"))


@register("nondominated_examples", """
with x as (select d.task as task, m.example_id, m.strategy, m.task_score, m.tokens from {metrics} m join {dims} d on d.example_id = m.example_id),
c as (select task, tokens, max(task_score) as top from x group by task, tokens),
p as (select *, max(top) over (partition by task order by tokens rows between unbounded preceding and 1 preceding) as before from c)
select x.task as task, example_id, strategy, task_score, x.tokens as tokens from x join p on p.task = x.task and p.tokens = x.tokens and x.task_score = p.top where before is null or top > before""")
def nondominated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each task's examples and strategies those that no other beats in score and tokens."""
    m = b.metrics(spark, sf_dir).select("example_id", "strategy", "task_score", "tokens")
    rows = m.join(b.dims(spark, sf_dir).select("example_id", "task"), "example_id")
    return skyline.nondominated(rows, ["task"], "task_score", "tokens")


@register("sketch_rollups", """
with e as (select event_type as kind, user_id, value from {events}),
k as (select kind, count(*) as n, count(distinct user_id) as users, median(value) as m from e group by kind)
select kind, n, users, true as users_near, true as median_near, true as same_as_direct,
  (select count(*) from (select user_id from e where e.kind = k.kind intersect select user_id from e where e.kind = 'error') x)::bigint as shared, true as shared_near from k""")
def sketch_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by day and kind, rolled up to kinds, held against exact counts: distinct users and users shared with another kind
    within five percent, the median's rank within three, merged sketches as good as direct ones."""
    e = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("day"), "user_id", "value")
    daily = sketches.sketch(e, ["kind", "day"], "user_id", "value")
    up, direct = sketches.merged(daily, ["kind"]), sketches.sketch(e, ["kind"], "user_id", "value")
    half, near = sketches.quantile(0.5), lambda x, exact, part: F.abs(x - exact) <= part * exact + 1
    about = up.select("kind", F.col("n"), sketches.distinct().alias("about"), half.alias("half"), "cohort")
    other = direct.select("kind", sketches.distinct().alias("at_once"))
    errors = up.where("kind = 'error'").select(F.col("cohort").alias("errors"))
    people = e.select("kind", "user_id").distinct()
    exact = people.groupBy("kind").agg(F.count("*").alias("users"))
    both = people.join(people.where("kind = 'error'").select("user_id"), "user_id", "left_semi").groupBy("kind").agg(F.count("*").alias("shared"))
    rank = e.join(about.select("kind", "half"), "kind").groupBy("kind").agg(F.avg((F.col("value") <= F.col("half")).cast("double")).alias("rank"))
    joined = about.join(other, "kind").join(exact, "kind").join(both, "kind", "left").join(rank, "kind").join(errors, F.lit(True), "left")
    counted = F.coalesce("shared", F.lit(0))
    return joined.select(
        "kind", "n", "users", near(F.col("about"), F.col("users"), 0.05).alias("users_near"), (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_near"),
        near(F.col("at_once"), F.col("about"), 0.05).alias("same_as_direct"), counted.alias("shared"),
        near(sketches.shared("cohort", "errors"), counted, 0.05).alias("shared_near"),
    )


@register("attempt_lifecycles", """
with s as (select attempt_id, min(ts) as started_at from {attempts} where attempt_id % 11 <> 0 group by attempt_id),
f as (select attempt_id, min(ts + to_milliseconds(latency_ms * 400)) as ended_at, arg_min(outcome, ts) as outcome from {attempts} where outcome <> 'TIMEOUT' group by attempt_id)
select coalesce(f.outcome, 'UNKNOWN_USAGE') as outcome, count(*) as n, cast(sum(s.attempt_id) as bigint) as marks
from s left join f on s.attempt_id = f.attempt_id and f.ended_at >= s.started_at and f.ended_at <= s.started_at + interval 10 minutes group by 1""")
def attempt_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of started attempts: timeouts never end, and what takes over ten minutes ends too late to count."""
    a = b.attempts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    started = a.where("attempt_id % 11 <> 0").select("attempt_id", F.col("ts").alias("started_at"))
    finished = a.where("outcome <> 'TIMEOUT'").select("attempt_id", F.timestamp_micros(F.unix_micros("ts") + F.col("latency_ms") * 400_000).alias("ended_at"), "outcome")
    found = attempts.lifecycles(started.unionByName(started.where("attempt_id % 5 = 0")), finished)
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("attempt_id").cast("long").alias("marks"))
