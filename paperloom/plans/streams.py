"""Queries over the event stream, in their batch form."""

from pyspark.sql import functions as F

from paperloom.plans.registry import query
from paperloom.plans.views_sql import using
from paperloom.sources import views as v
from paperloom.streaming import streams as s
from paperloom.streaming.budget import guarded


@query("r04_rate_windows", """select time_bucket(interval 1 hour, ts) "start", time_bucket(interval 1 hour, ts) + interval 1 hour "end", user_id, count(*) calls from events group by 1, 2, 3 having count(*) > 1""")
def rate_windows(spark, d):
    return s.breaches(s.rate_windows(v.table(spark, d, "events"), "1 hour"), 1)


@query(
    "r05_sessions",
    """with m as (select *, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end fresh from events window w as (partition by user_id order by ts)),
n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from m)
select min(ts) "start", max(ts) + interval 30 minute "end", user_id, count(*) calls from n group by user_id, k""",
)
def sessions(spark, d):
    return s.sessions(v.table(spark, d, "events"))


@query("r02_breaker_trace")
def breaker_trace(spark, d):
    calls = v.model_calls(spark, d)
    return s.breaker_trace(calls.select(F.concat_ws("/", "model", F.col("user_id").cast("string")).alias("provider"), F.unix_timestamp("created_at").cast("double").alias("at"), F.col("call_id").alias("seq"), "success"))


@query("r08_not_done", "select event_id, user_id from events e where event_type = 'click' and not exists (select 1 from events d where d.event_type = 'purchase' and d.user_id = e.user_id and d.ts > timestamp '2024-01-25')")
def not_done(spark, d):
    e = v.table(spark, d, "events")
    done = e.where("event_type = 'purchase' and ts > timestamp '2024-01-25'")
    return s.not_done(e.where("event_type = 'click'"), done, "user_id").select("event_id", "user_id")


# A user's calls are a run, those that were retries external; costs are latencies; a pause of a day ends a run.
@query(
    "r03_budget_guard",
    using(
        "model_calls",
        """select run_id, "at", seq, cost_total, tokens_total, greatest(0, 300000 - cost_total) remaining,
  case when coalesce(bool_or(breach) over (partition by run_id, part order by "at", seq rows between unbounded preceding and 1 preceding), false) then 'blocked' when breach then 'exceeded' else 'ok' end status, tokens_total > 500 over_tokens from d""",
        """a as (select concat('r', user_id) run_id, created_at "at", call_id seq, coalesce(latency, 0) cost, coalesce(total_tokens, 0) tokens, was_retry "external" from model_calls where created_at is not null),
  b as (select *, coalesce("at" >= lag("at") over (partition by run_id order by "at", seq) + interval 1 day, false) fresh from a),
  c as (select *, sum(fresh::int) over (partition by run_id order by "at", seq rows unbounded preceding) part from b),
  d as (select *, cost_total > 300000 and not "external" breach from (select *, (sum(cost) over (partition by run_id, part order by "at", seq rows unbounded preceding))::bigint cost_total, (sum(tokens) over (partition by run_id, part order by "at", seq rows unbounded preceding))::bigint tokens_total from c))""",
    ),
)
def budget_guard(spark, d):
    calls = v.model_calls(spark, d)
    rows = calls.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.col("created_at").alias("at"), F.col("call_id").alias("seq"), F.col("latency").alias("cost"), F.col("total_tokens").alias("tokens"), F.col("was_retry").alias("external"))
    return guarded(rows, 300_000, 500, "1 day")
