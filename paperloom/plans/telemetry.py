"""Queries over model calls."""

from pyspark.sql import functions as F

from paperloom.operators import telemetry as t
from paperloom.plans.registry import query
from paperloom.plans.views_sql import using
from paperloom.sources import views as v

AS_OF = "2024-01-30 00:00:00"
AVG = "case when count(latency) = 0 then 0.0 else sum(latency)::double / count(latency) end"


def r(a: str, b: str = "count(*)") -> str:
    return f"case when {b} = 0 then 0.0 else ({a})::double / ({b}) end"


OK = "count(*) filter (where success)"
BAD = "count(*) filter (where not success)"
CALLS = lambda body, more="": using("model_calls", body, more)


@query(
    "a01_telemetry_by_model_role",
    CALLS(f"""select model, "role", count(*) calls, {OK} successes, count(*) filter (where was_retry) retries, sum(coalesce(total_tokens, 0))::bigint tokens,
  {AVG} avg_latency, {r(OK)} success_rate from model_calls group by 1, 2"""),
)
def by_model_role(spark, d):
    return t.by_model_role(v.model_calls(spark, d))


@query(
    "a01_error_histogram",
    CALLS("""select model, "role", string_agg(concat(error_type, ':', n), ',' order by error_type) errors from
  (select model, "role", error_type, count(*) n from model_calls where error_type is not null group by all) group by 1, 2"""),
)
def error_histogram(spark, d):
    return t.error_histogram(v.model_calls(spark, d), "model", "role")


@query(
    "a02_adaptive_hints",
    CALLS(
        f"""select model, "role", count(*) calls, {r(OK)} success_rate,
  concat_ws(',', case when {r('count(*) filter (where not success)')} > 0.08 then 'VALID_JSON' end, case when {r('count(*) filter (where was_retry)')} > 0.2 then 'OFFSET_CARE' end) hints,
  {r(OK)} < 0.85 unreliable from recent group by 1, 2""",
        f"recent as (select * from model_calls where created_at >= timestamp '{AS_OF}' - interval 30 day order by created_at desc, call_id desc limit 2000)",
    ),
)
def adaptive_hints(spark, d):
    calls = v.model_calls(spark, d).withColumns({"error_recovered": (~F.col("success")).cast("int"), "offset_wrongs": F.col("was_retry").cast("int")})
    return t.adaptive_hints(calls, AS_OF)


@query(
    "a03_by_phase",
    CALLS(
        f"""select phase, calls, "time", avg_latency, {r('"time"', '(sum("time") over ())')} "share",
  phase = min(case when calls >= 3 and avg_latency = top then phase end) over () is_bottleneck from (select *, max(case when calls >= 3 then avg_latency end) over () top from g)""",
        f"""g as (select "role" phase, count(*) calls, sum(latency)::bigint "time", {AVG} avg_latency from model_calls group by 1)""",
    ),
)
def by_phase(spark, d):
    return t.by_phase(v.model_calls(spark, d))


@query(
    "a04_by_model",
    CALLS(f"""select model, string_agg(distinct "role", ',' order by "role") roles, count(*) calls, {r(OK)} success_rate, {r('count(*) filter (where was_retry)')} retry_rate,
  {r('sum(total_tokens)')} tokens_per_call, max(latency) max_latency from model_calls group by 1"""),
)
def by_model(spark, d):
    return t.by_model(v.model_calls(spark, d))


@query(
    "a05_quality_buckets",
    CALLS(f"""select ((latency >= 20000)::int + (latency >= 50000)::int + (latency >= 80000)::int)::bigint bucket, count(*) calls, count(*) filter (where total_tokens > 0) with_tokens,
  {r('count(*) filter (where total_tokens > 0 and was_retry)', 'count(*) filter (where total_tokens > 0)')} retry_rate from model_calls group by 1"""),
)
def quality_buckets(spark, d):
    return t.quality_buckets(v.model_calls(spark, d), (20_000, 50_000, 80_000))


@query(
    "a06_daily_trend",
    CALLS(f"""select strftime(created_at, '%Y-%m-%d') "day", count(*) calls, {BAD} errors, sum(total_tokens)::bigint tokens, {r(BAD)} error_rate from model_calls group by 1"""),
)
def daily(spark, d):
    return t.daily(v.model_calls(spark, d))


@query("a07_errors_by_type", CALLS(f"""select error_type, n, {r('n', '(sum(n) over ())')} "share" from (select error_type, count(*) n from model_calls where error_type is not null group by 1)"""))
def errors_by_type(spark, d):
    return t.errors_by_type(v.model_calls(spark, d))


@query("t07_worst_models", CALLS(f"select model, count(*) calls, {r(BAD)} error_rate from model_calls group by 1 having count(*) >= 3 order by 3 desc, 1 limit 5"))
def worst_models(spark, d):
    return t.worst(v.model_calls(spark, d))


RECENT = """select call_id, model, "role", coalesce(error_type, '') error_type, coalesce(total_tokens, 0) total_tokens from model_calls {} order by created_at desc, call_id desc limit {}"""


@query("t03_recent_calls", CALLS(RECENT.format("", 50)))
def recent_calls(spark, d):
    return t.recent(v.model_calls(spark, d), 50)


@query("t03_recent_errors", CALLS(RECENT.format("where not success", 20)))
def recent_errors(spark, d):
    return t.recent(v.model_calls(spark, d), 20, only_errors=True)


@query(
    "w07_retries",
    CALLS("""select call_id, row_number() over (partition by user_id, "role" order by created_at, call_id) nth,
  first_value(call_id) over (partition by user_id, "role" order by was_retry, created_at, call_id rows between unbounded preceding and unbounded following)
  * case when bool_or(not was_retry) over (partition by user_id, "role") then 1 end first_own_call from model_calls"""),
)
def retries(spark, d):
    return t.retries(v.model_calls(spark, d))


@query("a09_costs_by_phase", CALLS(f"""select "role", tokens, tokens * 14 / 1000000.0::double cost, {r('tokens', '(sum(tokens) over ())')} "share" from (select "role", sum(total_tokens)::bigint tokens from model_calls group by 1)"""))
def costs_by_phase(spark, d):
    return t.costs(v.model_calls(spark, d), 14, "role")


@query(
    "p23_error_classes",
    CALLS("""select c error_class, count(*) n from (select case when coalesce(error_message, '') = '' then 'UNKNOWN' when contains(lower(error_message), 'timeout') then 'TIMEOUT'
  when contains(lower(error_message), '429') then 'RATE_LIMIT' when contains(lower(error_message), 'json') or contains(lower(error_message), 'parse') then 'JSON_PARSE' else 'OTHER' end c from model_calls) group by 1"""),
)
def error_classes(spark, d):
    return v.model_calls(spark, d).groupBy(t.classify_error(F.col("error_message")).alias("error_class")).agg(F.count("*").alias("n"))


@query("a52_distinct_models", CALLS('select "role", count(distinct model) n_models, count(distinct user_id) n_users from model_calls group by 1'))
def distinct_models(spark, d):
    return v.model_calls(spark, d).groupBy("role").agg(F.countDistinct("model").alias("n_models"), F.countDistinct("user_id").alias("n_users"))
