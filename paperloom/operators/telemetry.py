"""Aggregates over model calls (A1-A7, A9, A44, A52, T-3, T-5, T-7, P20, P23, P27, P28, W7, D3, D4)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Counters of a call and the share of calls above which a hint is given, in this order.
HINTS = {
    "CITE_EXACT": ("excerpt_mismatches", 0.15),
    "VALID_RANGE": ("range_invalids", 0.10),
    "VALID_JSON": ("error_recovered", 0.08),
    "REQUIRE_CITATIONS": ("missing_citations", 0.10),
    "CHECK_PAGES": ("page_mismatches", 0.15),
    "OFFSET_CARE": ("offset_wrongs", 0.20),
}
RELIABLE = 0.85
# The first bucket with a word in the lower-cased message names the error.
ERROR_WORDS = [
    ("TIMEOUT", ["timeout"]),
    ("RATE_LIMIT", ["rate limit", "429"]),
    ("JSON_PARSE", ["json", "parse"]),
    ("EMPTY_RESPONSE", ["empty", "vazio"]),
    ("BUDGET_EXCEEDED", ["budget", "exceed"]),
    ("SERVER_ERROR", ["500", "502", "503"]),
    ("AUTH_ERROR", ["401", "403", "api_key", "api key", "invalid key"]),
]


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def classify_error(message: Column) -> Column:
    """P23."""
    text, out = F.lower(message), F.lit("OTHER")
    for name, words in reversed(ERROR_WORDS):
        found = F.lit(False)
        for w in words:
            found = found | text.contains(w)
        out = F.when(found, name).otherwise(out)
    return F.when(F.coalesce(message, F.lit("")) == "", "UNKNOWN").otherwise(out)


def by_model_role(calls: DataFrame) -> DataFrame:
    """A1: counts, rates and token sums for each model and role."""
    return calls.groupBy("model", "role").agg(
        F.count("*").alias("calls"),
        F.count_if("success").alias("successes"),
        F.count_if("was_retry").alias("retries"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"),
        ratio(F.sum("latency"), F.count("latency")).alias("avg_latency"),
        ratio(F.count_if("success"), F.count("*")).alias("success_rate"),
    )


def error_histogram(calls: DataFrame, *keys: str) -> DataFrame:
    """The map part of A1 and A2: how often each error type occurs, as ``type:count`` in order of type."""
    counts = calls.where("error_type is not null").groupBy(*keys, "error_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.concat_ws(":", "error_type", F.col("n").cast("string"))))
    return counts.groupBy(*keys).agg(F.array_join(entries, ",").alias("errors"))


def adaptive_hints(calls: DataFrame, as_of: str, days: int = 30, most: int = 2000) -> DataFrame:
    """A2: over the ``most`` recent calls in the window, for each model and role the hints whose counter's share of
    calls is above its bound, and whether the pair is reliable. Counters that calls lacks count as absent."""
    recent = calls.where(F.col("created_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days"))
    recent = recent.orderBy(F.desc("created_at"), F.desc("call_id")).limit(most)
    known = {code: rule for code, rule in HINTS.items() if rule[0] in calls.columns}
    share = {code: ratio(F.count_if(F.coalesce(F.col(c), F.lit(0)) > 0), F.count("*")) for code, (c, _) in known.items()}
    hints = F.array_join(F.array_compact(F.array(*[F.when(share[code] > known[code][1], code) for code in known], F.lit(None).cast("string"))), ",")
    rate = ratio(F.count_if("success"), F.count("*"))
    return recent.groupBy("model", "role").agg(F.count("*").alias("calls"), rate.alias("success_rate"), hints.alias("hints"), (rate < RELIABLE).alias("unreliable"))


def by_phase(calls: DataFrame, phase: str = "role", least: int = 3) -> DataFrame:
    """A3: share of all time, and the bottleneck: the largest mean latency among phases of at least ``least`` calls,
    the first by name on a tie."""
    out = calls.groupBy(F.col(phase).alias("phase")).agg(F.count("*").alias("calls"), F.sum("latency").alias("time"), ratio(F.sum("latency"), F.count("latency")).alias("avg_latency"))
    everything = Window.partitionBy()  # a row a phase
    top = F.max(F.when(F.col("calls") >= least, F.col("avg_latency"))).over(everything)
    first = F.min(F.when((F.col("calls") >= least) & (F.col("avg_latency") == F.col("top")), F.col("phase"))).over(everything)
    out = out.withColumn("share", ratio(F.col("time"), F.sum("time").over(everything))).withColumn("top", top)
    return out.withColumn("is_bottleneck", F.col("phase") == first).drop("top")


def by_model(calls: DataFrame) -> DataFrame:
    """A4: roles of each model, ratios and averages."""
    return calls.groupBy("model").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"),
        F.count("*").alias("calls"),
        ratio(F.count_if("success"), F.count("*")).alias("success_rate"),
        ratio(F.count_if("was_retry"), F.count("*")).alias("retry_rate"),
        ratio(F.sum("total_tokens"), F.count("*")).alias("tokens_per_call"),
        F.max("latency").alias("max_latency"),
    )


def quality_buckets(calls: DataFrame, edges: tuple[int, ...]) -> DataFrame:
    """A5, M5: calls by the bucket of their latency; retries only count among calls with tokens."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col("latency") >= e, 1).otherwise(0)
    with_tokens = F.col("total_tokens") > 0
    return calls.groupBy(bucket.cast("long").alias("bucket")).agg(
        F.count("*").alias("calls"),
        F.count_if(with_tokens).alias("with_tokens"),
        ratio(F.count_if(with_tokens & F.col("was_retry")), F.count_if(with_tokens)).alias("retry_rate"),
    )


def daily(calls: DataFrame) -> DataFrame:
    """Calls, errors and tokens a day (UTC)."""
    return calls.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.sum("total_tokens").alias("tokens"), ratio(F.count_if(~F.col("success")), F.count("*")).alias("error_rate")
    )


def errors_by_type(calls: DataFrame) -> DataFrame:
    """Error types with their share of all errors."""
    counts = calls.where("error_type is not null").groupBy("error_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def worst(calls: DataFrame, key: str = "model", least: int = 3, most: int = 5) -> DataFrame:
    """T-7: keys of the highest error rate among those of at least ``least`` calls."""
    rates = calls.groupBy(key).agg(F.count("*").alias("calls"), ratio(F.count_if(~F.col("success")), F.count("*")).alias("error_rate")).where(F.col("calls") >= least)
    return rates.orderBy(F.desc("error_rate"), key).limit(most)


def recent(calls: DataFrame, most: int, only_errors: bool = False) -> DataFrame:
    """T-3, P28: the latest calls, newest first; ties by id."""
    rows = calls.where(~F.col("success")) if only_errors else calls
    rows = rows.orderBy(F.desc("created_at"), F.desc("call_id")).limit(most)
    return rows.select("call_id", "model", "role", F.coalesce("error_type", F.lit("")).alias("error_type"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))


def retries(calls: DataFrame) -> DataFrame:
    """Number of each call among the user's calls of a role, and the run's first call that is not a retry."""
    order = Window.partitionBy("user_id", "role").orderBy("created_at", "call_id")
    whole = Window.partitionBy("user_id", "role")
    first = F.min(F.when(~F.col("was_retry"), F.struct("created_at", "call_id"))).over(whole)["call_id"]
    return calls.select("call_id", F.row_number().over(order).cast("long").alias("nth"), first.alias("first_own_call"))


def costs(calls: DataFrame, per_million: int, *keys: str) -> DataFrame:
    """Tokens and cost for each key, and the share of all cost. per_million: price of a million tokens."""
    out = calls.groupBy(*keys).agg(F.sum("total_tokens").alias("tokens"))
    cost = F.col("tokens") * per_million / F.lit(1_000_000.0)
    return out.select(*keys, "tokens", cost.alias("cost"), ratio(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())).alias("share"))
