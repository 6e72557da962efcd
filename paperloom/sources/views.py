"""Domain views over the test tables: the same rows as the CTEs in plans/views_sql.py."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(value: Column, *names: str) -> Column:
    """names[value mod len(names)]."""
    return F.element_at(F.array(*map(F.lit, names)), (value % len(names)).cast("int") + 1)


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a model call; latency in thousandths, so that sums are exact."""
    k = F.get_json_object("props", "$.k").cast("long")
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.col("ts").alias("created_at"),
        F.col("user_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"),
        pick(F.col("event_id"), "E1", "A1", "J1", "TRIAGE", "FINAL").alias("role"),
        (~failed).alias("success"),
        F.floor(F.col("value") * 1000).cast("long").alias("latency"),
        k.alias("total_tokens"),
        (k % 5 == 0).alias("was_retry"),
        F.when(failed, pick(k, "TIMEOUT", "JSON_PARSE", "RATE_LIMIT")).alias("error_type"),
        F.when(failed, pick(k, "request timeout", "cannot parse json", "http 429")).alias("error_message"),
    )


def wallet_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries; amounts in cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", "credit").otherwise("debit").alias("type"),
        cents.alias("amount"),
        F.floor(cents / 2).cast("long").alias("cost_real"),
        F.col("o_orderstatus").alias("status"),
    )


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"), F.col("c_mktsegment").alias("segment"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted items with half-open character ranges."""
    s = (F.col("l_partkey") % 40) * 5
    kind = F.when(F.col("l_returnflag") == "A", "date").when(F.col("l_returnflag") == "N", "amount").otherwise("fact")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit("E"), (F.col("l_suppkey") % 7).cast("string")).alias("extractor_id"),
        kind.alias("item_type"),
        s.alias("s"),
        (s + F.col("l_quantity").cast("long")).alias("e"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("value"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.concat(F.lit("A"), (F.col("l_suppkey") % 4).cast("string")).alias("auditor_id"),
        pick(F.col("l_linenumber"), "baixo", "medio", "alto", "critico").alias("severity"),
    )


def page_boundaries(docs: DataFrame, n_pages: int = 5, size: int = 50) -> DataFrame:
    """Pages [size * (p - 1), size * p) of each doc_id."""
    pages = docs.select("doc_id").distinct().withColumn("page_num", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_pages).cast("long"))))
    return pages.withColumns({"page_start": (F.col("page_num") - 1) * size, "page_end": F.col("page_num") * size})


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("nid"), F.col("event_id").alias("version"), F.col("ts").alias("published"))


def fact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.col("user_id").alias("nid"), F.col("event_id").alias("fact_id"), F.col("ts").alias("fact_date"))
