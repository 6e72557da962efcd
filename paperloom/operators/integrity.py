"""Validators and confidence penalties."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import containment, for_matching

# Fixed values: (error type, category, penalty of one occurrence, most, ceiling of the confidence).
RULES = [
    ("RANGE_INVALID", "integrity", 0.03, 0.15, 0.80),
    ("PAGE_MISMATCH", "integrity", 0.01, 0.08, None),
    ("OFFSET_IMPRECISE", "integrity", 0.005, 0.03, None),
    ("OFFSET_WRONG", "integrity", 0.01, 0.08, None),
    ("EXCERPT_MISMATCH", "integrity", 0.05, 0.25, 0.65),
    ("MISSING_CITATION", "integrity", 0.01, 0.08, None),
    ("SEM_PROVA_DETERMINANTE", "integrity", 0.10, 0.25, 0.65),
    ("PAGES_MISSING", "coverage", 0.02, 0.20, None),
    ("PAGES_UNREADABLE", "coverage", 0.01, 0.15, None),
    ("COVERAGE_LOW", "coverage", 0.10, 0.15, None),
    ("COVERAGE_GAPS", "coverage", 0.01, 0.10, None),
    ("ERROR_RECOVERED", "parsing", 0.08, 0.25, 0.70),
    ("PARSE_WARNING", "parsing", 0.02, 0.10, None),
    ("DOC_ID_INVALID", "consistency", 0.05, 0.20, 0.75),
    ("TIMESTAMP_INVALID", "consistency", 0.01, 0.05, None),
    ("COUNT_MISMATCH", "consistency", 0.02, 0.10, None),
    ("ITEM_NOT_FOUND", "reference", 0.01, 0.10, None),
    ("FINDING_NOT_FOUND", "reference", 0.02, 0.10, None),
]
MOST_PENALTY = 0.40
RULE = "error_type string, category string, each double, most double, ceiling double"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE)


def penalties(errors: DataFrame) -> DataFrame:
    """Errors (run_id, error_type, n) to the run's penalty by the rules (a dimension of 18 rows): so much an
    occurrence up to the rule's bound, 0.40 in all, and the lowest ceiling; with the category of the largest part."""
    counts = errors.groupBy("run_id", "error_type").agg(F.sum("n").alias("n"))
    parts = counts.join(F.broadcast(rules(errors.sparkSession)), "error_type").withColumn("part", F.least(F.col("n") * F.col("each"), F.col("most")))
    by_category = parts.groupBy("run_id", "category").agg(F.sum("part").alias("part"), F.min("ceiling").alias("ceiling"))
    return by_category.groupBy("run_id").agg(
        F.least(F.sum("part"), F.lit(MOST_PENALTY)).alias("penalty"), F.coalesce(F.min("ceiling"), F.lit(1.0)).alias("ceiling"), F.min_by("category", F.struct(-F.round("part", 9), "category")).alias("dominant")
    )


def adjusted(confidence: Column, penalty: Column, ceiling: Column) -> Column:
    """The confidence less the penalty, under the ceiling, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(confidence - penalty, ceiling, F.lit(1.0)))


def compliance(errors: Column) -> Column:
    """0.7 if an error speaks of parsing, else 1."""
    return F.when(F.exists(errors, lambda e: F.lower(e).contains("parse")), 0.7).otherwise(1.0)


def severity_counts(errors: DataFrame) -> DataFrame:
    """Errors of each phase by severity."""
    return errors.groupBy("phase").agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("ERROR", "WARNING", "INFO")])


def unknown_ids(cited: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Cited keys that are not known; none if nothing is known."""
    any_known = known.limit(1).select(F.lit(1).alias("one"))
    return cited.join(known.select(key).distinct(), key, "left_anti").crossJoin(any_known).drop("one")  # by one row


def unknown_prefixes(cited: DataFrame, known: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Cited string ids that are not known and whose first ``n`` characters are in no known id; ids of fewer
    characters must be equal to a known one. None if nothing is known."""
    ids = known.where(F.col(key).isNotNull()).select(key).distinct()
    parts = F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda at: F.substring(key, at, F.lit(n)))
    held = ids.where(F.length(key) >= n).select(F.explode(F.array_distinct(parts)).alias("p")).distinct()
    out = unknown_ids(cited, ids, key).withColumn("p", F.when(F.length(key) >= n, F.substring(key, 1, n)))
    return out.join(held, "p", "left_anti").drop("p")


def files_present(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected (name, critical) against present (name) files: present, missing with severity, or extra."""
    e, p = expected.withColumn("e", F.lit(True)), present.select("name").distinct().withColumn("p", F.lit(True))
    status = F.when(F.col("e").isNull(), "extra").when(F.col("p").isNull(), "missing").otherwise("present")
    severity = F.when(status == "missing", F.when(F.col("critical"), "ERROR").otherwise("WARNING"))
    return e.join(p, "name", "full_outer").select("name", status.alias("status"), severity.alias("severity"))


def count_mismatches(counts: DataFrame, tolerance: int = 5) -> DataFrame:
    """Runs whose reported number is further than the tolerance from the true one."""
    return counts.where(F.abs(F.col("reported") - F.col("actual")) > tolerance)


def time_errors(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose time is unreadable or outside [start, end]."""
    t = F.try_to_timestamp("at")
    return rows.where(t.isNull() | ~t.between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def coverage_errors(rows: DataFrame) -> DataFrame:
    """(run_id, total, covered, missing, unreadable, percent) that do not add up, by name of the failed check."""
    checks = F.array_compact(
        F.array(
            F.when(F.col("covered") + F.col("missing") + F.col("unreadable") != F.col("total"), F.lit("PAGE_SUM")),
            F.when(F.abs(F.col("percent") - 100 * F.col("covered") / F.greatest("total", F.lit(1))) > 1, F.lit("PERCENT")),
        )
    )
    return rows.select("run_id", F.explode(checks).alias("check"))


def check_citation(text: Column, excerpt: Column, start: Column, end: Column) -> Column:
    """V1: array of the errors of a citation (range, then excerpt at the range, within 200 characters, anywhere)."""
    n = F.length(text)
    bad = (start < 0) | (end <= start) | (end > n)
    needle = for_matching(excerpt)
    at = lambda a, b, least: containment(needle, for_matching(F.substring(text, F.greatest(a, F.lit(0)) + 1, F.greatest(b - F.greatest(a, F.lit(0)), F.lit(0)))), least)["method"] != "none"
    anywhere = (F.length(excerpt) >= 15) & (containment(needle, for_matching(text), 0.3)["method"] != "none")
    kind = F.when(at(start, end, 0.4), F.lit(None)).when(at(start - 200, end + 200, 0.3), "OFFSET_IMPRECISE").when(anywhere, "OFFSET_WRONG").otherwise("EXCERPT_MISMATCH")
    return F.when(bad, F.array(F.lit("RANGE_INVALID"))).when(F.coalesce(excerpt, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(kind.cast("string"))))


def annotated(warnings: Column, confidence: Column, errors: Column, penalty: Column) -> tuple[Column, Column]:
    """V3: warnings with the new errors, each once, and the confidence less the penalty, 0.1 at least."""
    return F.array_sort(F.array_union(warnings, errors)), F.greatest(F.lit(0.1), confidence - penalty)
