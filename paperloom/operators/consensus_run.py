"""A run of the consensus engine as one plan, its stages taking each other's tables.

Findings are clustered (J7); citation checks (V4) give each auditor's validity (A24), its errors its compliance (A25); these give
clusters their scores and categories (A26), contradictions (A27) and omissions (A28), and from them what is asked again (W10).
Contradictions and omissions count from PHASE_B runs in the history on, asking again from PHASE_C on; before, their tables are
empty, with the same columns.

Defined results: an auditor without checks has a validity of UNKNOWN, one without errors listed a compliance of UNKNOWN; unknown
severities count as medium. No findings give empty tables.
"""

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.consensus import clusters, contradictions, omissions, selection, severity_rank

# Fixed values.
PHASE_B, PHASE_C = 10, 30
CERTIFIED, PROBABLE = (3, 0.7), (2, 0.5)  # auditors and mean validity, at least
UNKNOWN = 0.5
WEIGHTS = (0.5, 0.3, 0.2)  # of agreement, validity, compliance


@dataclass
class Consensus:
    clustered: DataFrame
    scores: DataFrame
    contradictions: DataFrame
    omissions: DataFrame
    asked_again: DataFrame


def cluster_scores(clustered: DataFrame, validity: DataFrame, compliance: DataFrame, n_auditors: int) -> DataFrame:
    """Score and category of each cluster. validity: (auditor_id, score); compliance: (auditor_id, compliance)."""
    first = F.min_by(severity_rank(F.col("severity")), F.struct("auditor_id", "finding_id")).over(Window.partitionBy("doc_id", "cluster_id"))
    members = clustered.withColumn("first", first).select("doc_id", "cluster_id", "auditor_id", "first").distinct()
    members = members.join(F.broadcast(validity.select("auditor_id", "score")), "auditor_id", "left")  # a row an auditor
    members = members.join(F.broadcast(compliance.select("auditor_id", "compliance")), "auditor_id", "left")
    known = lambda c: F.avg(F.coalesce(c, F.lit(UNKNOWN)))
    out = members.groupBy("doc_id", "cluster_id").agg(F.count("*").alias("n_auditors"), known("score").alias("validity"), known("compliance").alias("compliance"), F.max("first").alias("first"))
    n, valid = F.col("n_auditors"), F.col("validity")
    score = WEIGHTS[0] * n / F.lit(n_auditors) + WEIGHTS[1] * valid + WEIGHTS[2] * F.col("compliance")
    alone = F.when(F.col("first") >= 2, "FINDING_ISOLADO").otherwise("NAO_FIAVEL")
    probable = (n >= PROBABLE[0]) & (valid >= PROBABLE[1])
    category = F.when((n >= CERTIFIED[0]) & (valid >= CERTIFIED[1]), "FACTO_CERTIFICADO").when(probable, "FACTO_PROVAVEL").when(n == 1, alone).otherwise("FACTO_PROVAVEL")
    return out.select("doc_id", "cluster_id", "n_auditors", F.round(score, 4).alias("score"), category.alias("category"))


def run(findings: DataFrame, validity: DataFrame, compliance: DataFrame, auditors: list[str], n_runs: int) -> Consensus:
    """All stages over findings (doc_id, auditor_id, finding_id, s, e, severity), with n_runs earlier runs."""
    clustered = clusters(findings).persist(StorageLevel.DISK_ONLY)  # three stages read it
    scored = cluster_scores(clustered, validity, compliance, len(auditors))
    against, silent = contradictions(clustered), omissions(clustered, auditors)
    if n_runs < PHASE_B:
        against, silent = against.limit(0), silent.limit(0)
    # Contradictions go before omissions, and only suspected ones are asked about.
    said = against.select("doc_id", F.lit(1).alias("priority"), F.col("cluster_id").alias("seq"), F.lit(None).cast("string").alias("auditor_id"), F.lit("CONTRADICTION").alias("kind"))
    missing = silent.where("suspected").select("doc_id", F.lit(2).alias("priority"), F.col("cluster_id").alias("seq"), F.explode(F.split("missing", ",")).alias("auditor_id"), F.lit("OMISSION_SUSPECTED").alias("kind"))
    asked = selection(said.unionByName(missing).withColumnRenamed("doc_id", "run_id"), 1, 3).withColumnRenamed("run_id", "doc_id")
    return Consensus(clustered, scored, against, silent, asked if n_runs >= PHASE_C else asked.limit(0))


def first_success(attempts: DataFrame, *keys: str) -> DataFrame:
    """Of ordered attempts (keys, attempt, ok, result) the first that succeeded, how many were tried up to it, and
    whether it was a substitute; nulls where none succeeded, with the number of all."""
    first = F.min(F.when(F.col("ok"), F.struct("attempt", "result")))
    order = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = attempts.withColumn("n", F.count("*").over(order))
    out = numbered.groupBy(*keys).agg(first.alias("first"), F.coalesce(F.min(F.when(F.col("ok"), F.col("n"))), F.max("n")).alias("n_tried"))
    return out.select(*keys, "first.attempt", "first.result", "n_tried", (F.col("first").isNotNull() & (F.col("n_tried") > 1)).alias("substitute"))
