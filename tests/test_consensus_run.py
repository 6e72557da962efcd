from pyspark.sql import functions as F

from paperloom.operators import consensus_run as cr

FINDING = "doc_id long, auditor_id string, finding_id long, s long, e long, severity string"
ROWS = [
    (1, "A0", 1, 0, 100, "critico"),
    (1, "A1", 2, 10, 90, "baixo"),
    (1, "A2", 3, 0, 100, "alto"),
    (1, "A0", 4, 500, 600, "alto"),
    (2, "A3", 5, 0, 10, "baixo"),
    (2, "A0", 6, 40, 50, None),
]
AUDITORS = ["A0", "A1", "A2", "A3"]


def made(spark, n_runs, rows=ROWS):
    validity = spark.createDataFrame([("A0", 1.0), ("A1", 0.5), ("A2", 0.9)], "auditor_id string, score double")
    compliance = spark.createDataFrame([("A0", 1.0), ("A1", 0.7)], "auditor_id string, compliance double")
    return cr.run(spark.createDataFrame(rows, FINDING), validity, compliance, AUDITORS, n_runs)


def test_stages_take_each_others_tables(spark):
    out = made(spark, 30)
    scores = {(r.doc_id, r.cluster_id): (r.n_auditors, r.score, r.category) for r in out.scores.collect()}
    v, c = (1.0 + 0.5 + 0.9) / 3, (1.0 + 0.7 + 0.5) / 3
    assert scores == {
        (1, 1): (3, round(0.5 * 3 / 4 + 0.3 * v + 0.2 * c, 4), "FACTO_CERTIFICADO"),
        (1, 4): (1, round(0.125 + 0.3 + 0.2, 4), "FINDING_ISOLADO"),
        (2, 5): (1, round(0.125 + 0.15 + 0.1, 4), "NAO_FIAVEL"),
        (2, 6): (1, round(0.125 + 0.3 + 0.2, 4), "NAO_FIAVEL"),
    }
    assert [(r.doc_id, r.cluster_id) for r in out.contradictions.collect()] == [(1, 1)]
    assert sorted((r.cluster_id, r.missing, r.suspected) for r in out.omissions.collect()) == [(1, "A3", True), (4, "A1,A2,A3", False)]
    assert sorted((r.kind, r.seq, r.auditor_id) for r in out.asked_again.collect()) == [("CONTRADICTION", 1, None), ("OMISSION_SUSPECTED", 1, "A3")]


def test_phases_wait_for_the_history(spark):
    for n, later, again in ((9, 0, 0), (10, 1, 0), (29, 1, 0), (30, 1, 2)):
        out = made(spark, n)
        assert (out.scores.count(), out.contradictions.count(), out.asked_again.count()) == (4, later, again)
    empty = made(spark, 30, [])
    assert [x.count() for x in (empty.clustered, empty.scores, empty.contradictions, empty.omissions, empty.asked_again)] == [0] * 5


def test_first_success(spark):
    rows = [("a", 1, False, "x"), ("a", 2, True, "y"), ("a", 3, True, "z"), ("b", 5, True, "p"), ("c", 1, False, "q"), ("c", 2, None, "q"), (None, 1, True, None)]
    out = cr.first_success(spark.createDataFrame(rows, "k string, attempt int, ok boolean, result string"), "k")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 2, "y", 2, True), ("b", 5, "p", 1, False), ("c", None, None, 2, False), (None, 1, None, 1, False)], key=str)
    assert out.where(F.col("substitute")).count() == 1
