import pytest
from pyspark.sql import functions as F

from paperloom.operators import consensus, integrity, intervals, ledger, legal, merging, pages, telemetry
from paperloom.sources import files
from paperloom.streaming import streams


def test_islands_and_gaps(spark):
    r = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 15, 30), (1, 50, 60)], "doc_id long, s long, e long")
    merged = intervals.islands(r, "doc_id")
    assert sorted((x.s, x.e) for x in merged.collect()) == [(0, 30), (50, 60)]
    left = intervals.gaps(merged, F.lit(100).cast("long"), "doc_id").collect()
    assert sorted((x.gap_start, x.gap_end) for x in left) == [(30, 50), (60, 100)]


def test_coverage_with_a_wide_gap_is_not_complete(spark):
    r = spark.createDataFrame([(1, 0, 900)], "doc_id long, s long, e long")
    row = intervals.coverage(r, 1000, "doc_id").first()
    assert (row.share, row.complete) == (0.9, False)


def test_offset_to_page(spark):
    p = spark.createDataFrame([(1, 1, 0, 40), (1, 2, 40, 90)], "doc_id long, page_num long, page_start long, page_end long")
    points = spark.createDataFrame([(1, i, at) for i, at in enumerate((0, 39, 40, 90, 500))], "doc_id long, point_id long, at long")
    found = {r.at: r.page_num for r in intervals.offset_to_page(points, p).collect()}
    assert found == {0: 1, 39: 1, 40: 2, 90: 2, 500: 2}
    floor = {r.at: r.page_num for r in intervals.floor_page(points, p).collect()}
    assert floor[39] == 1 and floor[40] == 2


def test_as_of(spark):
    v = spark.createDataFrame([(1, 1, "2001-01-01"), (1, 2, "2010-01-01"), (1, 3, None)], "nid long, version long, published string").withColumn("published", F.to_timestamp("published"))
    f = spark.createDataFrame([(1, 1, "2005-01-01"), (1, 2, "2012-01-01"), (1, 3, "1999-01-01"), (1, 4, None)], "nid long, fact_id long, fact_date string").withColumn("fact_date", F.to_timestamp("fact_date"))
    assert {r.fact_id: r.version for r in intervals.as_of(f, v).collect()} == {1: 1, 2: 2, 3: 1, 4: None}


@pytest.mark.parametrize(("votes", "level"), [("CCC", "unanimous"), ("CCP", "majority"), ("CPT", "split"), ("C", "single"), ("CP", "split")])
def test_vote(spark, votes, level):
    rows = spark.createDataFrame([(1, x) for x in votes], "doc_id long, vote string")
    assert consensus.vote(rows, "doc_id").first().level == level


def test_overlap_needs_a_share_of_the_shorter_range(spark):
    f = spark.createDataFrame([(1, 1, "A", 10, 20, "alto"), (1, 2, "B", 17, 40, "alto"), (2, 3, "A", 10, 20, "alto"), (2, 4, "B", 18, 40, "alto")], "doc_id long, finding_id long, auditor_id string, s long, e long, severity string")
    assert [(r.a, r.b) for r in consensus.overlap_edges(f).collect()] == [(1, 2)]
    assert {r.finding_id: r.cluster_id for r in consensus.clusters(f).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_clusters_batches_and_breaker_hold_no_whole_document(spark):
    import random

    rng = random.Random(1)
    rows = [(d, f"A{rng.randrange(4)}", i, x := 10 * rng.randrange(60), x + rng.randrange(14), "alto", i) for d in range(2) for i in range(200 * d, 200 * d + 200)]
    f = spark.createDataFrame(rows, consensus.FINDING)
    want = {}
    for d in range(2):
        free = sorted((r for r in rows if r[0] == d), key=lambda r: r[1:3])
        while free:
            seed = free[0]
            own = [r for r in free[1:] if r[1] != seed[1] and (n := min(r[4], seed[4]) - max(r[3], seed[3])) > 0 and n >= 0.3 * min(r[4] - r[3], seed[4] - seed[3])]
            want.update({r[2]: seed[2] for r in [seed, *own]})
            free = [r for r in free if r[2] not in want]
    assert {r.finding_id: r.cluster_id for r in consensus.clusters(f.drop("cluster_id")).collect()} == want

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        lengths = [(d, i, rng.randrange(60)) for d in range(3) for i in range(100)]
        sizes, used, batch = {}, 0, 0
        for d, i, n in lengths:
            used, batch = (0, 0) if i == 0 else (used, batch)
            used, batch = (n, batch + 1) if used > 0 and used + n > 100 else (used + n, batch)
            sizes[d, i] = batch
        numbered = pages.batches(spark.createDataFrame(lengths, "doc_id long, page_num long, n_chars long"), 100)
        assert {(r.doc_id, r.page_num): r.batch for r in numbered.collect()} == sizes
        calls = [(p, 7.0 * i, i, rng.random() < 0.4) for p in "pqr" for i in range(100)]
        df = spark.createDataFrame(calls, "provider string, at double, seq int, success boolean")
        traced = streams.breaker_trace(df)
        got = {(r.provider, r.at): (r.success, r.allowed, r.state, r.failures) for r in traced.collect()}
        for p in "pqr":
            state = ("CLOSED", 0, 0.0)
            for _, at, _, success in (c for c in calls if c[0] == p):
                *state, allowed = streams._step(*state, at, success)
                assert got[p, at] == (success, allowed, *state[:2])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "island" in plan(consensus.clusters(f.drop("cluster_id"))) and "collect_list" not in plan(numbered) and "FlatMapGroups" not in plan(traced)


def test_score(spark):
    f = spark.createDataFrame([(1, 1, a) for a in "ABC"], "doc_id long, cluster_id long, auditor_id string")
    v = spark.createDataFrame([(a, 1.0, 1.0) for a in "ABC"], "auditor_id string, validity double, compliance double")
    row = consensus.scores(f, v, 4).first()
    assert (row.score, row.category) == (pytest.approx(0.875), "certified")


def test_occurrences_overlap(spark):
    row = spark.createDataFrame([("aAa b", "aa"), ("xaay", "aa"), ("b", "aa")], "t string, e string")
    assert [r.n for r in row.select(consensus.occurrences(F.col("t"), F.col("e")).alias("n")).collect()] == [2, 1, 0]


def test_excerpts_are_found_beside_marks_and_at_every_place(spark):
    texts = ["He said (The quick fox) and the quick fox", "aXaXa \\E. one  two", " lead", "concatenate", None, "", "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = ["the quick", "the quick fox", "axa", "\\e.", "one  two", " lead", "cat", " ", None, "", "q", "the quick"]
    items = spark.createDataFrame(list(enumerate(wanted)), "item_id long, excerpt string")
    every = []
    for d, t in enumerate(texts):
        for i, x in enumerate(wanted):
            if t is not None and x:
                starts = [k for k in range(len(t)) if t.lower().startswith(x, k)]
                every += [(d, i, k, k + len(x), len(starts)) for k in starts]
    got = [tuple(r) for r in consensus.all_places(docs, items.where("excerpt <> ''")).select("doc_id", "item_id", "start", "end", "n").collect()]
    assert sorted(got) == sorted(every)
    first = {}
    for d, i, s, e, _ in every:
        first.setdefault((d, i), (s, e))
    first.update({(d, 9): (0, 0) for d, t in enumerate(texts) if t is not None})
    assert {(r.doc_id, r.item_id): (r.start, r.end) for r in consensus.locate(docs, items).collect()} == first


def test_penalties(spark):
    e = spark.createDataFrame([(1, "EXCERPT_MISMATCH", 4), (2, "EXCERPT_MISMATCH", 10), (2, "SEM_PROVA_DETERMINANTE", 10)], "run_id long, error_type string, n long")
    out = integrity.penalties(e).withColumn("adjusted", integrity.adjusted(F.lit(0.9), F.col("penalty"), F.col("ceiling")))
    rows = {r.run_id: r for r in out.collect()}
    assert rows[1].penalty == pytest.approx(0.20) and rows[1].ceiling == 0.65 and rows[1].adjusted == pytest.approx(0.65)
    assert rows[2].penalty == pytest.approx(0.40) and rows[2].adjusted == pytest.approx(0.50)


def test_check_citation(spark):
    text = "The tenant pays the rent on the first day of every month."
    rows = spark.createDataFrame([(text, "pays the rent", 11, 24), (text, "pays the rent", 30, 20), (text, "zebra quartz lion", 0, 20)], "t string, x string, s int, e int")
    found = [r.e for r in rows.select(integrity.check_citation(*[F.col(c) for c in "txse"]).alias("e")).collect()]
    assert found == [[], ["RANGE_INVALID"], ["EXCERPT_MISMATCH"]]


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 120_000), (2, "y" * 50_000)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.start, r.end) for r in pages.fixed_chunks(docs, 50_000, 2_500).collect())
    assert rows == [(1, 0, 50_000), (1, 47_500, 97_500), (1, 95_000, 120_000), (2, 0, 50_000)]


def test_greedy_chunks(spark):
    points = spark.createDataFrame([([0, 100, 220, 300, 460, 500],)], "p array<long>")
    found = points.select(pages.greedy_chunks(F.col("p"), 250, 50).alias("c")).first().c
    assert [(c["start"], c["end"]) for c in found] == [(0, 220), (220, 460), (460, 500)]


def test_page_batches_close_before_the_budget(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate((50, 60, 30, 200, 5))], "doc_id long, page_num long, n_chars long")
    assert [r.batch for r in pages.batches(rows, 100).orderBy("page_num").collect()] == [0, 1, 1, 2, 3]


def test_running_lines_leave_all_places_of_a_page(spark):
    rows = spark.createDataFrame([(1, i, f"Head\nbody {i}\nHead\nend {i}") for i in range(4)], "doc_id long, page_num long, text string")
    found = pages.running_lines(rows, edge=1)
    assert [(r.line, r.n) for r in found.collect()] == [("Head", 4)]
    assert pages.without_running_lines(rows, found).where("page_num = 2").first().text == "body 2\nend 2"


def test_profit_of_nothing_is_zero(spark):
    tx = spark.createDataFrame([], "user_id long, tx_id long, created_at timestamp, type string, amount long, cost_real long, status string")
    assert tuple(ledger.profit(tx, "2024-01-01", 30).first()) == (0, 0, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize(("message", "expected"), [("HTTP 429", "RATE_LIMIT"), ("timeout 429", "TIMEOUT"), ("", "UNKNOWN"), (None, "UNKNOWN")])
def test_classify_error(spark, message, expected):
    row = spark.createDataFrame([(message,)], "m string")
    assert row.select(telemetry.classify_error(F.col("m")).alias("c")).first().c == expected


def test_credits(spark):
    assert spark.range(1).select(ledger.credits(F.lit(2.71)).alias("c")).first().c == 542


def test_sequence_ratio_and_names(spark):
    laws = spark.createDataFrame([("Código Civil", "CC"), ("Código Penal", "CP")], "alias string, law string")
    names = spark.createDataFrame([("código civil",), ("Codigo Civil",), ("Zzz",)], "name string")
    found = {r.name: r.law for r in legal.resolve_names(names, laws).collect()}
    assert found == {"código civil": "CC", "Codigo Civil": "CC", "Zzz": None}


def test_names_are_compared_with_all_aliases_that_can_be_similar(spark):
    from difflib import SequenceMatcher

    aliases = ["decreto-lei n.o 53/2014", "economy anodized nickel", "abc", "ab", "xyzzy", "lei"]
    names = ["o decreto-lei n.o 53/2014", "promo anodized nickel", "bc", "cab", "axb", "zyzzy", "wlei", "q", ""]
    found = legal.resolve_names(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x, x) for x in aliases], "alias string, law string"))
    best = {}
    for x in names:
        ratio, law = min((-SequenceMatcher(None, x, a).ratio(), a) for a in aliases)
        best[x] = law if -ratio >= 0.8 else None
    assert {r.name: r.law for r in found.collect()} == best


def test_ids_are_unknown_without_their_start_in_a_known_id(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    cited = ids("item-00001-tail", "short", "shor", "item-00002-x", "other-0001", None)
    known = ids("prefix item-00001", "short", "shorter", "item-00002", None)
    unknown = integrity.unknown_prefixes(cited, known, "id")
    assert {r.id for r in unknown.collect()} == {"shor", "other-0001", None}
    assert integrity.unknown_prefixes(cited, ids(), "id").isEmpty()


def test_items_merge_and_weak_sources(spark):
    items = spark.createDataFrame([(1, "date", "Ção", 0, 3, "E1", 1), (1, "date", "cao", 5, 8, "E2", 2), (1, "date", "x", 9, 10, "E1", 3)], "doc_id long, item_type string, value string, s long, e long, extractor_id string, line long")
    rows = {r.n_items: r for r in merging.by_hash(items).collect()}
    assert rows[2].n_extractors == 2 and not rows[2].agreed and rows[1].agreed


def test_files(spark, tmp_path):
    for name, raw in (("a.txt", "ação".encode()), ("b.txt", "ação".encode("latin-1")), ("c.bin", b"x")):
        (tmp_path / name).write_bytes(raw)
    loaded = files.load(spark, str(tmp_path))
    assert {r.filename: (r.text, r.success) for r in loaded.collect()} == {"a.txt": ("ação", True), "b.txt": ("ação", True), "c.bin": (None, False)}
    assert {r.extension: r.loaded for r in files.load_stats(loaded).collect()} == {".txt": 2, ".bin": 0}


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k long, x string, y string")
    new = spark.createDataFrame([(2, "c", "r"), (3, "d", "s")], "k long, x string, y string")
    assert sorted(map(tuple, files.upserted(old, new, "k").collect())) == [(1, "a", "p"), (2, "c", "r"), (3, "d", "s")]
    patch = spark.createDataFrame([(1, None, "z")], "k long, x string, y string")
    assert sorted(map(tuple, files.patched(old, patch, "k").collect())) == [(1, "a", "z"), (2, "b", "q")]


CALLS = [("p", 0.0, 0, False), ("p", 1.0, 1, False), ("p", 2.0, 2, False), ("p", 30.0, 3, True), ("p", 62.0, 4, True), ("p", 63.0, 5, False)]
TRACE = [(0.0, True, "CLOSED"), (1.0, True, "CLOSED"), (2.0, True, "OPEN"), (30.0, False, "OPEN"), (62.0, True, "CLOSED"), (63.0, True, "CLOSED")]


def test_breaker(spark):
    calls = spark.createDataFrame(CALLS, "provider string, at double, seq int, success boolean")
    assert [(r.at, r.allowed, r.state) for r in streams.breaker_trace(calls).orderBy("at").collect()] == TRACE


def test_breaker_keeps_its_state_between_batches(spark, tmp_path):
    schema = "provider string, at double, seq int, success boolean"
    for i, part in enumerate((CALLS[:2], CALLS[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.breaker_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [(r.at, r.allowed, r.state) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()] == TRACE


def test_rate_windows_on_a_stream(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:00:10' + make_interval(0,0,0,0,0,0,id) ts, id % 2 user_id from range(10)").write.parquet(str(tmp_path / "in"))
    windows = streams.rate_windows(streams.event_stream(spark, str(tmp_path / "in")), "1 minute")
    query = windows.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.calls for r in spark.table("windows").collect()) == [5, 5]


def test_first_of_each_is_the_first_by_time(spark):
    from paperloom.streaming import streams

    rows = spark.createDataFrame([(1, "2026-01-02", 5), (1, "2026-01-01", 9), (1, "2026-01-01", 7), (None, "2026-01-03", 1)], "user_id long, ts string, n long")
    assert sorted((tuple(r) for r in streams.first_of_each(rows).collect()), key=str) == [(1, "2026-01-01", 7), (None, "2026-01-03", 1)]


def test_places_keep_lengths_and_blank_excerpts_are_nowhere(spark):
    docs = spark.createDataFrame([(1, "xİy abc"), (2, "abc ABC")], "doc_id long, text string")
    excerpts = spark.createDataFrame([("a", "abc"), ("b", ""), ("c", "  "), ("d", None)], "item_id string, excerpt string")
    assert sorted(tuple(r) for r in consensus.locate(docs, excerpts).collect()) == [(1, "a", 4, 7), (1, "b", 0, 0), (2, "a", 0, 3), (2, "b", 0, 0)]
    assert sorted((r.doc_id, r.start, r.n) for r in consensus.all_places(docs, excerpts).collect()) == [(1, 4, 1), (2, 0, 2), (2, 4, 2)]
