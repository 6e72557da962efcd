import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import budget

CALL = "run_id string, at timestamp, seq long, cost long, tokens long, external boolean"
BEGIN = datetime(2026, 1, 1)


def plain(rows, cost_limit, token_limit, idle):
    out, state = [], {}
    for run, at, seq, cost, tokens, external in sorted(rows, key=lambda r: (r[1], r[2])):
        c, t, blocked, last = state.get(run, (0, 0, False, None))
        if last is not None and at >= last + idle:
            c, t, blocked = 0, 0, False
        c, t = c + cost, t + tokens
        exceeded = c > cost_limit and not external
        out.append((run, at, seq, c, t, max(0, cost_limit - c), "blocked" if blocked else "exceeded" if exceeded else "ok", t > token_limit))
        state[run] = c, t, blocked or exceeded, at
    return sorted(out)


def some(n, seed=5):
    rng = random.Random(seed)
    for i in range(n):
        yield rng.choice("abc") + str(rng.randrange(3)), BEGIN + timedelta(seconds=20 * i + rng.randrange(400)), i, rng.randrange(1, 60), rng.randrange(100), rng.random() < 0.2


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_batch_form(spark):
    rows = list(some(300))
    df = spark.createDataFrame(rows, CALL)
    idle = timedelta(minutes=6)
    assert rows_of(budget.guarded(df, 150, 400, "6 minutes")) == plain(rows, 150, 400, idle)
    assert {r[6] for r in plain(rows, 150, 400, idle)} == {"ok", "exceeded", "blocked"}


def test_nulls(spark):
    df = spark.createDataFrame([(None, BEGIN, 1, None, None, None), ("a", None, 2, 5, 5, False), ("a", BEGIN, 3, 11, 1, True), ("a", BEGIN, 4, 0, 1, False), ("a", BEGIN, 5, 0, 1, False)], CALL)
    assert [(r.run_id, r.cost_total, r.status) for r in budget.guarded(df, 10, 10).orderBy("seq").collect()] == [("", 0, "ok"), ("a", 11, "ok"), ("a", 11, "exceeded"), ("a", 11, "blocked")]


def test_stream_gives_the_rows_of_the_batch_once_each_over_a_restart(spark, tmp_path):
    rows = list(some(240))
    flush = [(f"z{i}", BEGIN + timedelta(days=2 + i), 1000 + i, 0, 0, False) for i in range(3)]
    shuffled = sorted(rows, key=lambda r: r[1] + timedelta(seconds=hash((r[2], 7)) % 300))  # late by five minutes at most
    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))
    parts = [shuffled[i : i + 60] for i in range(0, 240, 60)] + [[f] for f in flush]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:  # a query of its own for each file: all state comes back from the checkpoint
            spark.createDataFrame(part, CALL).coalesce(1).write.mode("append").parquet(source)
            stream = budget.guarded_stream(spark.readStream.schema(CALL).parquet(source), 150, 400, "6 minutes", "10 minutes")
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [r for r in rows_of(spark.read.parquet(out)) if not r[0].startswith("z")]
    assert got == plain(rows, 150, 400, timedelta(minutes=6))
    assert got == rows_of(budget.guarded(spark.createDataFrame(rows, CALL), 150, 400, "6 minutes"))
