import pytest
from pyspark.errors import StreamingQueryException

from paperloom.streaming import facts

FACT = "run_id string, cost long"


def shown(spark, folder):
    return sorted((r.run_id, r.cost, r.stream, r.batch) for r in facts.facts(spark, folder, FACT).collect())


def rows(spark, *given):
    return spark.createDataFrame(list(given), FACT)


class Broken(Exception):
    pass


def fail():
    raise Broken("between write and commit")


def test_batches_count_once(spark, tmp_path):
    folder = str(tmp_path / "f")
    assert shown(spark, folder) == [] and facts.committed(spark, folder).isEmpty()
    assert facts.append(rows(spark, ("a", 1), ("a", 1), (None, None)).repartition(3), folder, "s", 0)
    assert not facts.append(rows(spark, ("a", 1), ("a", 1), (None, None)), folder, "s", 0)
    assert facts.append(rows(spark, ("b", 2)), folder, "t", 0)  # another stream's batch 0
    assert facts.append(rows(spark), folder, "s", 1)
    want = [("a", 1, "s", 0), ("a", 1, "s", 0), ("b", 2, "t", 0), (None, None, "s", 0)]
    got = facts.facts(spark, folder, FACT).collect()
    assert sorted(((r.run_id, r.cost, r.stream, r.batch) for r in got), key=str) == sorted(want, key=str)
    assert sorted((r.stream, r.batch, r.n_rows) for r in facts.committed(spark, folder).collect()) == [("s", 0, 3), ("s", 1, 0), ("t", 0, 1)]


def test_a_failure_between_write_and_commit_shows_nothing_and_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "f")
    facts.append(rows(spark, ("a", 1)), folder, "s", 0)
    with pytest.raises(Broken):
        facts.append(rows(spark, ("b", 2), ("b", 3)).repartition(2), folder, "s", 1, fail)
    assert shown(spark, folder) == [("a", 1, "s", 0)]
    assert facts.append(rows(spark, ("b", 2)), folder, "s", 1)  # the replay has other rows
    assert shown(spark, folder) == [("a", 1, "s", 0), ("b", 2, "s", 1)]


def test_a_stream_that_fails_once_and_starts_again(spark, tmp_path):
    source, folder, state = (str(tmp_path / x) for x in ("source", "facts", "state"))
    given = [(f"r{i}", i) for i in range(40)]
    for part in range(4):
        spark.createDataFrame(given[part * 10 : part * 10 + 10], FACT).coalesce(1).write.mode("append").parquet(source)
    calls = []

    def once():
        calls.append(1)
        if len(calls) == 2:
            fail()

    def run():
        stream = spark.readStream.schema(FACT).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.writeStream.foreachBatch(facts.sink(folder, "calls", once)).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(StreamingQueryException):
        run()
    assert len(shown(spark, folder)) == 10
    run()
    run()
    assert sorted((r, c) for r, c, *_ in shown(spark, folder)) == sorted(given)
    assert len(calls) == 5
