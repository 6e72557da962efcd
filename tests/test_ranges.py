"""Range joins against comparing all pairs, and how many rows they compare."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import consensus, intervals, ranges


def some(rng, n, span, longest):
    for i in range(n):
        s = rng.randrange(-span, span)
        yield rng.randrange(3), i, s, s + int(rng.random() ** 4 * longest) - (1 if i % 20 == 0 else 0)


@pytest.mark.parametrize("bits", [0, 3, 6])
def test_joins_find_all_pairs_once(spark, bits):
    rng = random.Random(bits)
    a, b = list(some(rng, 150, 300, 400)), list(some(rng, 150, 300, 400))
    frame = lambda rows: spark.createDataFrame([*rows, (None, -1, 0, 9), (1, -2, None, 9)], "doc_id long, id long, s long, e long")
    x, y = frame(a), frame(b)
    got = sorted((r[0], r[1]) for r in ranges.contained(x, y, "doc_id", "s", bits=bits).select("p.id", "r.id").collect())
    assert got == sorted((i, j) for d, i, at, _ in a for k, j, s, e in b if d == k and s <= at < e)
    got = sorted((r[0], r[1]) for r in ranges.overlapping(x, y, "doc_id", bits=bits).select("a.id", "b.id").collect())
    assert got == sorted((i, j) for d, i, s, e in a for k, j, u, v in b if d == k and s < v and e > u)


def test_rows_compared_follow_rows_and_hits(spark):
    """One document of a million ranges, and one range over all of them."""
    n = 1_000_000
    r = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id"), (F.col("id") * 40).alias("s"), (F.col("id") * 40 + 30).alias("e"))
    long = spark.createDataFrame([(1, -1, 0, 40 * n)], "doc_id long, id long, s long, e long")
    p = spark.range(0, n, 100).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 40 + 7).alias("at"))
    joined = ranges.contained(p, r.unionByName(long), "doc_id", "at")
    assert joined.count() == 2 * n // 100
    key = ["_k", "level", "node"]
    nodes = r.select(F.col("doc_id").alias("_k"), F.inline(ranges._nodes("s", "e", ranges.BITS)))
    assert nodes.count() < 2 * n and nodes.groupBy(*key).count().agg(F.max("count")).first()[0] < 10
    assert long.select(F.inline(ranges._nodes("s", "e", ranges.BITS))).count() < 60


def test_chunks_entities_tables_pages_and_images(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 80, 180), (1, 2, 160, 200), (2, 0, 0, 10)], "doc_id long, chunk_id long, s long, e long")
    entities = spark.createDataFrame([(1, "a", 10, 20), (1, "b", 90, 95), (1, "c", 99, 101), (1, "d", 200, 210), (3, "x", 0, 5)], "doc_id long, entity_id string, s long, e long")
    refs = {(r.doc_id, r.chunk_id): r.entity_refs for r in ranges.entity_refs(chunks, entities).collect()}
    assert refs == {(1, 0): ["a", "b", "c"], (1, 1): ["b", "c"], (1, 2): [], (2, 0): []}
    tables = {(r.doc_id, r.chunk_id): r.contains_table for r in ranges.with_tables(chunks, entities.where("entity_id = 'c'")).collect()}
    assert tables == {(1, 0): True, (1, 1): True, (1, 2): False, (2, 0): False}
    pages = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 150), (1, 3, 150, 190)], "doc_id long, page_num long, page_start long, page_end long")
    at = ranges.chunk_pages(chunks, pages)
    assert {(r.doc_id, r.chunk_id): (r.page_start, r.page_end) for r in at.collect()} == {(1, 0): (1, 1), (1, 1): (1, 3), (1, 2): (3, 1), (2, 0): (1, 1)}
    images = spark.createDataFrame([(1, 1, "i"), (1, 3, "j"), (2, 5, "k")], "doc_id long, page_num long, image string")
    some_pages = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 1, 3), (1, 2, None, 3), (2, 0, 1, 4)], "doc_id long, chunk_id long, page_start long, page_end long")
    got = sorted((r.doc_id, r.chunk_id, r.image) for r in ranges.chunk_images(some_pages, images).collect())
    assert got == [(1, 0, "i"), (1, 1, "i"), (1, 1, "j"), (1, 2, "i"), (1, 2, "j")]


def test_users_of_range_joins_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(d, f"A{rng.randrange(4)}", i, s, e) for d, i, s, e in some(rng, 200, 200, 90)]
    f = spark.createDataFrame(rows, "doc_id long, auditor_id string, finding_id long, s long, e long")
    got = sorted((r.a, r.b, r.shared) for r in consensus.overlap_edges(f).collect())
    pairs = [(x, y, min(x[4], y[4]) - max(x[3], y[3])) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1]]
    assert got == sorted((x[2], y[2], n) for x, y, n in pairs if n > 0 and n >= 0.3 * min(x[4] - x[3], y[4] - y[3]))
    other = f.where("auditor_id = 'A0'")
    got = sorted(r.finding_id for r in intervals.anti_overlap(f.where("auditor_id <> 'A0'"), other).collect())
    assert got == sorted(x[2] for x in rows if x[1] != "A0" and not any(y[1] == "A0" and x[0] == y[0] and x[3] < y[4] and x[4] > y[3] for y in rows))
    index = f.select("doc_id", F.col("finding_id").alias("index"), "s", "e")
    points = f.select("doc_id", F.col("finding_id").alias("point_id"), F.col("e").alias("at"))
    got = {(r.doc_id, r.point_id): r["index"] for r in intervals.first_container(points, index, -1).collect()}
    assert got == {(x[0], x[2]): min([y[2] for y in rows if x[0] == y[0] and y[3] <= x[4] < y[4]], default=-1) for x in rows}


def test_partitions_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 10)
    points = spark.range(1000).selectExpr("id % 50 as doc_id", "id as point_id", "id % 9 as at")
    pages = spark.range(50).selectExpr("id as doc_id", "1L as page_num", "0L as page_start")
    assert intervals.floor_page(points, pages).rdd.getNumPartitions() == 100


def test_images_of_chunks_of_known_length_need_no_job(spark, monkeypatch):
    monkeypatch.setattr(ranges, "_levels", None)
    chunks = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 2, None)], "doc_id long, chunk_id long, page_start long, page_end long")
    images = spark.createDataFrame([(1, p, f"i{p}") for p in (1, 2, 3)], "doc_id long, page_num long, image string")
    got = sorted((r.chunk_id, r.image) for r in ranges.chunk_images(chunks, images, 5).collect())
    assert got == [(0, "i1"), (0, "i2"), (1, "i1"), (1, "i2"), (1, "i3")]
