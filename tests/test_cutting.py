import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import cuts
from paperloom.operators import cutting, pages


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=80), st.integers(1, 12))
def test_synthetic_pages_tile_the_text(text, size):
    found = list(cuts.synthetic_pages(text, size))
    assert "".join(text[s:e] for s, e in found) == text
    for s, e in found:
        assert 0 < e - s <= size
        rest = text[s : min(s + size, len(text))]
        if e < len(text) and "\n" in rest[1:]:
            assert text[e - 1] == "\n" and "\n" not in text[e : s + size]


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=120), st.integers(2, 30), st.integers(0, 9))
def test_zones_cover_the_text_and_overlap(text, size, overlap):
    found = list(cuts.zones_by_characters(text, size, overlap))
    assert all(0 < e - s <= size for s, e in found)
    assert [s for s, _ in found] == sorted({s for s, _ in found})
    if overlap < size // 2:
        assert set(range(len(text))) == {i for s, e in found for i in range(s, e)}


def test_zones_by_pages():
    text, bounds = "x" * 100, [(0, 30), (30, 55), (55, 60), (60, 100)]
    assert list(cuts.zones_by_pages(100, bounds, 60, 5)) == [(0, 65, 1, 3), (55, 100, 4, 4)]
    assert cuts.zones(text, bounds, 50, 60, 5) == [(0, 65, 1, 4), (55, 100, 3, 4)]
    assert cuts.zones(text, bounds, 100) == []
    assert cuts.zones(text, [], 50, 40, 0, 10) == [(0, 40, None, None), (40, 80, None, None), (80, 100, None, None)]
    assert len(cuts.zones(text, [(i, i + 1) for i in range(100)], 50, 2, 0, 10)) == 10


def folded(points, target, overlap):
    """The definition, with all points looked through for each chunk."""
    out, cs, ce = [], points[0], points[0]
    for p in points:
        if p - cs > target and ce > cs:
            out.append((cs, ce))
            cs = next((q for q in points if ce - overlap <= q < ce and q > cs), ce)
        ce = p
    return out + [(cs, ce)] if ce > cs else out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=25, unique=True).map(sorted), st.integers(1, 30), st.integers(0, 15))
def test_greedy_chunks(points, target, overlap):
    assert list(cuts.greedy(points, target, overlap)) == folded(points, target, overlap)


def test_long_texts_are_cut_in_linear_time():
    rng = random.Random(1)
    seconds = []
    for n in (1_000_000, 4_000_000):
        text = "".join(rng.choice(["word ", "line\n", "end\n\n"]) for _ in range(n // 5))
        began = time.perf_counter()
        assert sum(1 for _ in cuts.synthetic_pages(text, 300)) > n // 400
        assert sum(1 for _ in cuts.zones_by_characters(text, 2000, 100)) > n // 2500
        assert sum(1 for _ in cuts.greedy(range(0, len(text), 20), 1000, 100)) > n // 1300
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 10 * seconds[0] + 0.5


def test_tables(spark):
    docs = spark.createDataFrame([(1, "ab\ncd\nef"), (2, ""), (3, None), (None, "x" * 7), (1, "abc")], "doc_id long, text string")
    got = sorted(map(tuple, cutting.synthetic_pages(docs, 5).collect()), key=str)
    assert got == sorted([(1, 1, 0, 3), (1, 2, 3, 8), (None, 1, 0, 5), (None, 2, 5, 7), (1, 1, 0, 3)], key=str)
    pages_of = spark.createDataFrame([(1, 2, 4, 8), (1, 1, 0, 4)], "doc_id long, page_num int, page_start int, page_end int")
    got = sorted(map(tuple, cutting.zones(docs, pages_of, 5, 4, 1).collect()), key=str)
    assert got == sorted([(1, 1, 0, 5, 1, 2), (1, 2, 3, 8, 1, 2), (None, 1, 0, 4, None, None), (None, 2, 3, 7, None, None), (None, 3, 6, 7, None, None)], key=str)
    chunked = docs.limit(1).select(pages.greedy_chunks(F.array(*map(F.lit, (0, 4, 9, 12, 30))), 10, 5).alias("c")).first().c
    assert [tuple(c) for c in chunked] == folded([0, 4, 9, 12, 30], 10, 5)


@pytest.mark.parametrize("call, want", [("text_chunks('abcdefgh', 4, 1)", [(0, 0, 4), (1, 3, 7), (2, 6, 8)]), ("text_pages('ab\\ncd', 4)", [(1, 0, 3), (2, 3, 5)]), ("text_matches('a12b3', '[0-9]+')", [(1, 3, "12"), (4, 5, "3")]), ("text_chunks(cast(null as string), 4, 1)", [])])
def test_table_functions(spark, call, want):
    cutting.register(spark)
    assert [tuple(r) for r in spark.sql(f"select * from {call}").collect()] == want


def test_table_function_over_partitions(spark):
    cutting.register(spark)
    rows = [(d, n, 10 * (n % 4)) for d in (1, 2) for n in range(20)]
    spark.createDataFrame(rows, "doc_id long, page_num long, n_chars long").repartition(7).createOrReplaceTempView("some_pages")
    got = sorted(map(tuple, spark.sql("select * from page_batches(table(some_pages) partition by doc_id order by (page_num), 45)").collect()))
    want = sorted(map(tuple, pages.batches(spark.table("some_pages"), 45).collect()))
    assert got == want and len(got) == 40
