"""Operator 13 against scores of all pairs."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperloom.llm import hard_negatives
from tests.llm.conftest import SF

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    """rows: (vec_id, label, vector), of distinct vec_ids."""
    valid = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    valid = [(i, (c + 1) % 10 if i % 7 == 0 else c, v) for i, c, v in valid]
    for i, c, v in valid:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, d, w in valid if j != i)
        for s, p, _ in [x for x in scored if x[2] == c][:5]:
            fits = [x for x in scored if x[2] != c and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            for rank, (t, n, _) in enumerate(fits, 1):
                yield i, p, rank, n, -s, -t


def table(folder, rows):
    ids, labels, vectors = zip(*rows, strict=True) if rows else ((), (), ())
    extra = {c: [0] * len(rows) for c in ("v", "leaf", "keys", "low", "rank", "file")}
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array(labels, pa.int64()), **extra}), folder / "embeddings.parquet")
    return str(folder)


def rows_of(folder):
    t = pq.read_table(f"{folder}/embeddings.parquet")
    return list(zip(*(t[c].to_pylist() for c in ("vec_id", "label", "embedding")), strict=True))


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def clustered(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(i, int(rng.integers(0, 4)), (scale * (centres[i % 8] + 0.5 * rng.normal(size=dim))).tolist()) for i in range(n)]


def test_query_on_the_test_table(spark):
    assert rows(hard_negatives.query(spark, SF)) == sorted(plain(rows_of(SF)))


def test_odd_vectors_ties_and_repeats(spark, tmp_path):
    given = clustered(300, 3, 1)
    given += [(i, i % 3, [0.25, -0.5, 1.0]) for i in range(300, 420)]  # ties
    given += [(500, 1, None), (501, None, [1.0, 1.0, 1.0]), (502, 1, [1.0, None, 1.0]), (503, 1, [float("nan"), 1.0, 1.0]), (504, 1, [float("inf"), 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (600, 1, [0.0, 0.0, 0.0]), (700, 77, [1.0, 1.0, 1.0]), (-100, 2, [0.3, 0.1, 0.9])]
    want = sorted(plain(given))
    assert len(want) > 100
    more = [given[0], given[310], (800, 1, [1.0, 1.0]), (801, 1, [1e30, 1.0, 1.0])]
    assert rows(hard_negatives.query(spark, table(tmp_path, given + more))) == want


@pytest.mark.parametrize("scale", [0.05, 1.0, 3000.0])
def test_deep_trees_and_salted_leaves(spark, tmp_path, scale):
    given = clustered(1500, 4, 3, scale)
    folder = table(tmp_path, given)
    ids = hard_negatives.integers(spark.read.parquet(f"{folder}/embeddings.parquet")).where("vec_id % 100 = 0 or vec_id % 7 <> 0")
    kept = [r for r in given if r[0] % 100 == 0 or r[0] % 7]
    want = sorted(plain([(i, c - 1 if i % 7 == 0 else c, v) for i, c, v in kept]))
    for sample in (4096, 64):
        assert rows(hard_negatives.mine(ids, ids.where("vec_id % 100 = 0"), sample=sample, rows_a_block=100)) == want


def test_search_leaves_rows_out(spark):
    """In few dimensions most buckets stay closed."""
    x = (np.random.default_rng(5).normal(size=(4000, 2)) * 256).astype(np.int64)
    longest = int((x * x).sum(1).max())
    block = hard_negatives.Block.loaded(hard_negatives.Block.of(np.arange(4000), np.arange(4000) % 2, x, longest).saved())
    opened = []
    inner = hard_negatives.inner

    def counting(a, b):
        opened.append(len(a) * len(b))
        return inner(a, b)

    hard_negatives.inner = counting
    try:
        one = lambda v: np.array([v])
        window, ids, scores = block.search(one(0), one(0), x[:1], one(0), one(-(2**62)), one(2**62), 5, True)
    finally:
        hard_negatives.inner = inner
    every = x @ x[0]
    mine = [i for i in np.lexsort((np.arange(4000), -every)) if i % 2 == 0 and i != 0][:5]
    assert window.tolist() == [0] * 5 and ids.tolist() == mine and scores.tolist() == every[mine].tolist()
    assert sum(opened) < 1500


def test_empty_and_single(spark, tmp_path):
    assert hard_negatives.query(spark, table(tmp_path, [])).count() == 0
    assert hard_negatives.query(spark, table(tmp_path, [(100, 1, [1.0, 2.0])])).count() == 0
    assert hard_negatives.query(spark, table(tmp_path, [(100, 1, []), (200, 1, [])])).count() == 0
