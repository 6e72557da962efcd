"""The pipeline's stages against plain versions, each judged on what its predecessor kept."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from paperloom.llm.shared import written
from tests.llm import brute
from tests.llm.conftest import SF

STAGES = dict(corpus_pipeline.STAGES)


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_are_in_order():
    assert list(STAGES) == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_each_stage(spark, odd, line_links, where):
    folder = {"sf": SF, "odd": odd}[where]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = pairs(docs)
    docs = written(STAGES["quality"](spark, docs, folder), "quality")
    now = pairs(docs)
    assert set(now) <= set(before) and docs.columns == columns
    links = line_links(docs)
    docs = written(STAGES["line_dedup"](spark, docs, folder), "lines")
    plain = [(d, t) for (d, _), (_, n, t) in zip(now, brute.deduped_lines(now, links), strict=True) if not n or t.strip(" \t\n\x0b\f\r")]
    assert pairs(docs) == sorted(plain) and docs.columns == columns
    now = pairs(docs)
    docs = written(STAGES["near_dedup"](spark, docs, folder), "near")
    assert pairs(docs) == [x for i, (x, (_, root)) in enumerate(zip(now, brute.near_duplicates(now, 5), strict=True)) if i == root] and docs.columns == columns
    now = pairs(docs)
    docs = written(STAGES["decontaminate"](spark, docs, folder), "clean")
    t = pq.read_table(f"{folder}/benchmark.parquet")
    judged = brute.decontamination_rows(now, list(zip(map(str, t["item_id"].to_pylist()), t["text"].to_pylist(), strict=True)))
    assert pairs(docs) == [x for x, j in zip(now, judged, strict=True) if not j[-1]] and docs.columns == columns
    packed = STAGES["packing"](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in pairs(docs)}


def test_run_over_repeated_and_empty_tables(spark, repeated, empty):
    assert corpus_pipeline.run(spark, repeated).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
