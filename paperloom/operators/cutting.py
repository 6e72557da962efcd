"""Texts cut into pages and zones as tables, and the chunkers as table functions of SQL.

Defined results: a null or empty text has no rows; a text under the zones' threshold has no zones; rows that repeat a doc_id are
cut each. One text is one task's work, in time linear in its characters.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import cuts

PAGE = "doc_id long, page_num int, start long, end long"
ZONE = "doc_id long, zone int, start long, end long, page_first int, page_last int"


def _mapped(rows: DataFrame, columns: list[str], cut, names: list[str], kind: str) -> DataFrame:
    """Rows (doc_id, number from 1, *what cut gives) for each row's columns."""

    def run(batches):
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, doc_id in enumerate(doc_ids):
                found = list(cut(*(batch.column(c)[i].as_py() for c in columns)))
                if found:
                    values = [pa.array([doc_id] * len(found), pa.int64()), pa.array(range(1, len(found) + 1), pa.int32())]
                    values += [pa.array(x, pa.int64() if k < 2 else pa.int32()) for k, x in enumerate(zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays(values, names)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).mapInArrow(run, kind)


def synthetic_pages(docs: DataFrame, size: int = cuts.PAGE) -> DataFrame:
    """Pages of ``size`` characters at most, cut behind line breaks."""
    return _mapped(docs, ["text"], lambda text: cuts.synthetic_pages(text or "", size), ["doc_id", "page_num", "start", "end"], PAGE)


def zones(docs: DataFrame, pages: DataFrame | None = None, threshold: int = cuts.ZONE_THRESHOLD, size: int = cuts.ZONE, overlap: int = cuts.ZONE_OVERLAP, most: int = cuts.MOST_ZONES) -> DataFrame:
    """The zones of long texts, by pages (doc_id, page_num, page_start, page_end) where a document has any."""
    rows = docs.select("doc_id", "text").where(F.length("text") > threshold)
    if pages is None:
        rows = rows.withColumn("bounds", F.array().cast("array<struct<page_start:bigint,page_end:bigint>>"))
    else:
        bound = F.struct("page_num", *(F.col(c).cast("long").alias(c) for c in ("page_start", "page_end")))
        own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(bound)).alias("bounds"))  # as many as the text has pages
        rows = rows.join(own, "doc_id", "left")

    def cut(text, bounds):
        return cuts.zones(text, [(b["page_start"], b["page_end"]) for b in bounds or []], threshold, size, overlap, most)

    return _mapped(rows, ["text", "bounds"], cut, ["doc_id", "zone", "start", "end", "page_first", "page_last"], ZONE)


class Chunks:
    """G1 as a table function: (chunk_index, start, end) of a text."""

    def eval(self, text: str, size: int, overlap: int):
        for i, (start, end) in enumerate(cuts.fixed_chunks(len(text or ""), size, overlap)):
            yield i, start, end


class Pages:
    """G3 as a table function: (page_num, start, end) of a text."""

    def eval(self, text: str, size: int):
        for i, (start, end) in enumerate(cuts.synthetic_pages(text or "", size), 1):
            yield i, start, end


class Matches:
    """X6 as a table function: (start, end, text) of all places of a pattern."""

    def eval(self, text: str, pattern: str):
        for m in re.finditer(pattern, text or ""):
            yield m.start(), m.end(), m[0]


class Batches:
    """W15 as a table function over a table partitioned by document and ordered: each page's number with its batch of at
    most ``budget`` characters."""

    def __init__(self):
        self.used, self.batch = 0, 0

    def eval(self, row, budget: int):
        n = row["n_chars"] or 0
        if self.used > 0 and self.used + n > budget:
            self.used, self.batch = 0, self.batch + 1
        self.used += n
        yield row["doc_id"], row["page_num"], self.batch


FUNCTIONS = {
    "text_chunks": (Chunks, "chunk_index: int, start: int, end: int"),
    "text_pages": (Pages, "page_num: int, start: int, end: int"),
    "text_matches": (Matches, "start: int, end: int, text: string"),
    "page_batches": (Batches, "doc_id: long, page_num: long, batch: int"),
}


def register(spark: SparkSession) -> None:
    """V9: names the table functions, for ``from documents, lateral text_chunks(text, 5000, 500)`` and the like."""
    for name, (function, kind) in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(function, returnType=kind))
