"""Changes between two versions of a text."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.line_diff import changes

CHANGE = "doc_id long, change int, line_num int, original string, replacement string, change_type string"


def line_changes(pairs: DataFrame) -> DataFrame:
    """Each changed line of pairs (doc_id, original, cleaned), numbered in order within its pair. A null text is an
    empty one; equal texts have no rows, whatever their length; rows that repeat are answered each."""

    def run(batches):
        for batch in batches:
            for doc_id, old, new in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "original", "cleaned")), strict=True):
                found = list(changes(old or "", new or ""))
                if found:
                    lines, olds, news, kinds = zip(*found, strict=True)
                    columns = [pa.array([doc_id] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(lines, pa.int32()), *(pa.array(x, pa.string()) for x in (olds, news, kinds))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "change", "line_num", "original", "replacement", "change_type"])

    differ = ~F.coalesce("original", F.lit("")).eqNullSafe(F.coalesce("cleaned", F.lit("")))
    return pairs.where(differ).select(F.col("doc_id").cast("long").alias("doc_id"), "original", "cleaned").mapInArrow(run, CHANGE)


def change_counts(changed: DataFrame) -> DataFrame:
    """How many changes of each kind each document has."""
    return changed.groupBy("doc_id", "change_type").agg(F.count("*").alias("n"))
