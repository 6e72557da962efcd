"""Best-fit packing planned on a histogram of lengths (operator 8).

Pieces are counted by length; best-fit decreasing runs over the counts, where all bins that were filled alike are one
entry, so the plan has a few entries a length whatever the number of documents. Each entry is a run of slots for ranks
within a length; pieces get such ranks and join their slots.

Defined results: a null or empty text has the end id only, so one piece of length 1; repeated rows and rows that share a
doc_id are packed each on its own; an empty table gives no rows.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import written
from paperloom.llm.tokens import encoded, encoder

BLOCK = 256  # ranks of one length that share a join key
ROWS_A_SALT = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row_key long"


def _cutter(path: str, end_id: int, capacity: int):
    def cut(batches):
        e = encoder(path)
        end = np.array([end_id], "<u4")
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "row_key"]
        rows: list = []
        for batch, row, raw in encoded(path, batches):
            ids = np.concatenate([np.frombuffer(raw, e.width).astype("<u4"), end])
            doc, key = batch.column("doc_id")[row].as_py(), batch.column("row_key")[row].as_py()
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), key))
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)

    return cut


TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths: ([(length, first_rank, n, first_sequence, each, offset)], sequences).

    An entry places ranks first_rank to first_rank + n - 1 of a length: ``each`` of them into each sequence from
    first_sequence on, one behind the other from ``offset``.
    """
    out, sequences = [], 0
    room: list[int] = []  # sorted remaining capacities that have bins
    bins: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs (first sequence, how many)

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            if remaining not in bins:
                bins[remaining] = []
                at = np.searchsorted(room, remaining)
                room.insert(int(at), remaining)
            bins[remaining].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = int(np.searchsorted(room, length)) if room else 0
            if at < len(room):
                remaining = room[at]
                first, n = bins[remaining].pop()
                if not bins[remaining]:
                    del bins[remaining]
                    room.pop(at)
            else:  # new bins, as many as the rest needs
                remaining, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = remaining // length
            full = min(n, left // each)
            offset = capacity - remaining
            if full:
                out.append((length, rank, full * each, first, each, offset))
                rank, left = rank + full * each, left - full * each
                put(remaining - each * length, first, full)
            if full < n and left:  # the last bin of this length takes fewer than it could
                out.append((length, rank, left, first + full, left, offset))
                put(remaining - left * length, first + full, 1)
                full, left = full + 1, 0
            put(remaining, first + full, n - full)
    return out, sequences


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """pieces with ``rank`` from 0 within each length. Rows are dealt to salts by key, counted there, and the counts
    before a salt are added, so a length that a third of the rows share is in no task as a whole."""
    salts = max(1, -(-n // ROWS_A_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row_key", "piece", "doc_id"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("salt", "length").orderBy("doc_id", "piece", "row_key")
    return salted.withColumn("nth", F.row_number().over(within)).join(counts.drop("n"), ["salt", "length"]).select(*pieces.columns, (F.col("ahead") + F.col("nth") - 1).alias("rank"))


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """One row a piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row_key"))
    pieces = written(rows.mapInArrow(_cutter(path, end_id, capacity), PIECES), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots, _ = plan(histogram, capacity)
    schema = "length long, first_rank long, n long, first_sequence long, each long, offset0 long"
    planned = spark.createDataFrame(slots, schema)
    last = F.col("first_rank") + F.col("n") - 1
    planned = planned.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_rank") / BLOCK), F.floor(last / BLOCK))))
    placed = ranked(pieces, sum(histogram.values())).withColumn("block", F.floor(F.col("rank") / BLOCK))
    nth = F.col("rank") - F.col("first_rank")
    joined = placed.join(planned, ["length", "block"]).where((nth >= 0) & (nth < F.col("n")))
    return joined.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("offset0") + nth % F.col("each") * F.col("length")).alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: what is left is packed."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
