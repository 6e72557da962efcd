"""Exact token counts from a length histogram (operator 9).

Documents are encoded and aggregated by encoded length. Suffix sums over the histogram answer, for every context limit
that is a length in the corpus, how many documents are longer, the tokens left when documents are cut there, and how far
up in the corpus the length stands. ``at_limits`` reads any other limits off the same sums.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import written
from paperloom.llm.tokens import encoded, encoder

BLOCK = 1024  # lengths whose sums are made together; totals of blocks are summed first


def _measurer(path: str):
    def measure(batches):
        width = encoder(path).width.itemsize
        lengths: list = []
        for _, _, ids in encoded(path, batches):
            lengths.append(len(ids) // width)
            if len(lengths) >= 10_000:
                yield _counted(lengths)
                lengths = []
        if lengths:
            yield _counted(lengths)

    return measure


def _counted(lengths: list) -> pa.RecordBatch:
    values, n = np.unique(np.array(lengths, np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["length", "n_docs"])


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """(length, n_docs) of the encoded texts; each task counts its own rows first."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_measurer(path), "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def summed(counts: DataFrame) -> DataFrame:
    """For each length as a context limit: n_docs of that length, n_longer, total_tokens of all documents,
    truncated_tokens if all are cut there, lost_tokens, and share_at_most, the share of documents that fit."""
    blocks = counts.withColumn("block", F.floor(F.col("length") / BLOCK))
    tokens = F.col("length") * F.col("n_docs")
    sums = blocks.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum(tokens).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    everything = Window.partitionBy()
    sums = sums.select(
        "block",
        F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("n").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    above = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    n_longer = F.col("n_after") + F.coalesce(F.sum("n_docs").over(above), F.lit(0))
    t_longer = F.col("t_after") + F.coalesce(F.sum(tokens).over(above), F.lit(0))
    out = blocks.join(F.broadcast(sums), "block").withColumn("n_longer", n_longer).withColumn("t_longer", t_longer)
    lost = F.col("t_longer") - F.col("n_longer") * F.col("length")
    return out.select(
        "length",
        "n_docs",
        "n_longer",
        "total_tokens",
        (F.col("total_tokens") - lost).alias("truncated_tokens"),
        lost.alias("lost_tokens"),
        ((F.col("all_docs") - F.col("n_longer")) / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_longer, truncated_tokens) of the given limits, which need not be lengths in the corpus: from
    the longest length that fits, each longer document has (limit - length) tokens more."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    below = sums.join(F.broadcast(wanted), F.col("length") <= F.col("context_limit"))
    best = below.groupBy("context_limit").agg(F.max_by(F.struct("length", "n_longer", "truncated_tokens"), "length").alias("b"))
    totals = sums.agg(F.sum("n_docs").alias("all_docs"))
    out = wanted.join(best, "context_limit", "left").crossJoin(F.broadcast(totals))
    n_longer = F.coalesce("b.n_longer", "all_docs")
    fits = F.coalesce("b.truncated_tokens", F.lit(0)) + n_longer * (F.col("context_limit") - F.coalesce("b.length", F.lit(0)))
    return out.select("context_limit", n_longer.alias("n_longer"), fits.alias("truncated_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(length,): the least length that at least the share q of all documents do not exceed."""
    return sums.where(F.col("share_at_most") >= q).agg(F.min("length").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: suffix sums for every length that occurs."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return summed(written(histogram(docs, public_tokenizers.path("byte_bpe_50k.json")), "histogram"))
