"""Append-only facts with each batch in them once (K4).

A batch is written to a folder of its own, named by its stream and number, over whatever an attempt that failed has left there;
then its row is written to the manifest. Readers see batches of the manifest only. So a batch that fails between the two steps
shows nothing, one that is replayed after its commit adds nothing, and a replay that splits the rows of an uncommitted batch
otherwise leaves no rest of the first attempt. Batches don't lock each other; many streams may share a folder of facts.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stream string, batch long, n_rows long"


def _place(folder: str, kind: str, stream: str, batch: int) -> str:
    return f"{folder.rstrip('/')}/{kind}/stream={stream}/batch={batch}"


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(stream, batch, n_rows) of the batches that count."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)  # nothing was ever committed


def append(rows: DataFrame, folder: str, stream: str, batch: int, between: Callable[[], None] = lambda: None) -> bool:
    """Appends a batch unless it is committed; whether it did. between: runs after the rows and before the commit."""
    spark = rows.sparkSession
    if not committed(spark, folder).where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty():
        return False
    data = _place(folder, "facts", stream, batch)
    rows.write.mode("overwrite").parquet(data)
    between()
    n = spark.read.schema(rows.schema).parquet(data).count()
    spark.range(1).select(F.lit(n).cast("long").alias("n_rows")).coalesce(1).write.mode("overwrite").parquet(_place(folder, "manifest", stream, batch))
    return True


def facts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All facts of committed batches, with stream and batch."""
    try:
        rows = spark.read.schema(f"{schema}, stream string, batch long").parquet(f"{folder.rstrip('/')}/facts")
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, stream string, batch long")
    return rows.join(committed(spark, folder).select("stream", "batch"), ["stream", "batch"], "left_semi").select(*(f.name for f in rows.schema))


def sink(folder: str, stream: str, between: Callable[[], None] = lambda: None):
    """For ``writeStream.foreachBatch``."""

    def write(rows: DataFrame, batch: int) -> None:
        append(rows, folder, stream, batch, between)

    return write
