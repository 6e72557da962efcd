"""The folder that driver and executors share, tables written there, and row keys."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)  # stands for a null doc_id in join keys
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder in ``spark.checkpoint.dir``; where it is unset (tests), a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back. The write's shuffle files go when it has
    ended, not when the driver's memory is next collected; nothing else reads them, as a write has a plan of its own."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written``, once all that is read from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def apart(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text renamed, so that no name of theirs can clash."""
    return docs.select(*(F.col(f"`{c}`").alias(_apart(i, c)) for i, c in enumerate(docs.columns)))


def restored(docs: DataFrame, *replaced: str) -> list:
    """The columns of docs, from what ``apart`` renamed, but for the replaced ones."""
    return [F.col(_apart(i, c)).alias(c) for i, c in enumerate(docs.columns) if c not in replaced]


def _apart(i: int, name: str) -> str:
    return name if name in ("doc_id", "text") else f"column_{i}"


def keyed_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(_k, _t, doc_id, text, *more): rows of one doc_id and text share their key, and nulls can be joined on."""
    return docs.select(
        keyed_id().alias("_k"),
        F.xxhash64(F.lit(0), F.col("text")).alias("_t"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def key_of(shown: str = "_k"):
    """The doc_id behind a key, null again where it was null."""
    return F.when(F.col(shown) != NULL_ID, F.col(shown))
