"""Files as tables and tables as files."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LARGEST = 100 * 1024 * 1024


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1, in which every byte is a character."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row a file under a folder or glob: name, extension, text (of .txt), size, sha-256; files that are
    too large or of another kind are rows with success false and an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    error = F.when(F.col("length") > LARGEST, "too large").when(~extension.isin(".txt", ".md", ".json"), "unsupported extension")
    text = F.when(error.isNull(), decoded(F.col("content")))
    out = raw.select(name.alias("filename"), extension.alias("extension"), text.alias("text"), F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"), error.alias("error"))
    return out.withColumns({"success": F.col("error").isNull(), "num_chars": F.length("text"), "num_words": F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))})


def load_stats(files: DataFrame) -> DataFrame:
    """S8."""
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.count_if("success").alias("loaded"))


def read_history(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """JSON files, the newest names first; broken ones are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)
    rows = rows.withColumn("file_name", F.col("_metadata.file_name"))
    return rows.orderBy(F.desc("file_name")) if most is None else rows.orderBy(F.desc("file_name")).limit(most)


def titled_runs(runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Title and date of runs from their metadata, else from the id (yyyyMMdd...)."""
    joined = runs.join(metadata, "run_id", "left")
    day = F.to_date(F.try_to_timestamp(F.substring("run_id", 1, 8), F.lit("yyyyMMdd")))
    return joined.select("run_id", F.coalesce("title", F.concat(F.lit("Análise "), F.col("run_id"))).alias("title"), F.coalesce("date", day).alias("date"))


def write_json(df: DataFrame, path: str, *by: str) -> None:
    """K1."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def markdown(items: DataFrame) -> DataFrame:
    """K2: items (doc_id, item_type, value) as a list grouped by type, in order."""
    groups = items.groupBy("doc_id", "item_type").agg(F.concat(F.lit("## "), F.first("item_type"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list("value")), lambda v: F.concat(F.lit("- "), v)), "\n")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("item_type", "part")))
    return groups.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("markdown"))


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """K3: old rows with new ones in place of those of the same key; to be written as a new snapshot."""
    return old.join(new.select(*keys).distinct(), [*keys], "left_anti").unionByName(new)


def patched(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """K5: columns of patch in place of the old ones where they are not null."""
    fresh = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in fresh])
    joined = old.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fresh else F.col(c) for c in old.columns])


def latest(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The last row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def stale(files: DataFrame, as_of: str, hours: int) -> DataFrame:
    """K6: files (path, modificationTime, length) that are older than so many hours, with their folders' sizes."""
    old = files.where(F.col("modificationTime") < F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {hours} hours"))
    return old.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
