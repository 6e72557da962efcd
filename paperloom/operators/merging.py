"""Merging the output of several extractors."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import semantic_hash
from paperloom.operators.ranges import dealt


def by_hash(items: DataFrame) -> DataFrame:
    """Items (doc_id, item_type, value, s, e, extractor_id) of one semantic hash are one, with all their spans;
    agreed: one distinct value without regard to case and outer blanks."""
    span = F.concat_ws("-", F.col("s").cast("string"), F.col("e").cast("string"))
    plain = F.lower(F.trim("value"))
    return items.groupBy("doc_id", "item_type", semantic_hash(F.col("value")).alias("hash")).agg(
        F.count("*").alias("n_items"),
        F.array_join(F.array_sort(F.collect_set(span)), ",").alias("spans"),
        F.size(F.collect_set("extractor_id")).cast("long").alias("n_extractors"),
        F.coalesce(F.min(plain) == F.max(plain), F.lit(False)).alias("agreed"),
    )


def conflicts(items: DataFrame, *keys: Column | str) -> DataFrame:
    """Keys under which more than one item lies, with more than one distinct value."""
    values = F.collect_set(F.lower(F.trim("value")))
    out = items.groupBy(*keys).agg(F.count("*").alias("n_items"), F.size(values).cast("long").alias("n_values"), F.array_join(F.array_sort(values), ",").alias("values"))
    return out.where("n_items > 1 and n_values > 1")


def first_wins(items: DataFrame) -> DataFrame:
    """The first item of each (doc_id, item_type, value), by line, with the number of spans of all of them."""
    return items.groupBy("doc_id", "item_type", "value").agg(F.min_by(F.struct("s", "e"), F.struct("line", "s", "e")).alias("f"), F.count("*").alias("n_spans")).select("doc_id", "item_type", "value", "f.s", "f.e", "n_spans")


def dedup_when_many(items: DataFrame, chunks: Column, most: int = 15) -> DataFrame:
    """first_wins for documents of more than ``most`` chunks; others keep all items."""
    marked = items.withColumn("many", chunks > most)
    few = marked.where("not many").select("doc_id", "item_type", "value", "s", "e", F.lit(1).cast("long").alias("n_spans"))
    return few.unionByName(first_wins(marked.where("many")))


def keep_strong(items: DataFrame, share: float = 0.2) -> DataFrame:
    """All items of extractors with at least ``share`` of the mean number of items in the document; of weaker ones
    the items whose hash no other extractor has, tagged."""
    hashed = items.withColumn("hash", semantic_hash(F.col("value")))
    by = lambda rows, *keys: dealt(rows, *keys, like=items)
    by_source = by(hashed, "doc_id", "extractor_id")
    counts = by_source.groupBy("doc_id", "extractor_id").agg(F.count("*").alias("n"))
    counts = by(counts, "doc_id").withColumn("strong", F.col("n") >= share * F.avg("n").over(Window.partitionBy("doc_id")))
    sources = by(hashed.select("doc_id", "hash", "extractor_id").distinct(), "doc_id", "hash").groupBy("doc_id", "hash").agg(F.count("extractor_id").alias("n_sources"))
    joined = by_source.join(by(counts.drop("n"), "doc_id", "extractor_id"), ["doc_id", "extractor_id"])
    joined = by(joined, "doc_id", "hash").join(sources, ["doc_id", "hash"])
    return joined.where("strong or n_sources = 1").withColumn("unique_source", ~F.col("strong")).drop("hash", "strong", "n_sources")


def add_missing(items: DataFrame, locked: DataFrame) -> DataFrame:
    """Locked entities (doc_id, item_type, value, s, ...) whose (type, value) no item has, each once."""
    new = locked.join(items.select("doc_id", "item_type", "value").distinct(), ["doc_id", "item_type", "value"], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "item_type", "value").orderBy("s", "e", "line"))
    return new.withColumn("nth", first).where("nth = 1").drop("nth")


def page_matrix(items: DataFrame) -> DataFrame:
    """For each page, how many items each extractor found, as ``extractor:n``."""
    counts = items.groupBy("doc_id", "page_num", "extractor_id").agg(F.count("*").alias("n"))
    cell = F.concat_ws(":", "extractor_id", F.col("n").cast("string"))
    return counts.groupBy("doc_id", "page_num").agg(F.array_join(F.array_sort(F.collect_list(cell)), ",").alias("by_extractor"))


def combined(parts: DataFrame) -> DataFrame:
    """Parts (doc_id, seq, name, text) as one text with headers, and its number of words."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("## "), "name", F.lit("\n"), "text").alias("t"))))
    text = F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n")
    return parts.groupBy("doc_id").agg(text.alias("text"), F.count("*").alias("n_parts")).withColumn("n_words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long"))
