"""Pages and chunks (P1, P5, X15, W2, W3, W14, W15, A23, A47, G1, G2, G4, G7, J27, J30; G3, G5, G6: cutting.py)."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.cuts import greedy
from paperloom.functions.text import page_status

# States of a page.
RESOLVED = ["VISUAL_ONLY", "REPARADA"]
BLOCKING = ["SUSPEITA", "SEM_TEXTO", "NAO_COBERTA"]


def needs_repair(status: Column, flags: Column, override: Column, blocking_flags: list[str]) -> Column:
    """Not resolved, and of a blocking status or with a blocking flag."""
    resolved = status.isin(RESOLVED) | F.coalesce(override, F.lit("")).isin("upload", "manual", "visual_only")
    flagged = F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, blocking_flags)))
    return ~resolved & (status.isin(BLOCKING) | F.coalesce(flagged, F.lit(False)))


def final_status(override: Column, initial: Column, flags: Column) -> Column:
    """P5: an override wins, then no text, then flags or suspicion."""
    return F.when(override.isNotNull(), F.when(override == "visual_only", "VISUAL_ONLY").otherwise("REPARADA")).when(initial == "SEM_TEXTO", initial).when((F.size(flags) > 0) | (initial == "SUSPEITA"), "SUSPEITA").otherwise("OK")


def statuses(pages: DataFrame) -> DataFrame:
    """P4 over pages (..., text)."""
    return pages.withColumn("status", page_status(F.col("text")))


def status_counts(pages: DataFrame, *keys: str) -> DataFrame:
    """A47."""
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "SUSPEITA", "SEM_TEXTO")])


def running_lines(pages: DataFrame, edge: int = 5, share: float = 0.3, longest: int = 100) -> DataFrame:
    """(doc_id, line, n) of headers and footers: lines among the first and last ``edge`` of more than ``share`` of
    the pages, shorter than ``longest``."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.withColumn("lines", lines)
    ends = F.array_distinct(F.concat(F.slice("lines", 1, edge), F.when(F.size("lines") > edge, F.slice("lines", -edge, edge)).otherwise(F.array().cast("array<string>"))))
    n = rows.groupBy("doc_id").agg(F.count("*").alias("pages"))
    counts = rows.select("doc_id", F.explode(ends).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return counts.join(n, "doc_id").where((F.col("n") > share * F.col("pages")) & (F.length("line") < longest)).select("doc_id", "line", "n")


def without_running_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages without those lines, wherever on the page they are."""
    gone = found.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.trim(x))), "\n")
    return pages.join(gone, "doc_id", "left").withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)).drop("gone")


def with_context(pages: DataFrame, n: int = 300) -> DataFrame:
    """The tail of the page before and the head of the page behind."""
    order = Window.partitionBy("doc_id").orderBy("page_num")
    return pages.withColumns({"before": F.coalesce(F.right(F.lag("text").over(order), F.lit(n)), F.lit("")), "behind": F.coalesce(F.substring(F.lead("text").over(order), 1, n), F.lit(""))})


def batches(pages: DataFrame, budget: int) -> DataFrame:
    """Number of the batch of each page (doc_id, page_num, n_chars): a batch closes before the page that would
    take it over the budget. A document's pages follow each other in one task, which keeps only the batch it fills."""

    def number(parts):
        doc, used, batch = None, 0, -1
        for part in parts:
            out = []
            for d, n in zip(part.column("doc_id").to_pylist(), part.column("n_chars").to_pylist(), strict=True):
                if batch < 0 or d != doc:
                    doc, used, batch = d, 0, 0
                n = n or 0
                if used > 0 and used + n > budget:
                    used, batch = 0, batch + 1
                used += n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("page_num"), pa.array(out, pa.int32())], ["doc_id", "page_num", "batch"])

    rows = pages.select("doc_id", F.col("page_num").cast("long").alias("page_num"), F.col("n_chars").cast("long").alias("n_chars"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, page_num long, batch int"
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page_num", "n_chars").mapInArrow(number, kind)


def fixed_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of ``size`` characters that begin ``size - overlap`` apart, until one reaches the end."""
    total, step = F.length("text"), max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(total - overlap - 1, F.lit(0)), F.lit(step))
    rows = docs.where(total > 0).select("doc_id", F.posexplode(starts).alias("chunk_index", "start"), "text")
    end = F.least(F.col("start") + size, F.length("text"))
    return rows.select("doc_id", "chunk_index", "start", end.alias("end"), F.substring("text", F.col("start") + 1, end - F.col("start")).alias("text"))


def greedy_chunks(points: Column, target: int, overlap: int) -> Column:
    """Array of (start, end) over ascending split points: a chunk ends at the last point within ``target`` of its
    start; the next begins at the first point in its last ``overlap`` characters, else at its end."""

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def cut(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [{"start": int(s), "end": int(e)} for s, e in greedy(list(x), target, overlap)])

    return cut(points.cast("array<bigint>"))


def missed_signals(signals: DataFrame, extracted: DataFrame) -> DataFrame:
    """Of signals (doc_id, signal), which no extractor's values (doc_id, value) have, and the recall."""
    found = extracted.groupBy("doc_id").agg(F.collect_set("value").alias("values"))
    hit = F.exists(F.coalesce("values", F.array().cast("array<string>")), lambda x: x.contains(F.col("signal")))
    rows = signals.join(found, "doc_id", "left").withColumn("hit", hit)
    return rows.groupBy("doc_id").agg(F.count("*").alias("signals"), F.count_if(~F.col("hit")).alias("missed"), (F.count_if("hit") / F.count("*")).alias("recall"))


def marker_pages(docs: DataFrame, pattern: str) -> DataFrame:
    """Intervals between markers; a text without markers is one page."""
    from paperloom.functions.text import matches

    rows = docs.select("doc_id", F.length("text").alias("n"), F.posexplode_outer(matches(F.col("text"), pattern)).alias("i", "m"))
    order = Window.partitionBy("doc_id").orderBy("i")
    return rows.select("doc_id", (F.coalesce("i", F.lit(0)) + 1).cast("long").alias("page_num"), F.coalesce("m.start", F.lit(0)).cast("long").alias("page_start"), F.coalesce(F.lead("m.start").over(order), F.col("n")).cast("long").alias("page_end"))
