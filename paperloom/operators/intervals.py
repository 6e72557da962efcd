"""Half-open ranges within documents.

Joins carry the document's key, and within a document the nodes of operators/ranges.py.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.ranges import contained, dealt, overlapping
from paperloom.operators.telemetry import ratio


def islands(ranges: DataFrame, *keys: str) -> DataFrame:
    """Ranges (keys, s, e) merged where they overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("island")


def gaps(merged: DataFrame, total: Column, *keys: str) -> DataFrame:
    """What islands leave of [0, total)."""
    ends = merged.groupBy(*keys).agg(total.alias("s")).withColumn("e", F.col("s"))
    rows = merged.select(*keys, "s", "e").unionByName(ends)
    before = F.lag("e", 1, 0).over(Window.partitionBy(*keys).orderBy("s", "e"))
    return rows.withColumns({"gap_start": before, "gap_end": F.col("s")}).where("gap_start < gap_end").select(*keys, "gap_start", "gap_end")


def coverage(ranges: DataFrame, total: int, *keys: str, wide: int = 100) -> DataFrame:
    """Covered characters and share of [0, total), and complete: no gap of ``wide`` characters or more."""
    merged = islands(ranges, *keys)
    covered = merged.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("covered"), F.count("*").alias("n_islands"))
    wide_gaps = gaps(merged, F.lit(total).cast("long"), *keys).groupBy(*keys).agg(F.count("*").alias("n_gaps"), F.max(F.col("gap_end") - F.col("gap_start")).alias("widest"))
    out = covered.join(wide_gaps, [*keys], "left").withColumns({"n_gaps": F.coalesce("n_gaps", F.lit(0)), "widest": F.coalesce("widest", F.lit(0))})
    return out.withColumns({"share": ratio(F.col("covered"), F.lit(total)), "complete": F.col("widest") < wide})


def offset_to_page(points: DataFrame, pages: DataFrame, longest: int | None = None) -> DataFrame:
    """The page that holds each point (doc_id, point_id, at); behind the end the last page."""
    hits = contained(points, pages, "doc_id", "at", "page_start", "page_end", longest)
    hits = hits.select("p.doc_id", "p.point_id", "p.at", F.col("r.page_num").alias("page_num"))
    every = points.select("doc_id", "point_id", "at", F.lit(None).cast("long").alias("page_num")).unionByName(hits)
    found = every.groupBy("doc_id", "point_id", "at").agg(F.min("page_num").alias("held"))
    last = pages.groupBy("doc_id").agg(F.max("page_num").alias("last"))
    return found.join(last, "doc_id", "left").select("doc_id", "point_id", "at", F.coalesce("held", "last").alias("page_num"))


def floor_page(points: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of the greatest start that is not behind the point."""
    both = points.select("doc_id", "point_id", "at", F.lit(None).cast("long").alias("page_num"), F.lit(1).alias("o"))
    both = both.unionByName(pages.select("doc_id", F.lit(None).cast("long").alias("point_id"), F.col("page_start").alias("at"), "page_num", F.lit(0).alias("o")))
    both = dealt(both, "doc_id", like=points)
    order = Window.partitionBy("doc_id").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("floor", F.last("page_num", ignorenulls=True).over(order)).where("o = 1").select("doc_id", "point_id", "at", F.col("floor").alias("page_num"))


def ranges_to_pages(ranges: DataFrame, pages: DataFrame, longest: int | None = None) -> DataFrame:
    """First, last and number of the pages that each range (doc_id, range_id, s, e) overlaps; nulls and 0 for none."""
    p = pages.select("doc_id", "page_num", F.col("page_start").alias("s"), F.col("page_end").alias("e"))
    hits = overlapping(ranges, p, "doc_id", longest=longest).select("a.doc_id", "a.range_id", "b.page_num")
    every = ranges.select("doc_id", "range_id", F.lit(None).cast("long").alias("page_num")).unionByName(hits)
    return every.groupBy("doc_id", "range_id").agg(F.min("page_num").alias("page_first"), F.max("page_num").alias("page_last"), F.count("page_num").alias("n_pages"))


def as_of(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """The highest version published by each fact's date, else the first version; null dates are passed over. Facts
    and versions of a nid are merged by time and the last version is carried on, so no fact meets all versions."""
    dated = versions.where("published is not null")
    both = facts.select("nid", "fact_id", F.col("fact_date").alias("t"), F.lit(None).cast("long").alias("v"))
    both = both.unionByName(dated.select("nid", F.lit(None).cast("long").alias("fact_id"), F.col("published").alias("t"), F.col("version").alias("v")))
    order = Window.partitionBy("nid").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    first = F.min("v").over(Window.partitionBy("nid"))
    out = both.withColumns({"so_far": F.max("v").over(order), "first": first}).where("fact_id is not null")
    return out.select("nid", "fact_id", F.when(F.col("t").isNotNull(), F.coalesce("so_far", "first")).alias("version"))


def overlap_filter(ranges: DataFrame, start: int, end: int) -> DataFrame:
    """Ranges that overlap [start, end)."""
    return ranges.where((F.col("s") < end) & (F.col("e") > start))


def anti_overlap(found: DataFrame, registered: DataFrame, longest: int | None = None) -> DataFrame:
    """J10 without growth of the registry: ranges of found (doc_id, s, e) that overlap none of registered."""
    ranges = [rows.select("doc_id", "s", "e").distinct() for rows in (found, registered)]
    hit = overlapping(*ranges, "doc_id", longest=longest).select("a.*").distinct()
    return found.join(hit, ["doc_id", "s", "e"], "left_anti").select(found.columns)


def first_container(points: DataFrame, ranges: DataFrame, default: int = 0, longest: int | None = None) -> DataFrame:
    """The least index of a range that holds each point (doc_id, point_id, at), else the default."""
    hits = contained(points, ranges, "doc_id", "at", longest=longest).select("p.doc_id", "p.point_id", "r.index")
    every = points.select("doc_id", "point_id", F.lit(None).cast("long").alias("index")).unionByName(hits)
    return every.groupBy("doc_id", "point_id").agg(F.coalesce(F.min("index"), F.lit(default)).alias("index"))


def coverage_matrix(hits: DataFrame, n_pages: int) -> DataFrame:
    """For every page 1 to n_pages of each doc_id, by how many extractors it is covered: none, partial (under
    three) or full. hits: (doc_id, page_num, extractor_id)."""
    dense = hits.select("doc_id").distinct().withColumn("page_num", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_pages).cast("long"))))
    n = hits.groupBy("doc_id", "page_num").agg(F.countDistinct("extractor_id").alias("n"))
    out = dense.join(n, ["doc_id", "page_num"], "left").withColumn("covered_by", F.coalesce("n", F.lit(0)))
    return out.select("doc_id", "page_num", "covered_by", F.when(F.col("covered_by") == 0, "none").when(F.col("covered_by") < 3, "partial").otherwise("full").alias("status"))


def page_offsets(pages: DataFrame, separator: int = 2) -> DataFrame:
    """Start and end of each page (doc_id, page_num, n_chars) in the joined text."""
    order = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_chars") + separator).over(order), F.lit(0))
    return pages.select("doc_id", "page_num", start.alias("page_start"), (start + F.col("n_chars")).alias("page_end"))
