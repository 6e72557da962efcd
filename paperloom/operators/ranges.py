"""Joins of points and half-open ranges whose work follows their rows and hits (J8, J9, J28, E5, and what the interval
operators need).

A range of whole units is cut into the nodes of a binary tree that it fills: two a level at most, none larger than itself. A
point lies under one node a level. A point is in a range just if one of its nodes is one of the range's, so the join is on equal
(key, level, node), a range far longer than others doesn't meet all of them, and a key that holds a third of all rows is spread
over its nodes. Units of 2**BITS keep short ranges to a row or two; only in the units at a range's ends rows are compared that
don't hit.

Overlaps are points too: of two overlapping ranges one starts in the other.

Defined results: rows with a null key or a null bound hit nothing; empty and inverted ranges hold no points; an empty range
overlaps those that hold its place inside. Rows that repeat each hit. Columns of both sides come as structs, so no names clash.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6
ROWS = 500_000  # of a table that is dealt to one task


def dealt(rows: DataFrame, *keys: str, like: DataFrame) -> DataFrame:
    """rows by keys in as many partitions as ``like`` has ROWS, so that a task's memory doesn't grow with the table."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-like.count() // ROWS))
    return rows.repartition(n, *keys)


def _nodes(start: str, end: str, bits: int) -> Column:
    """The (level, node) pairs that a range fills, in units."""
    low, high = f"shiftright({start}, {bits})", f"(shiftright({end} - 1, {bits}) + 1)"
    first, last = f"-shiftright(-{low}, cast(l as int))", f"shiftright({high}, cast(l as int))"
    left = f"if({first} & 1 = 1 and {first} < {last}, struct(l as level, {first} as node), null)"
    right = f"if({last} & 1 = 1 and {first} + ({first} & 1) < {last}, struct(l as level, {last} - 1 as node), null)"
    levels = f"sequence(0, length(bin({high} - {low})) - 1)"
    return F.expr(f"filter(flatten(transform({levels}, l -> array({left}, {right}))), x -> x is not null)")


def _levels(ranges: DataFrame, start: str, end: str, bits: int) -> int:
    """The highest level of a node of these ranges."""
    longest = ranges.agg(F.max(F.col(end) - F.col(start))).first()[0]
    return _top(longest or 1, bits)


def _top(longest: int, bits: int) -> int:
    return max(0, (max(int(longest), 1) - 1 >> bits) + 2).bit_length() - 1


def contained(points: DataFrame, ranges: DataFrame, on: str, at: str, start: str = "s", end: str = "e", longest: int | None = None, bits: int = BITS) -> DataFrame:
    """All (p, r), structs of a point and a range of the same key that holds it. longest: what no range exceeds, where it is
    known; else it is read off the ranges."""
    good = ranges.where(F.col(start) < F.col(end))
    top = _levels(good, start, end, bits) if longest is None else _top(longest, bits)
    r = good.select(F.col(on).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), F.struct("*").alias("r"))
    r = r.select("_k", "_s", "_e", "r", F.inline(_nodes("_s", "_e", bits)))
    p = points.where(F.col(on).isNotNull()).select(F.col(on).alias("_k"), F.col(at).cast("long").alias("_at"), F.struct("*").alias("p"))
    p = p.select("_k", "_at", "p", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    p = p.withColumn("node", F.expr(f"shiftright(shiftright(_at, {bits}), level)"))
    return p.join(r, ["_k", "level", "node"]).where("_at >= _s and _at < _e").select("p", "r")


def overlapping(a: DataFrame, b: DataFrame, on: str, start: str = "s", end: str = "e", longest: int | None = None, bits: int = BITS) -> DataFrame:
    """All (a, b), structs of two ranges of the same key that overlap, each pair once. Both have the columns start and end."""
    meets = f"a.{start} < b.{end} and a.{end} > b.{start}"
    first = contained(b, a, on, start, start, end, longest, bits).select(F.col("r").alias("a"), F.col("p").alias("b"))
    inside = b.withColumn("_inside", F.col(start) + 1)
    second = contained(a, inside, on, start, "_inside", end, longest, bits).select(F.col("p").alias("a"), F.col("r").dropFields("_inside").alias("b"))
    return first.unionByName(second).where(meets)


def self_overlapping(rows: DataFrame, on: str, start: str = "s", end: str = "e", longest: int | None = None, bits: int = BITS) -> DataFrame:
    """All (a, b) of one table, in either order, of which the later starts in the earlier; those that start together come in
    both orders, and each row with itself."""
    return contained(rows, rows, on, start, start, end, longest, bits).select(F.col("r").alias("a"), F.col("p").alias("b"))


def entity_refs(chunks: DataFrame, entities: DataFrame, longest: int | None = None) -> DataFrame:
    """For each chunk (doc_id, chunk_id, s, e) the ids of the entities (doc_id, entity_id, s, e) that overlap it."""
    hits = overlapping(chunks, entities, "doc_id", longest=longest).select("a.doc_id", "a.chunk_id", F.col("b.entity_id").alias("entity_id"))
    every = chunks.select("doc_id", "chunk_id", F.lit(None).cast(entities.schema["entity_id"].dataType).alias("entity_id")).unionByName(hits)
    return every.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_refs"))


def with_tables(chunks: DataFrame, regions: DataFrame, longest: int | None = None) -> DataFrame:
    """For each chunk (doc_id, chunk_id, s, e) whether a table's region (doc_id, s, e) overlaps it."""
    hits = overlapping(chunks, regions.select("doc_id", "s", "e"), "doc_id", longest=longest).select("a.doc_id", "a.chunk_id", F.lit(True).alias("contains_table"))
    every = chunks.select("doc_id", "chunk_id", F.lit(False).alias("contains_table")).unionByName(hits)
    return every.groupBy("doc_id", "chunk_id").agg(F.max("contains_table").alias("contains_table"))


def chunk_pages(chunks: DataFrame, pages: DataFrame, longest: int | None = None) -> DataFrame:
    """E5: the page that holds each chunk's start, and the one that holds its last character; 1 where there is none.
    chunks: (doc_id, chunk_id, s, e); pages: (doc_id, page_num, page_start, page_end)."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("at")), F.struct(F.lit(1).alias("side"), (F.col("e") - 1).alias("at")))
    points = chunks.select("doc_id", "chunk_id", F.inline(ends))
    hits = contained(points, pages, "doc_id", "at", "page_start", "page_end", longest).select("p.doc_id", "p.chunk_id", "p.side", "r.page_num")
    every = chunks.select("doc_id", "chunk_id", F.lit(0).alias("side"), F.lit(None).cast("long").alias("page_num")).unionByName(hits)
    page = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("page_num"))), F.lit(1)).cast("long")
    return every.groupBy("doc_id", "chunk_id").agg(page(0).alias("page_start"), page(1).alias("page_end"))


def chunk_images(chunks: DataFrame, images: DataFrame, longest: int | None = None) -> DataFrame:
    """The images (doc_id, page_num, image) on the pages of each chunk (doc_id, chunk_id, page_start, page_end, both
    included); all of its document's where a chunk has no pages. longest: pages that no chunk exceeds, where it is known; else
    the chunks are computed once more to read it off them."""
    known = F.col("page_start").isNotNull() & F.col("page_end").isNotNull()
    paged = chunks.where(known).withColumn("_end", F.col("page_end") + 1)
    on_page = contained(images, paged, "doc_id", "page_num", "page_start", "_end", longest, bits=0).select("r.doc_id", "r.chunk_id", "p.page_num", "p.image")
    every = chunks.where(~known).select("doc_id", "chunk_id").join(images, "doc_id").select("doc_id", "chunk_id", "page_num", "image")
    return on_page.unionByName(every)
