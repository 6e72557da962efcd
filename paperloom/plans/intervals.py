"""Queries over ranges."""

from pyspark.sql import functions as F

from paperloom.operators import intervals as i
from paperloom.operators import ranges as r
from paperloom.plans.registry import query
from paperloom.plans.views_sql import using
from paperloom.sources import views as v

ISLANDS = """m as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) reach from spans),
  n as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by doc_id order by s, e rows unbounded preceding) island from m),
  islands as (select doc_id, min(s) s, max(e) e, count(*) n from n group by doc_id, island)"""
GAPS = ISLANDS + """, g as (select doc_id, lag(e, 1, 0) over (partition by doc_id order by s, e) gap_start, s gap_end from
  (select doc_id, s, e from islands union all select distinct doc_id, 250, 250 from islands)),
  gaps as (select * from g where gap_start < gap_end)"""
LONGEST = 50  # of spans and pages of these views
N_PAGES = 5  # of a document
POINTS = lambda s: s.select("doc_id", F.col("line").alias("point_id"), F.col("s").alias("at"))
RANGES = lambda s: s.select("doc_id", F.col("line").alias("range_id"), "s", "e")


@query("w04_islands", using("spans", "select doc_id, s, e, n from islands", ISLANDS))
def islands(spark, d):
    return i.islands(v.spans(spark, d), "doc_id")


@query("w05_gaps", using("spans", "select doc_id, gap_start, gap_end from gaps", GAPS))
def gaps(spark, d):
    return i.gaps(i.islands(v.spans(spark, d), "doc_id"), F.lit(250).cast("long"), "doc_id")


@query(
    "a20_coverage",
    using(
        "spans",
        """select doc_id, covered, n_islands, coalesce(n_gaps, 0) n_gaps, coalesce(widest, 0) widest, covered / 250.0::double "share", coalesce(widest, 0) < 100 complete from
  (select doc_id, sum(e - s)::bigint covered, count(*) n_islands from islands group by 1) left join (select doc_id, count(*) n_gaps, max(gap_end - gap_start) widest from gaps group by 1) using (doc_id)""",
        GAPS,
    ),
)
def coverage(spark, d):
    return i.coverage(v.spans(spark, d), 250, "doc_id")


@query(
    "j01_offset_to_page",
    using("spans page_boundaries", """select doc_id, point_id, "at", coalesce(min(page_num) filter (where "at" >= page_start and "at" < page_end), max(page_num)) page_num
  from (select distinct doc_id, line point_id, s "at" from spans) join page_boundaries using (doc_id) group by all"""),
)
def offset_to_page(spark, d):
    s = v.spans(spark, d)
    return i.offset_to_page(POINTS(s), v.page_boundaries(s), LONGEST)


@query(
    "j05_floor_page",
    using("spans page_boundaries", """select doc_id, line point_id, s "at", (select max(page_num) from page_boundaries p where p.doc_id = spans.doc_id and page_start <= s) page_num from spans"""),
)
def floor_page(spark, d):
    s = v.spans(spark, d)
    return i.floor_page(POINTS(s), v.page_boundaries(s))


@query(
    "j02_ranges_to_pages",
    using("spans page_boundaries", "select doc_id, line range_id, min(page_num) page_first, max(page_num) page_last, count(page_num) n_pages from spans left join page_boundaries using (doc_id) where s < page_end and e > page_start group by 1, 2"),
)
def ranges_to_pages(spark, d):
    s = v.spans(spark, d)
    return i.ranges_to_pages(RANGES(s), v.page_boundaries(s), LONGEST)


@query(
    "j06_version_as_of",
    using("versions fact_dates", """select f.nid, fact_id, coalesce(max(case when published <= fact_date then "version" end), min("version")) "version" from fact_dates f left join versions v on f.nid = v.nid group by 1, 2"""),
)
def version_as_of(spark, d):
    return i.as_of(v.fact_dates(spark, d), v.versions(spark, d))


@query("p08_overlap_filter", using("spans", "select doc_id, line, s, e from spans where s < 60 and e > 40"))
def overlap_filter(spark, d):
    return i.overlap_filter(v.spans(spark, d), 40, 60).select("doc_id", "line", "s", "e")


@query(
    "j10_anti_overlap",
    using("spans", "select doc_id, line, s, e from spans a where item_type = 'fact' and not exists (select 1 from spans b where b.item_type = 'date' and a.doc_id = b.doc_id and a.s < b.e and a.e > b.s)"),
)
def anti_overlap(spark, d):
    s = v.spans(spark, d)
    return i.anti_overlap(s.where("item_type = 'fact'"), s.where("item_type = 'date'"), LONGEST).select("doc_id", "line", "s", "e")


@query(
    "j12_first_container",
    using("spans page_boundaries", """select doc_id, point_id, coalesce(min("index"), 0)::bigint "index" from (select doc_id, line point_id, e "at" from spans) left join (select doc_id d, page_num - 1 "index", page_start, page_end from page_boundaries where page_num < 4) on d = doc_id and "at" >= page_start and "at" < page_end group by 1, 2"""),
)
def first_container(spark, d):
    s = v.spans(spark, d)
    chunks = v.page_boundaries(s, 3).select("doc_id", (F.col("page_num") - 1).alias("index"), F.col("page_start").alias("s"), F.col("page_end").alias("e"))
    return i.first_container(s.select("doc_id", F.col("line").alias("point_id"), F.col("e").alias("at")), chunks, 0, LONGEST).withColumn("index", F.col("index").cast("long"))


@query(
    "a21_coverage_matrix",
    using(
        "spans page_boundaries",
        "select doc_id, page_num, coalesce(n, 0) covered_by, case when coalesce(n, 0) = 0 then 'none' when n < 3 then 'partial' else 'full' end status from page_boundaries left join h using (doc_id, page_num)",
        "h as (select doc_id, s // 50 + 1 page_num, count(distinct extractor_id) n from spans group by 1, 2)",
    ),
)
def coverage_matrix(spark, d):
    hits = v.spans(spark, d).select("doc_id", (F.floor(F.col("s") / 50) + 1).cast("long").alias("page_num"), "extractor_id")
    return i.coverage_matrix(hits, 5)


@query(
    "w01_page_offsets",
    """select conv_id doc_id, turn page_num, coalesce(sum(n + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint page_start,
  coalesce(sum(n + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint + n page_end from (select *, len(text) n from conversations)""",
)
def page_offsets(spark, d):
    turns = v.table(spark, d, "conversations")
    return i.page_offsets(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), F.length("text").cast("long").alias("n_chars")))


# Three overlapping chunks of each document; facts are their entities, amounts their tables, pages their images.
CHUNKS = "chunks as (select doc_id, c chunk_id, 80 * c s, 80 * c + 100 e from (select distinct doc_id from spans), (select unnest(range(0, 3))::bigint c))"
CHUNK_PAGES = CHUNKS + """, cp as (select c.doc_id, chunk_id, coalesce(max(case when page_start <= s and s < page_end then page_num end), 1) page_start,
  coalesce(max(case when page_start < e and e <= page_end then page_num end), 1) page_end from chunks c left join page_boundaries p on c.doc_id = p.doc_id group by 1, 2)"""


def chunks(spans):
    c = spans.select("doc_id").distinct().withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return c.withColumns({"s": F.col("chunk_id") * 80, "e": F.col("chunk_id") * 80 + 100})


@query(
    "j08_chunk_entities",
    using("spans", """select c.doc_id, chunk_id, coalesce(string_agg(distinct line, ',' order by line), '') entities from chunks c
  left join (select * from spans where item_type = 'fact') x on c.doc_id = x.doc_id and c.s < x.e and c.e > x.s group by 1, 2""", CHUNKS),
)
def chunk_entities(spark, d):
    s = v.spans(spark, d)
    entities = s.where("item_type = 'fact'").select("doc_id", F.col("line").alias("entity_id"), "s", "e")
    refs = r.entity_refs(chunks(s), entities, 100)
    return refs.select("doc_id", "chunk_id", F.array_join("entity_refs", ",").alias("entities"))


@query(
    "j09_chunk_tables",
    using("spans", "select c.*, exists (select 1 from spans x where x.item_type = 'amount' and c.doc_id = x.doc_id and c.s < x.e and c.e > x.s) contains_table from (select doc_id, chunk_id, s, e from chunks) c", CHUNKS).replace("select c.*,", "select c.doc_id, c.chunk_id,"),
)
def chunk_tables(spark, d):
    s = v.spans(spark, d)
    return r.with_tables(chunks(s), s.where("item_type = 'amount'"), 100)


@query("e05_chunk_pages", using("spans page_boundaries", "select * from cp", CHUNK_PAGES))
def chunk_pages(spark, d):
    s = v.spans(spark, d)
    return r.chunk_pages(chunks(s), v.page_boundaries(s), LONGEST)


@query(
    "j28_chunk_images",
    using("spans page_boundaries", """select k.doc_id, chunk_id, page_num, concat('img', page_num) image from (select doc_id, chunk_id, page_start, case when chunk_id < 2 then page_end end page_end from cp) k
  join page_boundaries p on k.doc_id = p.doc_id and (k.page_end is null or p.page_num between k.page_start and k.page_end)""", CHUNK_PAGES),
)
def chunk_images(spark, d):
    """The last chunk of each document has no known end."""
    s = v.spans(spark, d)
    pages = v.page_boundaries(s)
    known = r.chunk_pages(chunks(s), pages, LONGEST).withColumn("page_end", F.when(F.col("chunk_id") < 2, F.col("page_end")))
    return r.chunk_images(known, pages.select("doc_id", "page_num", F.concat(F.lit("img"), F.col("page_num").cast("string")).alias("image")), N_PAGES)
