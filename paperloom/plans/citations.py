"""Queries over citations: excerpts of the documents themselves, as they are or with a character changed."""

from pyspark.sql import functions as F

from paperloom.operators import citations as c
from paperloom.plans.documents import docs
from paperloom.plans.registry import query

# An excerpt of 60 characters at most from each document of 200 or more, trimmed; in changed its 30th character is another.
EXCERPTS = r"""cited as (select doc_id, concat('c', doc_id) item_id, lang, "text", excerpt, concat(substr(excerpt, 1, 29), '#', substr(excerpt, 31)) changed from
  (select *, regexp_replace(substr("text", 81, 60), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') excerpt from documents where len("text") >= 200) where len(excerpt) >= 40 and substr(excerpt, 30, 1) <> '#')"""


def excerpts(spark, d):
    rows = docs(spark, d).where(F.length("text") >= 200)
    rows = rows.withColumn("excerpt", F.regexp_replace(F.substring("text", 81, 60), r"^[ \t\n\r]+|[ \t\n\r]+\z", ""))
    rows = rows.where(F.length("excerpt") >= 40).where(F.substring("excerpt", 30, 1) != "#")
    changed = F.concat(F.substring("excerpt", 1, 29), F.lit("#"), F.substr("excerpt", F.lit(31)))
    return rows.select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("item_id"), "lang", "excerpt", changed.alias("changed"))


@query(
    "j17_near_places",
    f"""with {EXCERPTS}, f as (select *, instr(lower("text"), lower(excerpt)) - 1 "start", len(excerpt) n from cited)
select doc_id, item_id, "start", "start" + n "end", (n - 1)::double / n ratio from f""",
)
def near_places(spark, d):
    return c.best_places(docs(spark, d), excerpts(spark, d).select("doc_id", "item_id", F.col("changed").alias("excerpt")))


CHECKED = f"""{EXCERPTS}, c as (select *, len(excerpt) n, lang = 'en' near, case when lang in ('en', 'de') then 1 when lang = 'fr' then 99 end declared from cited),
p as (select *, case when near then instr(lower(substr("text", 1, 1000)), lower(excerpt)) - 1 else instr("text", excerpt) - 1 end "start",
  len(list_filter(range(1, len("text") - n + 2), lambda i: lower(substr("text", i, n)) = lower(excerpt))) places from c),
s as (select doc_id, item_id, lang, declared page_declared,
  case when near then 'VALID_FUZZY' when declared = 1 then 'VALID_EXACT' when places > 1 then 'INVALID_AMBIGUOUS' when declared is null then 'VALID_EXACT' else 'PAGE_MISMATCH' end status,
  "start", "start" + n "end", "start" // 1000 + 1 page_num, case when near then (n - 1)::double / n else 1.0 end ratio, case when declared = 1 then 1 else places end n_places from p
  union all select doc_id, concat('l', doc_id), 'none', null, 'INVALID', null, null, null, 0.0, 0 from (select distinct doc_id from labels where doc_id not in (select doc_id from documents)))"""


def statuses(spark, d):
    """Languages stand for kinds of citations: changed and declared on its page, exact on its page, on a page that isn't
    there, without a page; and one for each labelled document that isn't there."""
    texts = docs(spark, d)
    page = F.when(F.col("lang").isin("en", "de"), 1).when(F.col("lang") == "fr", 99).cast("long")
    cited = excerpts(spark, d).withColumn("page_num", page).withColumn("excerpt", F.when(F.col("lang") == "en", F.col("changed")).otherwise(F.col("excerpt")))
    absent = spark.read.parquet(f"{d}/labels.parquet").select("doc_id").distinct().join(texts.select("doc_id"), "doc_id", "left_anti")
    absent = absent.select("doc_id", F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("item_id"), F.lit("none").alias("lang"), F.lit("anything").alias("excerpt"), F.lit(None).cast("long").alias("page_num"))
    cited = cited.select(absent.columns).unionByName(absent)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(1000))
    pages = texts.where("text is not null").select("doc_id", F.length("text").alias("n"), F.explode(starts).alias("page_start"))
    pages = pages.select("doc_id", (F.col("page_start") / 1000 + 1).cast("long").alias("page_num"), "page_start", F.least(F.col("page_start") + 1000, F.col("n")).alias("page_end"))
    return c.checked(texts, pages, cited), cited.select("item_id", "lang")


@query("v04_citation_status", f"""with {CHECKED} select doc_id, item_id, page_declared, status, "start", "end", page_num, ratio, n_places from s""")
def citation_status(spark, d):
    return statuses(spark, d)[0]


@query(
    "a24_checked_scores",
    f"""with {CHECKED}, n as (select lang auditor_id, count(*) total, count(*) filter (where status in ('VALID_EXACT', 'VALID_FUZZY', 'PAGE_MISMATCH')) valid, count(*) filter (where status = 'PAGE_MISMATCH') mismatched,
  count(*) filter (where status = 'INVALID_AMBIGUOUS') ambiguous, count(*) filter (where status = 'INVALID') invalid from s group by 1) select *, valid::double / total score from n""",
)
def checked_scores(spark, d):
    """Each kind of citation stands for an auditor."""
    found, kinds = statuses(spark, d)
    return c.auditor_scores(found.join(kinds.withColumnRenamed("lang", "auditor_id"), "item_id"))
