"""Queries over documents, pages of HTML and conversations."""

from pyspark.sql import functions as F

from paperloom.functions import text as x
from paperloom.operators import cutting
from paperloom.operators import pages as p
from paperloom.plans.registry import query
from paperloom.sources import views as v

UNACCENT = "lower(strip_accents(text))"
HASH = f"md5(trim(regexp_replace(regexp_replace({UNACCENT}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '))"


def docs(spark, d):
    return v.table(spark, d, "documents").select("doc_id", "text", "lang")


def turns(spark, d):
    return v.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text", "role")


NOISE = "case when len(text) = 0 then 1.0 else 1 - len(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', '', 'g'))::double / len(text) end"
STATUS = f"case when len(trim(text, ' ')) < 20 then 'SEM_TEXTO' when len(trim(text, ' ')) < 200 or {NOISE} > 0.25 then 'SUSPEITA' else 'OK' end"


@query("p04_page_status", f"select doc_id, {STATUS} status from documents")
def page_status(spark, d):
    return p.statuses(docs(spark, d)).select("doc_id", "status")


@query(
    "a47_status_counts",
    f"""select lang, count(*) pages, count(*) filter (where s = 'OK') ok, count(*) filter (where s = 'SUSPEITA') suspeita, count(*) filter (where s = 'SEM_TEXTO') sem_texto
  from (select lang, {STATUS} s from documents) group by 1""",
)
def status_counts(spark, d):
    return p.status_counts(p.statuses(docs(spark, d)), "lang")


@query("x10_text_hash_groups", f"select h hash, count(*) n, min(doc_id) first_id from (select doc_id, {HASH} h from documents) group by 1 having count(*) > 1")
def text_hash_groups(spark, d):
    return docs(spark, d).groupBy(x.semantic_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    "x06_number_offsets",
    r"""with m as (select doc_id, i, list_sum(list_transform(b[:i], lambda z: len(z))) + coalesce(list_sum(list_transform(f[:i - 1], lambda z: len(z))), 0) "start", f[i] "text" from
  (select doc_id, f, string_split_regex(t, '[0-9]+') b, unnest(range(1, len(f) + 1)) i from (select doc_id, text t, regexp_extract_all(text, '[0-9]+') f from documents)))
select doc_id, "start"::bigint "start", "start"::bigint + len("text") "end", "text" from m""",
)
def number_offsets(spark, d):
    found = docs(spark, d).select("doc_id", F.inline(x.matches(F.col("text"), "[0-9]+")))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


@query(
    "g01_fixed_chunks",
    """select doc_id, s // 4500 chunk_index, s "start", least(s + 5000, n) "end", md5(text[s + 1:least(s + 5000, n)]) hash
  from (select doc_id, text, len(text) n, unnest(range(0, greatest(len(text) - 501, 0) + 1, 4500)) s from documents where len(text) > 0)""",
)
def fixed_chunks(spark, d):
    out = p.fixed_chunks(docs(spark, d), 5000, 500)
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("hash"))


@query(
    "w02_page_context",
    """select conv_id doc_id, turn page_num, coalesce(right(lag(text) over w, 30), '') "before", coalesce(left(lead(text) over w, 30), '') behind from conversations window w as (partition by conv_id order by turn)""",
)
def page_context(spark, d):
    return p.with_context(turns(spark, d), 30).select("doc_id", "page_num", "before", "behind")


@query("w15_page_batches")
def page_batches(spark, d):
    rows = turns(spark, d).select("doc_id", "page_num", F.length("text").alias("n_chars"))
    return p.batches(rows, 400).select("doc_id", "page_num", F.col("batch").cast("long").alias("batch"))


@query(
    "x15_running_lines",
    """with l as (select lang, list_filter(list_transform(string_split(text, chr(10)), lambda z: trim(z, ' ')), lambda z: z <> '') x from documents),
e as (select lang, unnest(list_distinct(list_concat(x[:5], case when len(x) > 5 then x[-5:] else [] end))) line from l),
n as (select lang, count(*) pages from documents group by 1)
select lang doc_id, line, count(*) n from e join n using (lang) where len(line) < 100 group by lang, line, pages having count(*) > 0.01 * pages""",
)
def running_lines(spark, d):
    return p.running_lines(docs(spark, d).select(F.col("lang").alias("doc_id"), "text"), share=0.01)


@query(
    "x23_html_parts",
    """select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::bigint n_links,
  md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) text_hash from pages""".replace("\\\\", "\\"),
)
def html_parts(spark, d):
    rows = v.table(spark, d, "pages").select("page_id", x.html_parts(F.col("html")).alias("h"))
    return rows.select("page_id", "h.title", F.size("h.links").cast("long").alias("n_links"), F.md5("h.text").alias("text_hash"))


@query("p29_snippets", "select doc_id, md5(case when len(text) > 4000 then concat(left(text, 3000), chr(10), '[...]', chr(10), right(text, 1000)) else text end) hash from documents")
def snippets(spark, d):
    return docs(spark, d).select("doc_id", F.md5(x.snippet(F.col("text"))).alias("hash"))


@query("x30_tokens_by_language", "select lang, sum(len(text) // 4)::bigint tokens, max(len(text) // 4) longest from documents group by 1")
def tokens_by_language(spark, d):
    tokens = x.token_estimate(F.col("text"))
    return docs(spark, d).groupBy("lang").agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"))


@query(
    "p30_conversation_context",
    """select conv_id, count(*) n_turns, md5(string_agg("role" || ': ' || left(text, 200), chr(10) || chr(10) order by turn)) context_hash from conversations group by 1""",
)
def conversation_context(spark, d):
    line = F.concat("role", F.lit(": "), F.substring("text", 1, 200))
    ordered = F.array_sort(F.collect_list(F.struct("page_num", line.alias("t"))))
    out = turns(spark, d).groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("n_turns"), F.md5(F.array_join(F.transform(ordered, lambda z: z["t"]), "\n\n")).alias("context_hash"))
    return out


@query(
    "x07_turn_similarity",
    """with w as (select conv_id, turn, list_distinct(list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda z: z <> '')) x from conversations),
p as (select a.conv_id, a.turn, a.x, b.x y from w a join w b on a.conv_id = b.conv_id and a.turn + 1 = b.turn)
select conv_id, turn, case when len(list_distinct(list_concat(x, y))) = 0 then 0.0 else len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end similarity from p""".replace("\\\\", "\\"),
)
def turn_similarity(spark, d):
    t = turns(spark, d).select("doc_id", "page_num", x.words(F.lower("text")).alias("x"))
    nxt = t.select("doc_id", (F.col("page_num") - 1).alias("page_num"), F.col("x").alias("y"))
    return t.join(nxt, ["doc_id", "page_num"]).select(F.col("doc_id").alias("conv_id"), F.col("page_num").alias("turn"), x.jaccard(F.col("x"), F.col("y")).alias("similarity"))


@query("a42_label_checks", "select coalesce(quality::varchar, 'none') quality, count(*) n, count(*) filter (where toxic = 1) toxic from documents left join labels using (doc_id) group by 1")
def label_checks(spark, d):
    rows = docs(spark, d).join(v.table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality")).agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("p09_log_search", "select event_id id, event_type msg from events where event_id > 100 and event_type ilike '%click%' order by event_id desc limit 100")
def log_search(spark, d):
    from paperloom.streaming.streams import log_tail

    logs = v.table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("INFO").alias("level"), F.col("event_type").alias("msg"))
    return log_tail(logs, 100, "INFO", "click").select("id", "msg")


@query("x26_titles", """select distinct p_name, array_to_string(list_transform(string_split(replace(replace(p_name, '_', ' '), '-', ' '), ' '), lambda z: upper(z[1]) || lower(z[2:])), ' ') title from part where p_name not like '%.%'""")
def titles(spark, d):
    return v.table(spark, d, "part").where("p_name not like '%.%'").select("p_name", x.title_from_name(F.col("p_name")).alias("title")).distinct()


SMALL_PAGE, SMALL_ZONES = 400, (1000, 600, 50)  # so that most documents are cut

@query(
    "g03_synthetic_pages",
    f"""with recursive c as (select doc_id, "text", 0 page_num, 0::bigint "start", 0::bigint "end" from documents where len("text") > 0
  union all select doc_id, "text", page_num + 1, "end", "end" + case when len(w) = {SMALL_PAGE} and "end" + {SMALL_PAGE} < len("text") and "last" > 0 then "last" + 1 else len(w) end
  from (select *, len(regexp_extract(w, '(?s)^(.*)\\n', 1)) "last" from (select *, substr("text", "end" + 1, {SMALL_PAGE}) w from c where "end" < len("text"))))
select doc_id, page_num::int page_num, "start", "end" from c where page_num > 0""",
)
def synthetic_pages(spark, d):
    return cutting.synthetic_pages(docs(spark, d), SMALL_PAGE)


THRESHOLD, SIZE, OVERLAP = SMALL_ZONES


@query(
    "g05_zones",
    f"""with recursive c as (select doc_id, "text", 0 zone, 0::bigint "start", 0::bigint "end", 0::bigint again from documents where len("text") > {THRESHOLD}
  union all select doc_id, "text", zone + 1, again, e, case when e - {OVERLAP} > again then e - {OVERLAP} else again + {SIZE // 2} end
  from (select *, case when again + {SIZE} >= len("text") then len("text") when "last" > 0 and low + "last" - 1 > again + {SIZE // 2} then low + "last" + 1 else again + {SIZE} end e
    from (select *, greatest(again + {SIZE} - 500, again) low, len(regexp_extract(substr("text", greatest(again + {SIZE} - 500, again) + 1, least(500, {SIZE})), '(?s)^(.*\\n)\\n', 1)) "last" from c where again < len("text"))))
select doc_id, zone::int zone, "start", "end" from c where zone > 0""",
)
def zones(spark, d):
    return cutting.zones(docs(spark, d), None, THRESHOLD, SIZE, OVERLAP, 1_000_000).select("doc_id", "zone", "start", "end")


@query(
    "v09_sql_chunks",
    """select doc_id, (s // 4500)::int chunk_index, s::int "start", least(s + 5000, n)::int "end" from (select doc_id, len("text") n, unnest(range(0, greatest(len("text") - 501, 0) + 1, 4500)) s from documents where len("text") > 0)""",
)
def sql_chunks(spark, d):
    """V9: G1 called in SQL, for each row of a table."""
    cutting.register(spark)
    return spark.sql("select doc_id, c.* from {docs}, lateral text_chunks(text, 5000, 500) c", docs=docs(spark, d))


@query("v09_sql_matches", """select doc_id, count(*) n, sum(len(f))::bigint characters from (select doc_id, unnest(regexp_extract_all("text", '[0-9]+')) f from documents) group by 1""")
def sql_matches(spark, d):
    """V9: X6 called in SQL."""
    cutting.register(spark)
    return spark.sql("select doc_id, count(*) n, sum(end - start) characters from {docs}, lateral text_matches(text, '[0-9]+') m group by doc_id", docs=docs(spark, d))
