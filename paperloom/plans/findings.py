"""Queries over items, findings and votes."""

from pyspark.sql import functions as F

from paperloom.operators import consensus as c
from paperloom.operators import consensus_run as cr
from paperloom.operators import integrity as i
from paperloom.operators import legal
from paperloom.operators.citations import auditor_scores
from paperloom.operators import merging as m
from paperloom.operators import pages as p
from paperloom.plans.documents import docs
from paperloom.plans.registry import query
from paperloom.plans.views_sql import VIEWS, using
from paperloom.sources import views as v

BY = 'doc_id, item_type, "value"'


def findings(spark, d):
    rows = v.spans(spark, d)
    return rows.withColumn("finding_id", F.col("line"))


@query(
    "a13_merged_by_hash",
    using("spans", """select doc_id, item_type, md5("value") hash, count(*) n_items, string_agg(distinct concat(s, '-', e), ',' order by concat(s, '-', e)) spans, count(distinct extractor_id) n_extractors,
  count(distinct lower(trim("value"))) = 1 agreed from spans group by 1, 2, 3"""),
)
def merged_by_hash(spark, d):
    return m.by_hash(v.spans(spark, d))


@query(
    "a14_bucket_conflicts",
    using("spans", """select doc_id, item_type, s // 100 bucket, count(*) n_items, count(distinct "value") n_values, string_agg(distinct "value", ',' order by "value") "values" from spans group by 1, 2, 3 having count(*) > 1 and count(distinct "value") > 1"""),
)
def bucket_conflicts(spark, d):
    return m.conflicts(v.spans(spark, d), "doc_id", "item_type", F.floor(F.col("s") / 100).cast("long").alias("bucket"))


@query(
    "a15_exact_conflicts",
    using("spans", """select doc_id, item_type, s, e, count(*) n_items, count(distinct "value") n_values, string_agg(distinct "value", ',' order by "value") "values" from spans group by 1, 2, 3, 4 having count(*) > 1 and count(distinct "value") > 1"""),
)
def exact_conflicts(spark, d):
    return m.conflicts(v.spans(spark, d), "doc_id", "item_type", "s", "e")


@query("a17_first_wins", using("spans", f"""select {BY}, first(s order by line, s, e) s, first(e order by line, s, e) e, count(*) n_spans from spans group by 1, 2, 3"""))
def first_wins(spark, d):
    return m.first_wins(v.spans(spark, d))


@query(
    "a19_weak_source_discard",
    using(
        "spans",
        """select doc_id, extractor_id, line, not strong unique_source from h join k using (doc_id, extractor_id) join u using (doc_id, "value") where strong or n_sources = 1""",
        """h as (select doc_id, extractor_id, line, "value" from spans), k as (select doc_id, extractor_id, n >= 0.8 * avg(n) over (partition by doc_id) strong from (select doc_id, extractor_id, count(*) n from h group by 1, 2)),
  u as (select doc_id, "value", count(distinct extractor_id) n_sources from h group by 1, 2)""",
    ),
)
def weak_source_discard(spark, d):
    return m.keep_strong(v.spans(spark, d), 0.8).select("doc_id", "extractor_id", "line", "unique_source")


@query(
    "j11_locked_entities",
    using("spans", f"""select {BY}, s, e from (select *, row_number() over (partition by {BY} order by s, e, line) n from l where not exists (select 1 from spans i where i.extractor_id <> 'E0' and i.doc_id = l.doc_id and i.item_type = l.item_type and i."value" = l."value")) where n = 1""", "l as (select * from spans where extractor_id = 'E0')"),
)
def locked_entities(spark, d):
    s = v.spans(spark, d)
    return m.add_missing(s.where("extractor_id <> 'E0'"), s.where("extractor_id = 'E0'")).select("doc_id", "item_type", "value", "s", "e")


@query("j31_page_matrix", using("spans", """select doc_id, page_num, string_agg(concat(extractor_id, ':', n), ',' order by extractor_id) by_extractor from (select doc_id, s // 50 + 1 page_num, extractor_id, count(*) n from spans group by all) group by 1, 2"""))
def page_matrix(spark, d):
    return m.page_matrix(v.spans(spark, d).withColumn("page_num", (F.floor(F.col("s") / 50) + 1).cast("long")))


EDGE = "a.doc_id = b.doc_id and a.auditor_id < b.auditor_id and least(a.e, b.e) > greatest(a.s, b.s) and least(a.e, b.e) - greatest(a.s, b.s) >= 0.3 * least(a.e - a.s, b.e - b.s)"


@query("j07_overlap_edges", using("spans", f"select a.doc_id, a.line a, b.line b, least(a.e, b.e) - greatest(a.s, b.s) shared from spans a join spans b on {EDGE}"))
def overlap_edges(spark, d):
    return c.overlap_edges(findings(spark, d), longest=50)


# A finding joins the first seed before it, of another auditor, that it overlaps enough; else it is a seed itself.
CLUSTERS = """f as (select doc_id, auditor_id, line finding_id, s, e, severity, row_number() over (partition by doc_id order by auditor_id, line) n from spans),
g as (select doc_id, 0::bigint n, []::struct(a varchar, f bigint, s bigint, e bigint)[] seeds, null::bigint finding_id, null::bigint cluster_id, null::varchar auditor_id, null::varchar severity from (select distinct doc_id from f)
  union all select doc_id, n, case when hit is null then list_append(seeds, {'a': auditor_id, 'f': finding_id, 's': s, 'e': e}) else seeds end, finding_id, coalesce(hit, finding_id), auditor_id, severity
  from (select f.*, g.seeds, list_filter(g.seeds, lambda z: z.a <> f.auditor_id and least(z.e, f.e) - greatest(z.s, f.s) > 0 and least(z.e, f.e) - greatest(z.s, f.s) >= 0.3 * least(z.e - z.s, f.e - f.s))[1].f hit from g join f on f.doc_id = g.doc_id and f.n = g.n + 1)),
clustered as (select * from g where n > 0)"""


def clustered_sql(body: str, more: str = "") -> str:
    return f"with recursive spans as ({VIEWS['spans']}), {CLUSTERS}{', ' + more if more else ''} {body}"


@query("j07_clusters", clustered_sql("select doc_id, finding_id, cluster_id from clustered"))
def clusters(spark, d):
    return c.clusters(findings(spark, d)).select("doc_id", "finding_id", "cluster_id")


def _tens(spark, d):
    return findings(spark, d).withColumn("cluster_id", F.floor(F.col("s") / 100).cast("long"))


RANK = "case severity when 'baixo' then 0 when 'medio' then 1 when 'alto' then 2 else 3 end"


@query(
    "a27_contradictions",
    using("spans", """select doc_id, cluster_id, max("rank") most, min("rank") "least" from l group by 1, 2 having max("rank") = 3 and min("rank") <= 1""", f"""l as (select doc_id, s // 100 cluster_id, auditor_id, last({RANK} order by line) "rank" from spans group by 1, 2, 3)"""),
)
def contradictions(spark, d):
    return c.contradictions(_tens(spark, d))


@query(
    "a28_omissions",
    using("spans", """select doc_id, cluster_id, array_to_string(list_filter(['A0', 'A1', 'A2', 'A3'], lambda z: not list_contains(have, z)), ',') missing, most = 3 suspected from g where most >= 2 and len(have) < 4""", f"g as (select doc_id, s // 100 cluster_id, list(distinct auditor_id) have, max({RANK}) most from spans group by 1, 2)"),
)
def omissions(spark, d):
    return c.omissions(_tens(spark, d), ["A0", "A1", "A2", "A3"])


@query(
    "a26_cluster_scores",
    using(
        "spans",
        """select doc_id, cluster_id, n n_auditors, score, case when score >= 0.8 then 'certified' when score >= 0.6 then 'probable' when score >= 0.4 then 'possible' else 'weak' end category
  from (select doc_id, cluster_id, count(*) n, 0.5::double * count(*) / 4 + 0.3::double * 1.0 + 0.2::double * 0.5 score from (select distinct doc_id, s // 100 cluster_id, auditor_id from spans) group by 1, 2)""",
    ),
)
def cluster_scores(spark, d):
    rows = _tens(spark, d)
    validity = rows.select("auditor_id").distinct().withColumns({"validity": F.lit(1.0), "compliance": F.lit(0.5)})
    return c.scores(rows, validity, 4)


@query("a30_category_histogram", using("spans", "select severity, count(*) n from spans group by 1"))
def category_histogram(spark, d):
    return findings(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@query(
    "x24_raised_severity",
    using("spans", f"""select severity before, case greatest({RANK}, case when item_type = 'date' and line % 2 = 0 then 3 when item_type = 'date' or (line % 3 = 0 and s > 0) then 2 when s > 0 then 1 else 0 end) when 0 then 'baixo' when 1 then 'medio' when 2 then 'alto' else 'critico' end severity, count(*) n from spans group by 1, 2"""),
)
def raised_severity(spark, d):
    f = findings(spark, d)
    law, essential, word, cited = F.col("item_type") == "date", F.col("line") % 2 == 0, F.col("line") % 3 == 0, F.col("s") > 0
    return f.select(F.col("severity").alias("before"), c.raised(F.col("severity"), law, essential, word, cited).alias("severity")).groupBy("before", "severity").agg(F.count("*").alias("n"))


@query(
    "w10_selection",
    using("spans", "select run_id, auditor_id, priority, seq from (select *, row_number() over (partition by run_id order by priority, seq, auditor_id) nr from (select *, row_number() over (partition by run_id, auditor_id order by priority, seq) na from r) where na <= 1) where nr <= 3", f"r as (select doc_id run_id, auditor_id, 3 - {RANK} priority, line seq from spans)"),
)
def selection(spark, d):
    f = findings(spark, d)
    return c.selection(f.select(F.col("doc_id").alias("run_id"), "auditor_id", (3 - c.severity_rank(F.col("severity"))).alias("priority"), F.col("line").alias("seq")))


VOTES = """v as (select user_id, strftime(ts, '%Y-%m-%d') "day", event_type vote from (select *, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d') order by ts, event_id) n from events) where n <= 3),
g as (select user_id, "day", vote, count(*) n from v group by 1, 2, 3), b as (select user_id, "day", first(vote order by n desc, vote) w, max(n) most, sum(n) total from g group by 1, 2)"""


@query(
    "a11_majority_vote",
    f"""with {VOTES} select user_id, "day", case when most = 1 and total > 1 then 'multi' else w end winner, case when most >= 3 then 'unanimous' when most = 2 then 'majority' when total = 1 then 'single' else 'split' end "level",
  case when most >= 3 then 1.0 when most = 2 then 0.75 when total = 1 then 0.5 else 0.33 end::double score from b""",
)
def majority_vote(spark, d):
    from pyspark.sql import Window

    day = F.date_format("ts", "yyyy-MM-dd")
    nth = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    votes = v.table(spark, d, "events").withColumn("day", day).withColumn("nth", nth).where("nth <= 3").select("user_id", "day", F.col("event_type").alias("vote"))
    return c.vote(votes, "user_id", "day")


@query(
    "a12_distinct_keywords",
    """with w as (select doc_id, pos, word from (select doc_id, string_split(text, ' ') x, unnest(range(1, len(string_split(text, ' ')) + 1)) pos, x[pos] word from documents) where len(word) > 6),
f as (select doc_id, lower(word) w, min(pos) pos from w group by 1, 2), r as (select *, row_number() over (partition by doc_id order by pos, w) n from f)
select doc_id, string_agg(w, ',' order by n) keywords from r where n <= 10 group by 1""",
)
def distinct_keywords(spark, d):
    words = docs(spark, d).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where(F.length("word") > 6)
    return c.distinct_keywords(words)


CITED = "cited as (select item_id, text excerpt from benchmark)"


@query(
    "j16_citation_places",
    f"""with {CITED} select doc_id, item_id, position(lower(excerpt) in lower(text)) - 1 "start", position(lower(excerpt) in lower(text)) - 1 + len(excerpt) "end" from documents, cited where contains(lower(text), lower(excerpt))""",
)
def citation_places(spark, d):
    return c.locate(docs(spark, d), v.table(spark, d, "benchmark").select("item_id", F.col("text").alias("excerpt")))


@query(
    "j16_all_places",
    f"""with {CITED}, f as (select doc_id, item_id, len(excerpt) size, list_filter(range(1, len(text) + 1), lambda z: substring(lower(text), z, len(excerpt)) = lower(excerpt)) places from documents, cited where contains(lower(text), lower(excerpt)))
select doc_id, item_id, place - 1 "start", place - 1 + size "end", n from (select doc_id, item_id, size, len(places) n, unnest(places) place from f)""",
)
def all_places(spark, d):
    return c.all_places(docs(spark, d), v.table(spark, d, "benchmark").select("item_id", F.col("text").alias("excerpt")))


@query("a24_citation_scores", using("spans", """select auditor_id, count(*) total, count(*) filter (where line % 3 > 0) valid, count(*) filter (where line % 3 > 0)::double / count(*) score from spans group by 1"""))
def citation_scores(spark, d):
    return c.citation_scores(findings(spark, d).withColumn("status", F.when(F.col("line") % 3 > 0, "valid").otherwise("ambiguous")))


RULES = ", ".join(f"('{n}', '{g}', {a}::double, {b}::double, {'null' if t is None else t}::double)" for n, g, a, b, t in i.RULES)
KINDS = ["RANGE_INVALID", "EXCERPT_MISMATCH", "PAGES_MISSING"]


@query(
    "a31_penalties",
    using(
        "model_calls",
        "select run_id, least(sum(part), 0.40::double) penalty, coalesce(min(ceiling), 1.0)::double ceiling, first(category order by -round(part, 9), category) dominant from g group by 1",
        f"""rules(error_type, category, each, most, ceiling) as (values {RULES}),
  e as (select user_id run_id, case error_type when 'TIMEOUT' then 'RANGE_INVALID' when 'JSON_PARSE' then 'EXCERPT_MISMATCH' else 'PAGES_MISSING' end error_type, count(*) n from model_calls where error_type is not null group by 1, 2),
  g as (select run_id, category, sum(least(n * each, most)) part, min(ceiling) ceiling from e join rules using (error_type) group by 1, 2)""",
    ),
)
def penalties(spark, d):
    kind = F.when(F.col("error_type") == "TIMEOUT", KINDS[0]).when(F.col("error_type") == "JSON_PARSE", KINDS[1]).otherwise(KINDS[2])
    calls = v.model_calls(spark, d).where("error_type is not null")
    return i.penalties(calls.select(F.col("user_id").alias("run_id"), kind.alias("error_type"), F.lit(1).cast("long").alias("n")))


@query("j18_unknown_documents", "select doc_id, quality from labels where not exists (select 1 from documents d where d.doc_id = labels.doc_id and d.lang = 'en')")
def unknown_documents(spark, d):
    cited = v.table(spark, d, "labels").select("doc_id", "quality")
    return i.unknown_ids(cited, docs(spark, d).where("lang = 'en'"), "doc_id")


@query(
    "j20_files_present",
    """with e as (select p_partkey name, p_size > 25 critical from part where p_size <= 30), p as (select distinct l_partkey name from lineitem where l_returnflag = 'R')
select coalesce(e.name, p.name) name, case when e.name is null then 'extra' when p.name is null then 'missing' else 'present' end status, case when e.name is not null and p.name is null then case when critical then 'ERROR' else 'WARNING' end end severity from e full join p on e.name = p.name""",
)
def files_present(spark, d):
    expected = v.table(spark, d, "part").where("p_size <= 30").select(F.col("p_partkey").alias("name"), (F.col("p_size") > 25).alias("critical"))
    return i.files_present(expected, v.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("name")))


@query("a34_count_mismatches", """select o_orderkey run_id, reported, actual from (select o_orderkey, o_orderkey % 8 reported from orders) join (select l_orderkey, count(*) actual from lineitem group by 1) on o_orderkey = l_orderkey where abs(reported - actual) > 5""")
def count_mismatches(spark, d):
    actual = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("actual"))
    reported = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 8).alias("reported"))
    return i.count_mismatches(reported.join(actual, "run_id")).select("run_id", "reported", "actual")


@query(
    "j23_dual_lookup",
    """with a as (select distinct l_orderkey nid, l_linenumber "version", l_partkey article from lineitem), c as (select l_orderkey nid, 1 version_then, 2 version_now, min(l_partkey) article from lineitem group by 1)
select c.nid, version_then, version_now, c.article, t.nid is not null valid_then, w.nid is not null valid_now, (t.nid is not null) <> (w.nid is not null) changed
from c left join a t on t.nid = c.nid and t.article = c.article and t."version" = version_then left join a w on w.nid = c.nid and w.article = c.article and w."version" = version_now""",
)
def dual_lookup(spark, d):
    line = v.table(spark, d, "lineitem")
    articles = line.select(F.col("l_orderkey").alias("nid"), F.col("l_linenumber").alias("version"), F.col("l_partkey").alias("article"))
    checks = articles.groupBy("nid").agg(F.min("article").alias("article")).select("nid", F.lit(1).alias("version_then"), F.lit(2).alias("version_now"), "article")
    return legal.dual_lookup(checks, articles)


@query(
    "j27_missed_signals",
    """with s as (select conv_id doc_id, regexp_extract(text, '[A-Za-z]{5,}') signal from conversations where turn % 2 = 0), e as (select conv_id doc_id, text "value" from conversations where turn % 2 = 1),
h as (select doc_id, signal, coalesce((select bool_or(contains("value", signal)) from e where e.doc_id = s.doc_id), false) hit from s)
select doc_id, count(*) signals, count(*) filter (where not hit) missed, count(*) filter (where hit)::double / count(*) recall from h group by 1""",
)
def missed_signals(spark, d):
    t = v.table(spark, d, "conversations")
    signals = t.where("turn % 2 = 0").select(F.col("conv_id").alias("doc_id"), F.regexp_extract("text", "[A-Za-z]{5,}", 0).alias("signal"))
    return p.missed_signals(signals, t.where("turn % 2 = 1").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("value")))


@query("j22_resolved_names")
def resolved_names(spark, d):
    part = v.table(spark, d, "part")
    laws = part.where("p_partkey % 2 = 0").select(F.col("p_type").alias("alias"), F.col("p_brand").alias("law")).groupBy("alias").agg(F.min("law").alias("law"))
    return legal.resolve_names(part.select(F.col("p_type").alias("name")), laws)


# A finding's citation is valid where its range has ten characters or more; an auditor with a range of one has a parse error.
AUDITORS = "au as (select auditor_id, avg(case when e - s >= 10 then 1.0 else 0.0 end) score, case when bool_or(e - s = 1) then 0.7 else 1.0 end compliance from spans group by 1)"
SCORES = f"""{AUDITORS}, mem as (select distinct doc_id, cluster_id, auditor_id from clustered),
lead as (select doc_id, cluster_id, first({RANK} order by auditor_id, finding_id) lead from clustered group by 1, 2),
sc as (select doc_id, cluster_id, count(*) n, avg(score) v, avg(compliance) o from mem join au using (auditor_id) group by 1, 2),
last as (select doc_id, cluster_id, auditor_id, last({RANK} order by finding_id) r, max({RANK}) most from clustered group by 1, 2, 3),
x as (select doc_id, cluster_id, max(r) = 3 and min(r) <= 1 contradicts, max(most) most, list(auditor_id) have from last group by 1, 2)"""


def _run(spark, d, n_runs=cr.PHASE_C):
    rows = findings(spark, d)
    size = F.col("e") - F.col("s")
    checks = rows.select("auditor_id", F.when(size >= 10, "VALID_EXACT").otherwise("INVALID").alias("status"))
    errors = rows.groupBy("auditor_id").agg(F.max(size == 1).alias("bad")).select("auditor_id", F.when(F.col("bad"), F.array(F.lit("cannot parse"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    compliance = errors.select("auditor_id", i.compliance(F.col("errors")).alias("compliance"))
    return cr.run(rows, auditor_scores(checks), compliance, ["A0", "A1", "A2", "A3"], n_runs)


@query(
    "v05_consensus",
    clustered_sql(
        """select sc.doc_id, sc.cluster_id, n n_auditors, round(0.5::double * n / 4 + 0.3::double * v + 0.2::double * o, 4) score,
  case when n >= 3 and v >= 0.7 then 'FACTO_CERTIFICADO' when n >= 2 and v >= 0.5 then 'FACTO_PROVAVEL' when n = 1 then case when lead >= 2 then 'FINDING_ISOLADO' else 'NAO_FIAVEL' end else 'FACTO_PROVAVEL' end category,
  contradicts, case when most >= 2 and len(have) < 4 then array_to_string(list_filter(['A0', 'A1', 'A2', 'A3'], lambda z: not list_contains(have, z)), ',') end missing
  from sc join lead using (doc_id, cluster_id) join x using (doc_id, cluster_id)""",
        SCORES,
    ),
)
def consensus(spark, d):
    """V5: each cluster with its score, whether auditors contradict each other in it, and who is silent."""
    out = _run(spark, d)
    key = ["doc_id", "cluster_id"]
    against = out.contradictions.select(*key, F.lit(True).alias("contradicts"))
    return out.scores.join(against, key, "left").join(out.omissions.select(*key, "missing"), key, "left").fillna(False, ["contradicts"])


@query(
    "v05_asked_again",
    clustered_sql(
        """select doc_id, kind, cluster_id, auditor_id from (select *, row_number() over (partition by doc_id order by priority, cluster_id, auditor_id nulls first) nr from
  (select *, row_number() over (partition by doc_id, auditor_id order by priority, cluster_id) na from iss) where na <= 1) where nr <= 3""",
        SCORES
        + """, iss as (select doc_id, cluster_id, 1 priority, 'CONTRADICTION' kind, null::varchar auditor_id from x where contradicts
  union all select doc_id, cluster_id, 2, 'OMISSION_SUSPECTED', unnest(list_filter(['A0', 'A1', 'A2', 'A3'], lambda z: not list_contains(have, z))) from x where most = 3 and len(have) < 4)""",
    ),
)
def asked_again(spark, d):
    return _run(spark, d).asked_again.select("doc_id", "kind", F.col("seq").alias("cluster_id"), "auditor_id")


@query(
    "e38_first_success",
    using(
        "model_calls",
        """select user_id, min(created_at) filter (where success) attempt, first(model order by created_at) filter (where success) result, coalesce(min(n) filter (where success), max(n)) n_tried,
  coalesce(min(n) filter (where success), 0) > 1 substitute from (select *, row_number() over (partition by user_id order by created_at) n from model_calls) group by 1""",
    ),
)
def first_success(spark, d):
    calls = v.model_calls(spark, d)
    return cr.first_success(calls.select("user_id", F.col("created_at").alias("attempt"), F.col("success").alias("ok"), F.col("model").alias("result")), "user_id")
