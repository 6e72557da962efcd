"""Findings of several auditors."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import grams_of
from paperloom.operators.ranges import self_overlapping
from paperloom.operators.telemetry import ratio

SEVERITIES = ["baixo", "medio", "alto", "critico"]  # fixed values, in order
FINDING = "doc_id long, auditor_id string, finding_id long, s long, e long, severity string, cluster_id long"


def severity_rank(severity: Column) -> Column:
    """0 to 3; unknown ones count as medium."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(F.trim(severity)))
    return F.when(at > 0, at - 1).otherwise(F.lit(1)).cast("int")


def raised(severity: Column, imperative: Column, essential: Column, keyword: Column, cited: Column) -> Column:
    """Critical with an imperative norm and an essential element; at least high with a norm, or with a keyword and a
    citation; at least medium with a citation."""
    rank = severity_rank(severity)
    new = F.when(imperative & essential, 3).when(imperative | (keyword & cited), F.greatest(rank, F.lit(2))).when(cited, F.greatest(rank, F.lit(1))).otherwise(rank)
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), new + 1)


def overlap_edges(findings: DataFrame, least: float = 0.3, longest: int | None = None) -> DataFrame:
    """J7, edges: pairs of findings of one document and different auditors that overlap by ``least`` of the shorter."""
    rows = findings.select("doc_id", "auditor_id", "finding_id", "s", "e")
    met = self_overlapping(rows, "doc_id", longest=longest)
    # The later start is b's; equal starts meet in both orders, of which one stays.
    met = met.where("a.auditor_id <> b.auditor_id and (a.s < b.s or a.auditor_id < b.auditor_id)")
    shared = F.least("a.e", "b.e") - F.col("b.s")
    shorter = F.least(F.col("a.e") - F.col("a.s"), F.col("b.e") - F.col("b.s"))
    met = met.where((shared > 0) & (shared >= least * shorter))
    in_order = F.col("a.auditor_id") < F.col("b.auditor_id")
    first, second = F.when(in_order, F.col("a")).otherwise(F.col("b")), F.when(in_order, F.col("b")).otherwise(F.col("a"))
    return met.select("a.doc_id", first["finding_id"].alias("a"), second["finding_id"].alias("b"), shared.alias("shared"))


def _greedy(least: float):
    def cluster(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, findings in zip(batch.column("doc_id").to_pylist(), batch.column("findings").to_pylist(), strict=True):
                free = list(findings)
                while free:
                    seed, rest = free[0], []
                    out.append((doc, *seed.values(), seed["finding_id"]))
                    for f in free[1:]:
                        shared = min(seed["e"], f["e"]) - max(seed["s"], f["s"])
                        if f["auditor_id"] != seed["auditor_id"] and shared > 0 and shared >= least * min(seed["e"] - seed["s"], f["e"] - f["s"]):
                            out.append((doc, *f.values(), seed["finding_id"]))
                        else:
                            rest.append(f)
                    free = rest
            names = ["doc_id", "auditor_id", "finding_id", "s", "e", "severity", "cluster_id"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return cluster


def clusters(findings: DataFrame, least: float = 0.3) -> DataFrame:
    """Greedy clusters in order of (auditor_id, finding_id). The first free finding is a seed; free findings of other
    auditors that overlap the seed enough join it. Findings depend on each other only where they overlap, so a document
    is cut where no finding crosses, and what lies between two cuts is one row."""
    one = F.struct("auditor_id", "finding_id", "s", "e", "severity")
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = findings.withColumn("new", F.when(reach.isNull() | (F.col("s") >= reach), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per_island = marked.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(one)).alias("findings"))
    return per_island.mapInArrow(_greedy(least), FINDING)


def contradictions(clustered: DataFrame) -> DataFrame:
    """Clusters in which one auditor's last finding is critical and another's at most medium."""
    last = clustered.groupBy("doc_id", "cluster_id", "auditor_id").agg(F.max_by(severity_rank(F.col("severity")), "finding_id").alias("rank"))
    out = last.groupBy("doc_id", "cluster_id").agg(F.max("rank").alias("most"), F.min("rank").alias("least"))
    return out.where("most = 3 and least <= 1")


def omissions(clustered: DataFrame, auditors: list[str]) -> DataFrame:
    """Auditors that are silent in clusters of high or critical severity; suspected for critical ones."""
    groups = clustered.groupBy("doc_id", "cluster_id").agg(F.collect_set("auditor_id").alias("have"), F.max(severity_rank(F.col("severity"))).alias("most"))
    out = groups.where("most >= 2").withColumn("missing", F.array_except(F.array(*map(F.lit, auditors)), "have"))
    return out.where(F.size("missing") > 0).select("doc_id", "cluster_id", F.array_join("missing", ",").alias("missing"), (F.col("most") == 3).alias("suspected"))


def scores(clustered: DataFrame, validity: DataFrame, n_auditors: int) -> DataFrame:
    """Half the share of auditors that agree, 0.3 of their mean validity and 0.2 of their mean compliance, with a
    category. validity: (auditor_id, validity, compliance)."""
    members = clustered.select("doc_id", "cluster_id", "auditor_id").distinct().join(validity, "auditor_id")
    out = members.groupBy("doc_id", "cluster_id").agg(F.count("*").alias("n"), F.avg("validity").alias("v"), F.avg("compliance").alias("c"))
    score = 0.5 * F.col("n") / F.lit(n_auditors) + 0.3 * F.col("v") + 0.2 * F.col("c")
    return out.select("doc_id", "cluster_id", F.col("n").alias("n_auditors"), score.alias("score"), F.when(score >= 0.8, "certified").when(score >= 0.6, "probable").when(score >= 0.4, "possible").otherwise("weak").alias("category"))


def citation_scores(checked: DataFrame) -> DataFrame:
    """Valid over all citations of each auditor; an ambiguous one counts as not valid."""
    valid = F.count_if(F.col("status") == "valid")
    return checked.groupBy("auditor_id").agg(F.count("*").alias("total"), valid.alias("valid"), F.when(F.count("*") == 0, F.lit(1.0)).otherwise(ratio(valid, F.count("*"))).alias("score"))


def folded(text: Column) -> Column:
    """Lower case of the same length, so that places in it are places in the text."""
    return F.lower(F.translate(text, "\u0130", "i"))


def occurrences(text: Column, excerpt: Column) -> Column:
    """Places of an excerpt in a text without regard to case, overlapping ones too; none of an empty excerpt."""
    inside, x = folded(text), folded(excerpt)
    n = F.size(F.split(inside, F.concat(F.lit(r"(?=\Q"), x, F.lit(r"\E)")), -1)) - F.when(inside.startswith(x), 0).otherwise(1)
    return F.when(F.length(x) > 0, n).otherwise(0)


def _tokens(text: Column) -> Column:
    return F.split(folded(text), r"\s+")


def _pairs(docs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(doc_id, text, item_id, excerpt) of all documents that hold an excerpt, without regard to case. Words inside an
    excerpt are whole words of the document, so both sides meet on the longest of them. An excerpt of one or two words
    meets, by its longest word's first three characters, all words of the documents that hold that word. Blank excerpts
    meet documents by their first character; the empty one, a row at most, meets all."""
    wanted = excerpts.where("excerpt is not null").select("excerpt").distinct()
    longest = lambda x: F.array_max(F.transform(x, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    inner = longest(F.filter(_tokens(F.col("excerpt")), lambda w, at: (at > 0) & (at < F.size(_tokens(F.col("excerpt"))) - 1)))
    wanted = wanted.select("excerpt", inner.alias("inner"), longest(_tokens(F.col("excerpt"))).alias("outer"))
    words = docs.select("doc_id", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("word"))
    whole = wanted.where("inner <> ''").select("excerpt", F.col("inner").alias("word"))
    short = wanted.where("coalesce(inner, '') = '' and outer <> ''").select("excerpt", "outer", F.substring("outer", 1, 3).alias("gram"))
    grams = F.concat(*[grams_of(F.col("word"), n) for n in (1, 2, 3)])
    held = words.select("word").distinct().select("word", F.explode(grams).alias("gram")).join(short, "gram").where(F.col("word").contains(F.col("outer")))
    met = words.join(whole.unionByName(held.select("excerpt", "word")), "word").select(F.col("doc_id").alias("d"), "excerpt").distinct()
    has = folded(F.col("text")).contains(folded(F.col("excerpt")))
    blank = wanted.where("outer = '' and excerpt <> ''").select("excerpt", F.substring("excerpt", 1, 1).alias("word"))
    spaces = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"\s"), 0))
    met = met.unionByName(docs.select(F.col("doc_id").alias("d"), F.explode(spaces).alias("word")).join(blank, "word").select("d", "excerpt").distinct())
    pairs = met.join(docs, F.col("d").eqNullSafe(F.col("doc_id"))).where(has).select("doc_id", "text", "excerpt")
    pairs = pairs.unionByName(docs.where("text is not null").select("doc_id", "text").crossJoin(F.broadcast(wanted.where("excerpt = ''").select("excerpt").limit(1))))
    return pairs.join(excerpts.select("item_id", "excerpt"), "excerpt")


def locate(docs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """The first exact occurrence of each excerpt (item_id, excerpt) in each document that has it."""
    start = F.instr(folded(F.col("text")), folded(F.col("excerpt"))) - 1
    return _pairs(docs, excerpts).select("doc_id", "item_id", start.cast("long").alias("start"), (start + F.length("excerpt")).cast("long").alias("end"))


def _starts(text: Column, excerpt: Column) -> Column:
    @F.pandas_udf("array<long>")
    def starts(texts: pd.Series, excerpts: pd.Series) -> pd.Series:
        out = []
        for text, excerpt in zip(texts, excerpts, strict=True):
            found, at = [], text.find(excerpt)
            while at >= 0:
                found.append(at)
                at = text.find(excerpt, at + 1)
            out.append(found)
        return pd.Series(out)

    return starts(text, excerpt)


def all_places(docs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Every exact occurrence of excerpts (item_id, excerpt) in documents, overlapping ones too, with the number of
    occurrences of the excerpt in the document; none of an empty excerpt."""
    found = _pairs(docs, excerpts.where("excerpt <> ''")).withColumn("starts", _starts(folded(F.col("text")), folded(F.col("excerpt"))))
    out = found.select("doc_id", "item_id", F.size("starts").cast("long").alias("n"), F.length("excerpt").alias("size"), F.explode("starts").alias("start"))
    return out.select("doc_id", "item_id", "start", (F.col("start") + F.col("size")).alias("end"), "n")


def vote(votes: DataFrame, *keys: str) -> DataFrame:
    """Three equal votes are unanimous (1.0), two a majority (0.75), a single voter counts 0.5, else split (0.33)."""
    counts = votes.groupBy(*keys, "vote").agg(F.count("*").alias("n"))
    best = F.min_by("vote", F.struct(-F.col("n"), F.col("vote")))
    out = counts.groupBy(*keys).agg(best.alias("winner"), F.max("n").alias("most"), F.sum("n").alias("total"))
    level = F.when(F.col("most") >= 3, "unanimous").when(F.col("most") == 2, "majority").when(F.col("total") == 1, "single").otherwise("split")
    score = F.when(F.col("most") >= 3, 1.0).when(F.col("most") == 2, 0.75).when(F.col("total") == 1, 0.5).otherwise(0.33)
    return out.select(*keys, F.when(level == "split", "multi").otherwise(F.col("winner")).alias("winner"), level.alias("level"), score.alias("score"))


def distinct_keywords(words: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` distinct words of each document without regard to case, in order. words: (doc_id,
    pos, word)."""
    first = words.groupBy("doc_id", F.lower("word").alias("w")).agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "w"))).where(F.col("nth") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "w")))
    return ranked.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["w"]), ",").alias("keywords"))


def selection(issues: DataFrame, per_auditor: int = 1, per_run: int = 3) -> DataFrame:
    """Issues (run_id, auditor_id, priority, seq) by priority, at most so many an auditor and a run."""
    a = Window.partitionBy("run_id", "auditor_id").orderBy("priority", "seq")
    r = Window.partitionBy("run_id").orderBy("priority", "seq", "auditor_id")
    return issues.withColumn("na", F.row_number().over(a)).where(F.col("na") <= per_auditor).withColumn("nr", F.row_number().over(r)).where(F.col("nr") <= per_run).drop("na", "nr")


def adaptive_weights(history: DataFrame) -> DataFrame:
    """Mean validity of each auditor, 0.3 at least."""
    return history.groupBy("auditor_id").agg(F.greatest(F.lit(0.3), F.avg("validity")).alias("weight"))


def longest_text(texts: DataFrame) -> DataFrame:
    """A39, the choice: each page's longest text, the first provider on a tie, and how many providers agree with it."""
    best = F.max_by(F.struct("provider", "text"), F.struct(F.length("text"), -F.col("ord")))
    chosen = texts.groupBy("doc_id", "page_num").agg(best.alias("b"), F.count("*").alias("n_texts"))
    return chosen.select("doc_id", "page_num", "b.provider", "b.text", "n_texts")
