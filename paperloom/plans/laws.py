"""Queries over law citations: one at the end of each document, of each law in turn."""

import re

from pyspark.sql import functions as F

from paperloom.functions.laws import LAWS
from paperloom.operators import legal
from paperloom.plans.documents import docs
from paperloom.plans.registry import query


def mention(pattern: str) -> str:
    """A text that a pattern of LAWS matches: optional parts are there, of alternative letters the first."""
    text = pattern.replace(r"(?:n[.º°]?\s*)?(\d+[/-]\d+)", "12/2004").replace(r"\b", "").replace("[- ]", "-").replace(r"\s*", " ")
    return re.sub(r" +", " ", re.sub(r"\[(.)[^]]*\]", r"\1", text.replace("(?:", "").replace(")?", ""))).strip()


def named(text: str) -> str:
    """The law of a mention, by trying the patterns one by one."""
    for pattern, name in LAWS:
        if m := re.search(pattern, text):
            return name.replace("#", m[1] if m.re.groups else "")
    raise ValueError(text)


MENTIONS = [mention(p) for p, _ in LAWS]
N = len(MENTIONS)
NAME = f"case doc_id % {N} " + " ".join(f"when {i} then '{named(m)}'" for i, m in enumerate(MENTIONS)) + " end"
PARTS = f"select doc_id, {NAME} law, concat(doc_id % 900 + 1, 'º') article, (doc_id % 9 + 1)::varchar number, concat(chr((97 + doc_id % 26)::int), ')') clause from documents"


def with_citation(spark, d):
    i = F.col("doc_id")
    law = F.element_at(F.array(*map(F.lit, MENTIONS)), (i % N + 1).cast("int"))
    text = F.concat(F.lit("\nartigo "), (i % 900 + 1).cast("string"), F.lit("º, n.º "), (i % 9 + 1).cast("string"), F.lit(", alínea "), F.chr(97 + i % 26), F.lit(") do "), law, F.lit("."))
    return docs(spark, d).select("doc_id", F.concat("text", text).alias("text"))


@query("x21_law_citations", f"select doc_id, law, article, number, clause, concat(law, ', artigo ', article, ', n.º ', number, ', alínea ', clause) normalised from ({PARTS})")
def law_citations(spark, d):
    found = legal.citations(with_citation(spark, d))
    return found.select("doc_id", "law", "article", "number", "clause", "normalised")


@query("x20_citations_by_law", f"select law, count(*) n, min(doc_id) first_id from ({PARTS}) group by 1")
def citations_by_law(spark, d):
    return legal.citations(with_citation(spark, d)).groupBy("law").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
