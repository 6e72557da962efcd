"""Citations held against their documents.

A document's citations are dealt to groups of CITATIONS by hash; each group meets the document's text once. A document that
is cited by a third of all rows is many groups, spread by the hash that deals them.

Defined results: a null or blank excerpt is INVALID and has no places; so are citations of documents that aren't there, or whose
text is null; a declared page that the document doesn't have is passed over, and counts as a mismatch where the excerpt lies
on another one. Rows that repeat are each answered. V4 takes white space off the ends of an excerpt, J17 searches it
as it is given. Of places of equal ratio the first is the best. Lower case keeps lengths (İ is read as i), so offsets are the text's own.
"""

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.places import Document, prepare

CITATIONS = 64  # that meet a text at once
CHARACTERS = 1 << 20  # of texts, once for each of their citations, that are searched together
LEAST = 0.85  # ratio of a near place
PLACE = "doc_id long, item_id string, start long, end long, ratio double"
CHECKED = "doc_id long, item_id string, page_declared long, status string, start long, end long, page_num long, ratio double, n_places long"


def _grouped(docs: DataFrame, pages: DataFrame | None, citations: DataFrame) -> DataFrame:
    """(doc_id, text, pages, cited): a row for each group of a document's citations."""
    cited = F.struct(F.col("item_id").cast("string").alias("item_id"), "excerpt", F.col("page_num").cast("long").alias("page_num"))
    counts = citations.groupBy("doc_id").agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / CITATIONS).cast("long")
    spread = counts.select(F.col("doc_id").alias("_d"), parts.alias("_parts"))
    texts = docs.select(F.col("doc_id").alias("_d"), "text").join(spread, "_d")
    # Each part has its own copy of the text, so that a much cited document isn't one task's.
    texts = texts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    own = citations.join(spread, citations.doc_id == spread._d).select("_d", F.pmod(F.xxhash64("item_id", "excerpt", "page_num"), F.col("_parts")).alias("_part"), cited.alias("cited"))
    groups = own.groupBy("_d", "_part").agg(F.collect_list("cited").alias("cited")).join(texts, ["_d", "_part"])
    if pages is None:
        return groups.withColumn("pages", F.array().cast("array<struct<page_num:long,page_start:long,page_end:long>>"))
    wide = F.struct(*(F.col(c).cast("long").alias(c) for c in ("page_num", "page_start", "page_end")))
    return groups.join(pages.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(wide).alias("pages")), "_d", "left")


def _over(answer, schema: str, least: Fraction, exact_first: bool, clean=lambda excerpt: excerpt):
    """Answers each citation; (item_id, excerpt, page_num) in, rows after doc_id out. Searches of some CHARACTERS of text
    are prepared together; with exact_first, only of excerpts that the text doesn't have exactly. clean: what is searched."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = list(to_arrow_schema(StructType.fromDDL(schema)))

    def rows_of(held: list) -> pa.RecordBatch | None:
        asked = []
        for _, document, cited in held:
            excerpts = [x for c in cited if (x := clean(c["excerpt"] or "")).strip()]
            asked += [(document, x) for x in document.wanted(excerpts, least) if not (exact_first and x in document.lower)]
        prepare(asked, least)
        rows = [(doc_id, *row) for doc_id, document, cited in held for c in cited for row in answer(document, *c.values())]
        if rows:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], [f.name for f in fields])
        return None

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, pages, cited = (batch.column(c)[i].as_py() for c in ("_d", "text", "pages", "cited"))
                if text is not None:
                    held.append((doc_id, Document(text, [tuple(p.values()) for p in pages or []]), cited))
                    size += (len(text) + 1) * len(cited)
                if size >= CHARACTERS:
                    if (out := rows_of(held)) is not None:
                        yield out
                    held, size = [], 0
        if held and (out := rows_of(held)) is not None:
            yield out

    return run


def near_places(docs: DataFrame, citations: DataFrame, least: float = LEAST) -> DataFrame:
    """All places of each excerpt (doc_id, item_id, excerpt) in its document that don't overlap, with a ratio of
    ``least`` or more; an excerpt under ten characters has none."""
    bound = Fraction(str(least))

    def answer(document, item_id, excerpt, _):
        found = document.near(excerpt, bound) if (excerpt or "").strip() else []
        return [(item_id, s, e, float(r)) for s, e, r in found]

    given = citations.select("doc_id", "item_id", "excerpt", F.lit(None).cast("long").alias("page_num"))
    return _grouped(docs, None, given).mapInArrow(_over(answer, PLACE, bound, False), PLACE)


def best_places(docs: DataFrame, citations: DataFrame, least: float = LEAST) -> DataFrame:
    """The best place of each excerpt: as written, else in another case (ratio 0.99), else nearly."""
    bound = Fraction(str(least))

    def answer(document, item_id, excerpt, _):
        found = document.best(excerpt, bound) if (excerpt or "").strip() else None
        return [(item_id, found[0], found[1], float(found[2]))] if found else []

    given = citations.select("doc_id", "item_id", "excerpt", F.lit(None).cast("long").alias("page_num"))
    return _grouped(docs, None, given).mapInArrow(_over(answer, PLACE, bound, True), PLACE)


def checked(docs: DataFrame, pages: DataFrame, citations: DataFrame, least: float = LEAST) -> DataFrame:
    """V4: the status of each citation (doc_id, item_id, excerpt, page_num), where it was found, and in how many places.
    pages: (doc_id, page_num, page_start, page_end) of the text. Found on the declared page: VALID_EXACT or VALID_FUZZY; else
    once in the document: the same, or PAGE_MISMATCH; more than once: INVALID_AMBIGUOUS; nowhere: INVALID."""
    bound = Fraction(str(least))

    def answer(document, item_id, excerpt, page):
        return [(item_id, page, *document.citation(excerpt, page, bound))]

    found = _grouped(docs, pages, citations).mapInArrow(_over(answer, CHECKED, bound, True, str.strip), CHECKED)
    absent = citations.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_anti")
    null = lambda kind: F.lit(None).cast(kind)
    lost = absent.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("string").alias("item_id"), F.col("page_num").cast("long").alias("page_declared"), F.lit("INVALID").alias("status"), null("long").alias("start"), null("long").alias("end"), null("long").alias("page_num"), F.lit(0.0).alias("ratio"), F.lit(0).cast("long").alias("n_places"))
    return found.unionByName(lost)


def auditor_scores(checks: DataFrame) -> DataFrame:
    """A24 over V4: of each auditor's citations, how many are valid, mismatched, ambiguous and invalid, and the share of
    valid ones; a citation found on another page counts as valid."""
    n = lambda *statuses: F.count_if(F.col("status").isin(*statuses))
    valid = n("VALID_EXACT", "VALID_FUZZY", "PAGE_MISMATCH")
    return checks.groupBy("auditor_id").agg(F.count("*").alias("total"), valid.alias("valid"), n("PAGE_MISMATCH").alias("mismatched"), n("INVALID_AMBIGUOUS").alias("ambiguous"), n("INVALID").alias("invalid"), (valid / F.count("*")).alias("score"))
