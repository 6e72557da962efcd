"""Law references."""

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from paperloom.functions import laws as patterns
from paperloom.functions.text import grams_of

CITED = "excerpt string, law string, article string, number string, clause string, normalised string"
TEXTS = 256  # whose citations are held together


def sequence_ratio(a: Column, b: Column) -> Column:
    """The share of characters in matching blocks, as difflib counts it."""

    @pandas_udf("double")
    def ratio(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(xs, ys, strict=True)])

    return ratio(a, b)


def _comparable(names: DataFrame, aliases: DataFrame, least: float) -> DataFrame:
    """All pairs of (name, n) and (alias, a) whose n and a may have a ratio of ``least``. Without a common bigram, m equal
    characters leave m - 1 others between them at least, so the ratio is at most 2 m / (3 m - 1); at 0.8 m is 2 and both
    texts together have five characters. Texts that short meet on single characters, longer ones on bigrams. The ratio
    also bounds the longer length by the shorter one."""
    if least <= 0:
        return names.crossJoin(aliases)
    if 3 * least <= 2 + 1e-9:
        grams = lambda c: grams_of(F.col(c), 1)
    else:
        short = int(2 * int(least / (3 * least - 2) + 1e-9) / least + 1e-9)
        one = lambda c: F.when(F.length(c) <= short, grams_of(F.col(c), 1)).otherwise(F.array().cast("array<string>"))
        grams = lambda c: F.concat(one(c), grams_of(F.col(c), 2))
    n = names.select("name", "n", F.explode(grams("n")).alias("gram"))
    a = aliases.select("alias", "a", F.explode(grams("a")).alias("gram"))
    fits = 2 * F.least(F.length("n"), F.length("a")) >= least * (F.length("n") + F.length("a")) - 1e-9
    return n.join(a, "gram").where(fits).select("name", "n", "alias", "a").distinct()


def resolve_names(names: DataFrame, laws: DataFrame, least: float = 0.8) -> DataFrame:
    """Laws (alias, law) by exact name, by name without case, else by the most similar alias of at least ``least``.
    Only names that are left after the equal ones are compared, with all aliases that can be so similar."""
    low = lambda c: F.lower(F.trim(c))
    n, a = names.select("name").distinct(), laws.select("alias", "law")
    exact = n.join(a, low(F.col("name")) == low(F.col("alias"))).groupBy("name").agg(F.min_by("law", "alias").alias("law"), F.lit(1.0).alias("similarity"))
    left = n.join(exact, "name", "left_anti")
    close = _comparable(left.withColumn("n", low(F.col("name"))), a.select("alias").distinct().withColumn("a", low(F.col("alias"))), least)
    close = close.withColumn("similarity", sequence_ratio(F.col("n"), F.col("a"))).where(F.col("similarity") >= least).join(a, "alias")
    best = close.groupBy("name").agg(F.min_by(F.struct("law", "similarity"), F.struct(-F.col("similarity"), "alias")).alias("b")).select("name", "b.law", "b.similarity")
    return n.join(exact.unionByName(best), "name", "left")


def dual_lookup(checks: DataFrame, articles: DataFrame) -> DataFrame:
    """Whether the article of (nid, version_then, version_now, article) exists in both versions, and has changed
    its state between them."""
    have = articles.select("nid", "version", "article").distinct()
    then = have.withColumnRenamed("version", "version_then").withColumn("t", F.lit(True))
    now = have.withColumnRenamed("version", "version_now").withColumn("w", F.lit(True))
    out = checks.join(then, ["nid", "version_then", "article"], "left").join(now, ["nid", "version_now", "article"], "left")
    a, b = F.coalesce("t", F.lit(False)), F.coalesce("w", F.lit(False))
    return out.select(*checks.columns, a.alias("valid_then"), b.alias("valid_now"), (a != b).alias("changed"))


def citations(docs: DataFrame) -> DataFrame:
    """The law citations of each text (doc_id, text), numbered in the order in which they are found, with their parts.
    A null text has none; rows that repeat are read each."""

    names = ["citation", *(x.split()[0] for x in CITED.split(", "))]
    kinds = [pa.int32()] + [pa.string()] * (len(names) - 1)

    def found(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                rows = [(i, n, *c) for i, t in enumerate(some.column("text")) for n, c in enumerate(patterns.extracted(t.as_py() or ""))]
                if rows:
                    which, *columns = zip(*rows, strict=True)
                    ids = some.column("doc_id").take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, citation int, {CITED}")


def normalised_citations(excerpts: DataFrame) -> DataFrame:
    """Law, article, number, clause and normalised form of each excerpt; nulls where it names no article."""

    @pandas_udf(CITED.replace("excerpt string, ", ""))
    def parts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(patterns.normalised(t) if t else None) or (None,) * 5 for t in texts], columns=["law", "article", "number", "clause", "normalised"])

    return excerpts.select("*", parts("excerpt").alias("_c")).select(*excerpts.columns, "_c.*")
