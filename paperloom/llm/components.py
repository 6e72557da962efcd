"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from paperloom.llm.shared import dropped, written


def _star(links: DataFrame, least: DataFrame, larger: bool) -> DataFrame:
    joined = links.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _counted(pairs: DataFrame) -> tuple[DataFrame, dict]:
    """pairs, written, and what tells one set of pairs from another."""
    seen = Observation()
    out = written(pairs.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "stars")
    return out, seen.get


def components(links: DataFrame) -> DataFrame:
    """(v, root): for each end of a link (a, b), the least end that can be reached. Each step links every vertex to the
    least of its neighbours, so hubs are reduced by partial aggregates and chains halve; it ends when nothing changes."""
    pairs, state = _counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while state != before and state["n"]:
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _star(both, least, True).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select("u", F.col("m").alias("v"))
        small = _star(large, least, False).where("u > v").unionByName(own).distinct()
        last = pairs
        pairs, state = _counted(small)
        dropped(last)
    return pairs.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v"), F.col("v").alias("root")).distinct())
