"""Quality classifier: a sparse ensemble of rules (operator 5).

Texts are described by statistics, as Spark columns. On at most ``sample`` labelled rows, the ones with the least hash,
small decision trees are grown in numpy on bootstrap samples; every path from a root to a node is a conjunctive rule. A
logistic model with an L1 penalty (proximal gradient descent) weighs the rules and drops most; those that stay become
one Spark column expression, so scoring runs in the scan without Python.

Defined results: null and empty texts have all statistics 0 and get the score of that point; repeated rows are scored
each; labels without quality or doc_id, or without a document, are not learned from; with no or one kind of label the
score is the share of label 1, 0.5 without any.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import apart, restored

SAMPLE = 8000  # labelled rows at most that the model learns from
TREES, DEPTH, BINS, LEAST = 24, 3, 32, 10
PENALTY = 2e-3
AT_LEAST = 0.3  # score from which a document is taken for good


def statistics() -> dict[str, Column]:
    """Statistics of ``text``, by name; shares are of characters unless they say words."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n_words = F.size(words)
    some = F.greatest(n_words, F.lit(1))
    count = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n
    one = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) / n
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "mean_word": F.length(t) / some,
        "distinct_words": F.size(F.array_distinct(words)) / some,
        "upper": count(r"\p{Lu}+"),
        "digits": count(r"[0-9]+"),
        "marks": count(r"[^\p{L}\p{N}\s]+"),
        "symbols": count(r"[^\p{L}\p{N}\s.,;:!?'\"()|-]+"),
        "bangs": one("!"),
        "bars": one("|"),
        "lines": one("\n"),
        "stops": one("."),
    }


Rule = tuple[tuple[int, bool, float], ...]  # conditions (statistic, whether above, bound)


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, depth: int, path: Rule, rng, out: set) -> None:
    if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
        return
    best = (1e-9, None)
    total, ones = len(y), y.sum()
    gini = lambda n, k: np.where(n > 0, 2 * k * (n - k) / np.maximum(n, 1), 0.0)
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
        if not len(cuts[f]):
            continue
        n = np.bincount(bins[:, f], minlength=len(cuts[f]) + 1).cumsum()[:-1]
        k = np.bincount(bins[:, f], weights=y, minlength=len(cuts[f]) + 1).cumsum()[:-1]
        gain = gini(total, ones) - gini(n, k) - gini(total - n, ones - k)
        gain[(n < LEAST) | (total - n < LEAST)] = -1
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), (int(f), at))
    if best[1] is None:
        return
    f, at = best[1]
    above = bins[:, f] > at
    for side, rows in ((False, ~above), (True, above)):
        rule = (*path, (f, side, float(cuts[f][at])))
        out.add(tuple(sorted(rule)))
        _grow(x[rows], bins[rows], cuts, y[rows], depth - 1, rule, rng, out)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """Paths of TREES small trees."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    out: set = set()
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        _grow(x[rows], bins[rows], cuts, y[rows], DEPTH, (), rng, out)
    return sorted(out)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Which rule holds for which row."""
    return np.stack([np.all([(x[:, f] > b) == above for f, above, b in rule], axis=0) for rule in rules], axis=1).astype(float)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model, by accelerated proximal gradient descent."""
    n, k = r.shape
    rate = 4 * n / max(np.linalg.norm(np.column_stack([r, np.ones(n)]), 2) ** 2, 1e-9)
    w, b = np.zeros(k), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        wrong = 1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y
        step = v - rate * (r.T @ wrong) / n
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = c - rate * wrong.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, float(b)


class RuleModel:
    """Rules with weights, and a bias."""

    def __init__(self, rules: list[tuple[Rule, float]], bias: float):
        self.rules, self.bias = rules, bias

    def score(self, stats: list[Column]) -> Column:
        """The chance of label 1 as an expression over the columns of the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds_all = None
            for f, above, bound in rule:
                one = stats[f] > bound if above else stats[f] <= bound
                holds_all = one if holds_all is None else holds_all & one
            total = total + F.when(holds_all, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """A model of labels (doc_id, quality) over docs (doc_id, text), from ``sample`` labels at most."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    picked = known.orderBy(F.xxhash64("_id", F.lit(5)), "_y").limit(sample)
    stats = statistics()
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # ``sample`` rows
    found = np.array([tuple(r) for r in rows.select("_y", *(c.alias(n) for n, c in stats.items())).limit(2 * sample).collect()], float)
    if not len(found):
        return RuleModel([], 0.0)
    found = found[np.lexsort(found.T)]
    y, x = found[:, 0], found[:, 1:]
    if y.min() == y.max():
        return RuleModel([], 30.0 if y[0] else -30.0)
    rules = extract_rules(x, y)
    if not rules:
        return RuleModel([], float(np.log(y.mean() / (1 - y.mean()))))
    weights, bias = lasso(holds(rules, x), y)
    return RuleModel([(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w], bias)


def _scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs, as from ``apart``, with ``score``."""
    stats = statistics()
    return apart(docs).withColumns(stats).withColumn("score", model.score([F.col(n) for n in stats]))


def scored(docs: DataFrame, model: RuleModel, at_least: float = AT_LEAST) -> DataFrame:
    """docs with ``quality_score`` and ``quality_predicted``, which replace columns of these names; other columns stay as
    they are."""
    out = _scored(docs, model).withColumn("predicted", (F.col("score") >= at_least).cast("int"))
    own = restored(docs, "quality_score", "quality_predicted")
    return out.select(*own, F.col("score").alias("quality_score"), F.col("predicted").alias("quality_predicted"))


def _remainder(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def _learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> RuleModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return fit(docs, labels.where(_remainder() != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's score; a fifth of them, by crc32 of doc_id, is never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, _learned(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the classifier rejects go."""
    return _scored(docs, _learned(spark, docs, sf_dir)).where(F.col("score") >= AT_LEAST).select(*restored(docs))
