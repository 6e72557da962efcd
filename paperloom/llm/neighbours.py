"""Approximate nearest neighbours by learned partitions (operator 2).

On a sample of at most SAMPLE vectors, the nearest-neighbour graph is cut into balanced parts, and a small network is
trained to tell in which parts a vector's neighbours lie. Every row goes to its most probable part, every query to its
most probable parts, as many as reach TARGET recall on the sample; there, inner products with the original vectors are
computed in double precision and the best are kept.

Rows of all parts are dealt to SLICES by hash, so a part that holds a third of all rows is spread over tasks. A query goes to each
slice once, with the list of its parts, and keeps the k best of the slice while rows of these parts pass in blocks: what is
dealt and found follows the number of queries, however many parts they probe. The number of parts follows the number of
rows, up to MOST_PARTS.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components, and
rows without vec_id, take no part; a query is not its own neighbour, nor are rows of its vec_id; ties go to the smaller
vec_id. Rows that repeat both vec_id and vector count once; if a vec_id has several vectors, each of them is a candidate
and a query, and the vec_id is listed once with its best score. A query probes further parts, in the order of the
network, until these hold more than POOL * k vec_ids or no part is left.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import written

SAMPLE = 4096
TARGET = 0.93
MOST_PARTS = 256
ROWS, QUERIES, PAIRS = 4096, 1024, 1 << 15  # that are multiplied at once
SLICES, TOGETHER = 16, 16384  # of the rows, by hash; queries that pass over a slice together
POOL = 8  # times k vec_ids are in the probed parts at least
GRAPH = 12  # neighbours of a vertex


def vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    valid = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & valid)


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, seed: int = 2, passes: int = 12) -> np.ndarray:
    """Part of each vertex: halves along principal directions, then moves to the part of most neighbours while parts
    stay within a tenth of their share."""
    parts = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(rows) < 2:
            parts[rows] = first
            return
        centred = x[rows] - x[rows].mean(0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
        order = rows[np.argsort(along, kind="stable")]
        at = len(rows) * (n // 2) // n
        split(order[:at], first, n // 2)
        split(order[at:], first + n // 2, n - n // 2)

    split(np.arange(len(x)), 0, n_parts)
    rng = np.random.default_rng(seed)
    near = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row:
            near[i].append(j)
            near[j].append(i)
    near = [np.array(a, np.int64) for a in near]
    size = np.bincount(parts, minlength=n_parts)
    most, least = int(len(x) / n_parts * 1.1) + 1, int(len(x) / n_parts * 0.9)
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(parts[near[i]], minlength=n_parts)
            votes[(size >= most) & (np.arange(n_parts) != parts[i])] = -1
            to = int(votes.argmax())
            if votes[to] > votes[parts[i]] and size[parts[i]] > least:
                size[parts[i]] -= 1
                size[to] += 1
                parts[i] = to
                moved += 1
        if not moved:
            break
    return parts


class Router:
    """A network of one hidden layer from a vector to the parts, and how many parts a query probes."""

    def __init__(self, weights: list[np.ndarray], scale: float, probes: int):
        self.weights, self.scale, self.probes = weights, scale, probes

    @property
    def dim(self) -> int:
        return len(self.weights[0])

    @property
    def n_parts(self) -> int:
        return len(self.weights[3])

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x / self.scale @ a + b, 0) @ c + d


def _train(x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 40, batch: int = 256, seed: int = 3) -> tuple[list[np.ndarray], float]:
    """Adam on the cross entropy with the shares of neighbours in each part."""
    rng = np.random.default_rng(seed)
    scale = float(np.sqrt((x**2).mean())) or 1.0
    x = x / scale
    shape = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
    w = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shape]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            back = (p / p.sum(1, keepdims=True) - target[i]) / len(i)
            hidden_back = back @ w[2].T * (h > 0)
            step += 1
            for k, g in enumerate((x[i].T @ hidden_back, hidden_back.sum(0), h.T @ back, back.sum(0))):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] = w[k] - 2e-3 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w, scale


def fit(x: np.ndarray, n_parts: int, k: int = 20, target_recall: float = TARGET) -> Router:
    """A router from sample vectors (rows of x)."""
    n_parts = max(1, min(n_parts, len(x) // 16))
    k = min(k, len(x) - 1)
    graph = _graph(x, max(GRAPH, k))
    parts = balanced_parts(x, graph[:, :GRAPH], n_parts)
    shares = np.stack([np.bincount(parts[g[:GRAPH]], minlength=n_parts) for g in graph]) / max(1, min(GRAPH, graph.shape[1]))
    shares = 0.5 * shares + 0.5 * np.eye(n_parts)[parts]
    held = np.arange(len(x)) % 8 == 0  # the rows on which the number of probes is chosen
    weights, scale = _train(x[~held], shares[~held])
    logits = Router(weights, scale, n_parts).logits(x)
    own = logits.argmax(1)
    rank = np.argsort(np.argsort(-logits[held], axis=1), axis=1)  # rank of each part for each held vector
    depth = np.take_along_axis(rank, own[graph[held, :k]], axis=1)
    for probes in range(1, n_parts + 1):
        if k == 0 or (depth < probes).mean() >= target_recall:
            break
    return Router(weights, scale, probes)


def _graph(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k rows of largest inner product for each row of x, itself excluded."""
    out = []
    for at in range(0, len(x), block):
        sim = x[at : at + block] @ x.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -np.inf
        out.append(np.argsort(-sim, axis=1, kind="stable")[:, : min(k, len(x) - 1)])
    return np.concatenate(out)


def _dealer(shared, n_probes: int, held: list[int] | None = None, k: int = 0):
    """(parts, vec_id, v) with the n_probes most probable parts of each vector of the router's length, and the next ones
    until these hold more than POOL * k vec_ids; held: how many each part has."""

    def deal(batches):
        router = shared.value
        for batch in batches:
            lists = batch.column("v")
            right = np.flatnonzero(np.array(lists.value_lengths()) == router.dim)
            if not len(right):
                continue
            taken = lists.take(pa.array(right))
            x = taken.flatten().to_numpy(zero_copy_only=False).reshape(-1, router.dim)
            order = np.argsort(-router.logits(x), axis=1, kind="stable")
            n = np.full(len(x), min(n_probes, router.n_parts))
            if held is not None:
                n = np.minimum(np.maximum(n, (np.cumsum(np.array(held)[order], axis=1) < POOL * k + 1).sum(1) + 1), router.n_parts)
            top = order[np.arange(router.n_parts)[None, :] < n[:, None]].astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(top))
            data = [parts, batch.column("vec_id").take(pa.array(right)), pa.array([a.tobytes() for a in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, ["parts", "vec_id", "v"])

    return deal


class Nearest:
    """The k best vec_ids so far for each of the queries that are asked together; rows are offered ROWS at a time."""

    def __init__(self, k: int, n_parts: int):
        self.k, self.n_parts = k, n_parts
        self.asked: list = []
        self.offered: list = []
        self.waiting = 0
        self.q = None

    def ask(self, ids: np.ndarray, v: np.ndarray, parts: list) -> None:
        self.asked.append((ids, v, parts))

    def offer(self, ids: np.ndarray, v: np.ndarray, parts: np.ndarray) -> None:
        for at in range(0, len(ids), ROWS):
            self.offered.append((ids[at : at + ROWS], v[at : at + ROWS], parts[at : at + ROWS]))
            self.waiting += len(self.offered[-1][0])
            if self.waiting >= ROWS:
                self._compare()

    def _compare(self) -> None:
        if not self.offered or not self.asked:
            return
        if self.q is None:
            self.q_ids, self.q = (np.concatenate([x[i] for x in self.asked]) for i in (0, 1))
            self.probed = np.zeros((len(self.q_ids), self.n_parts), bool)
            for i, parts in enumerate(p for x in self.asked for p in x[2]):
                self.probed[i, parts] = True
            self.ids = np.zeros((len(self.q_ids), self.k), np.int64)
            self.scores = np.full((len(self.q_ids), self.k), -np.inf)  # best first
        ids, rows, parts = (np.concatenate([x[i] for x in self.offered]) for i in (0, 1, 2))
        self.offered, self.waiting = [], 0
        order = np.argsort(ids, kind="stable")
        ids, rows, parts = ids[order], rows[order], parts[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        wanted = np.flatnonzero(self.probed[:, np.unique(parts)].any(1))
        for at in range(0, len(wanted), QUERIES):
            self._meet(wanted[at : at + QUERIES], ids, rows, parts, first)

    def _meet(self, some: np.ndarray, ids: np.ndarray, rows: np.ndarray, parts: np.ndarray, first: np.ndarray) -> None:
        sim = self.q[some] @ rows.T
        sim[(self.q_ids[some, None] == ids[None, :]) | ~self.probed[some][:, parts]] = -np.inf
        most = np.maximum.reduceat(sim, first, axis=1)  # a vec_id's best vector
        floor = self.scores[some, -1]
        if most.shape[1] >= self.k:
            floor = np.maximum(floor, -np.partition(-most, self.k - 1, axis=1)[:, self.k - 1])
        floor = np.where(np.isfinite(floor), floor - 1e-9 * np.abs(floor), floor)
        who, which = np.nonzero((sim >= floor[:, None]) & (sim > -np.inf))
        if not len(who):
            return
        exact = np.concatenate([(rows[which[at : at + PAIRS]] * self.q[some[who[at : at + PAIRS]]]).sum(1) for at in range(0, len(who), PAIRS)])  # each row is summed alike, so equal vectors tie
        # With what was found before: each vec_id once, with its best score, and of these the k best.
        touched = np.unique(who)
        before, scores = self.ids[some[touched]], self.scores[some[touched]]
        kept = scores > -np.inf
        who = np.r_[who, np.repeat(touched, kept.sum(1))]
        found, score = np.r_[ids[which], before[kept]], np.r_[exact, scores[kept]]
        order = np.lexsort((-score, found, who))
        who, found, score = who[order], found[order], score[order]
        once = np.r_[True, (who[1:] != who[:-1]) | (found[1:] != found[:-1])]
        who, found, score = who[once], found[once], score[once]
        order = np.lexsort((found, -score, who))
        who, found, score = who[order], found[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        who, found, score, rank = (x[rank < self.k] for x in (who, found, score, rank))
        self.ids[some[who], rank], self.scores[some[who], rank] = found, score

    def found(self) -> pa.RecordBatch | None:
        self._compare()
        if self.q is None:
            return None
        at = self.scores > -np.inf
        data = [np.repeat(self.q_ids, self.k)[at.ravel()], self.ids[at], self.scores[at]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in data], ["query_id", "vec_id", "score"])


def _searcher(k: int, n_parts: int):
    """Searches each (slice, qb), by which rows are sorted, with the queries (part -1) before the rows."""

    def search(batches):
        nearest, group = None, None
        for batch in batches:
            s, b, part, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slice", "qb", "part", "vec_id"))
            starts = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (b[1:] != b[:-1]) | ((part[1:] < 0) != (part[:-1] < 0))]) if len(s) else []
            for i, j in zip(starts, [*starts[1:], len(s)], strict=True):
                if group != (s[i], b[i]):
                    if nearest and (out := nearest.found()):
                        yield out
                    nearest, group = Nearest(k, n_parts), (s[i], b[i])
                v = np.frombuffer(b"".join(batch.column("v").slice(i, j - i).to_pylist())).reshape(j - i, -1)
                if part[i] < 0:
                    nearest.ask(ids[i:j], v, batch.column("parts").slice(i, j - i).to_pylist())
                else:
                    nearest.offer(ids[i:j], v, part[i:j])
        if nearest and (out := nearest.found()):
            yield out

    return search


def search(base: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, target_recall: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score of the k best found for each query; base and queries: (vec_id, v) as from
    ``vectors``."""
    spark = base.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    n = base.count()
    picked = base.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(sample).collect()  # ``sample`` rows
    lengths = [len(r.v) for r in picked]
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = max(set(lengths), key=lambda d: (lengths.count(d), -d))
    x = np.array([r.v for r in picked if len(r.v) == dim])
    router = fit(x, min(MOST_PARTS, max(8, n // 1024)), k, target_recall)
    shared = spark.sparkContext.broadcast(router)
    dealt = "parts array<int>, vec_id long, v binary"
    rows = written(base.mapInArrow(_dealer(shared, 1), dealt).select(F.get("parts", F.lit(0)).alias("part"), "vec_id", "v"), "vectors")
    held = [0] * router.n_parts
    for r in rows.groupBy("part").agg(F.count_distinct("vec_id").alias("n")).collect():  # a row a part
        held[r.part] = r.n
    probes = written(queries.mapInArrow(_dealer(shared, router.probes, held, k), dealt), "probes")
    blocks = -(-probes.count() // TOGETHER)
    slices, each = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (SLICES, max(1, blocks)))
    mine = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    r = rows.select(mine(SLICES, 4).alias("slice"), each.alias("qb"), "part", "vec_id", "v", F.lit(None).cast("array<int>").alias("parts"))
    q = probes.select(slices.alias("slice"), mine(max(1, blocks), 5).alias("qb"), F.lit(-1).alias("part"), "vec_id", "v", "parts")
    both = r.unionByName(q).repartition("slice", "qb").sortWithinPartitions("slice", "qb", "part")
    found = both.mapInArrow(_searcher(k, router.n_parts), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the 20 best of all rows for every vec_id divisible by 20."""
    base = vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(base, base.where("vec_id % 20 = 0"))
