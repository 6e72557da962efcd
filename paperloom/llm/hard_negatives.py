"""Hard negatives by a vantage-point tree (operator 13).

Vectors become integers, floor(SCALE * x), so scores are exact. Each row gets one more component, so that all rows have the
norm M of the longest; an anchor gets a zero there. Then distance**2 = |anchor|**2 + M**2 - 2 * score: higher scores are
nearer, and a window of scores is an annulus around the anchor.

The tree has two storeys. Its top is made of at most SAMPLE rows and deals all rows to leaves; a leaf's rows are split by hash
into blocks of about ROWS, so a leaf that holds a third of all rows is many tasks. Each block is a file: its own tree down
to buckets of BUCKET rows, with the least and the greatest distance of each bucket from each vantage point.

A search has windows of scores for each anchor. The sample, being rows of the table, already gives k rows, or fewer, of each
window, which shrink its annulus; then the anchor goes to the leaves that the rest of the annulus may touch. In a block, buckets
are opened nearest first, and the annulus shrinks to the k-th row so far, until no bucket begins inside it. Positives are such a
search among rows of the same label, negatives one among the others in the windows that the positives give.

Only triangle inequalities leave rows out, so results are exact. In high dimensions they leave out little: the work then is
anchors x rows, in blocks.

Defined results: rows without vec_id or label, and vectors that are null, of another length than most, or hold null or
non-finite components, take no part; nor do vectors with a component so large that a score may not fit in a long (2**28
after scaling, for 64 components). Rows that repeat a vec_id count once, with the least label and vector. Ties go to the smaller
vec_id. Anchors without other rows of their label, or whose positives all have negative scores, have no rows; a positive score
of 0 allows the score 0. Other columns are not read; an empty table gives no rows.
"""

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import new_folder, written

SCALE = 256
SAMPLE = 4096  # rows of which the top of the tree is made
ROWS = 2048  # of a block
TOGETHER = 128  # anchors that search a block at once
ANCHORS = 512  # that one task reads a block for
BUCKET = 64
MOST_LEAVES = 256
ANY = 2**62  # beyond any score
REQUEST = "anchor_id long, label long, v array<int>, keys array<long>, low array<long>, high array<long>"
FOUND = "anchor_id long, key long, vec_id long, score long"


def limit(dim: int) -> int:
    """Components stay under this, so that a score fits in a long."""
    return 1 << int((62 - np.log2(max(dim, 1))) // 2)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer rows a with integer rows b, by floats where these are exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), np.int64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.int64)


class Space:
    """Distances between rows of one norm, and from anchors to them; ``slack`` covers their rounding."""

    def __init__(self, longest: int):
        self.square = float(longest)
        self.slack = 1e-6 * (1 + np.sqrt(self.square))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Rows with their last component."""
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))])

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x.astype(np.float64), np.zeros(len(x))])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0))

    def radius(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far from the anchors rows of these scores are."""
        q = anchors.astype(np.float64)
        return np.sqrt(np.maximum((q * q).sum(1) + self.square - 2 * np.asarray(scores, np.float64), 0))


def split(points: np.ndarray, n_leaves: int) -> tuple[list[tuple[int, float]], np.ndarray]:
    """A balanced tree over points: inner nodes, in heap order, as (vantage point, its median distance), and each point's
    leaf. n_leaves is a power of two."""
    nodes, leaf = [], np.zeros(len(points), np.int64)
    n = 1
    while n < n_leaves:
        for node in range(n):
            mine = np.flatnonzero(leaf == node)
            if not len(mine):
                nodes.append((0, 0.0))
                continue
            # A vantage point at the rim of its rows parts them best.
            far = np.argmax(((points[mine] - points[mine].mean(0)) ** 2).sum(1))
            d = Space.distances(points[mine], points[mine[far]][None])[:, 0]
            nodes.append((int(mine[far]), float(np.median(d))))
        inside = np.zeros(len(points), bool)
        for node in range(n):
            vantage, middle = nodes[n - 1 + node]
            mine = leaf == node
            inside[mine] = Space.distances(points[mine], points[vantage][None])[:, 0] <= middle
        leaf = 2 * leaf + ~inside
        n *= 2
    return nodes, leaf


class Top:
    """The top of the tree, with the sample it is made of."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, longest: int, n_leaves: int):
        self.ids, self.labels, self.x, self.space, self.n_leaves = ids, labels, x, Space(longest), n_leaves
        points = self.space.of_rows(x)
        nodes, _ = split(points, n_leaves)
        self.vantages = points[[v for v, _ in nodes]] if nodes else points[:0]
        self.middles = np.array([m for _, m in nodes])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        d = Space.distances(self.space.of_rows(x), self.vantages)
        at = np.zeros(len(x), np.int64)
        while len(at) and at[0] < len(self.middles):  # all rows go down one step at a time
            at = 2 * at + 1 + (d[np.arange(len(at)), at] > self.middles[at])
        return at - len(self.middles)

    def reach(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest distance that rows of each leaf may have from each anchor."""
        d = Space.distances(self.space.of_anchors(anchors), self.vantages)
        low, high = np.zeros((len(anchors), 1)), np.full((len(anchors), 1), np.inf)
        first = 0
        while low.shape[1] < self.n_leaves:
            n = low.shape[1]
            here, middle = d[:, first : first + n], self.middles[first : first + n]
            sides = np.stack([np.maximum(low, here - middle), np.maximum(low, middle - here)], 2), np.stack([np.minimum(high, here + middle), high], 2)
            low, high = (s.reshape(len(anchors), 2 * n) for s in sides)
            first += n
        return low, high


def _router(top, k: int, same: bool):
    """Shrinks each window to what the sample leaves open, and sends the anchor to the leaves it may reach."""

    def route(frames):
        t = top.value
        for frame in frames:
            out = []
            anchors = matrix(frame["v"])
            low, high = t.reach(anchors) if len(frame) else (None, None)
            scores = inner(anchors, t.x) if len(frame) else None
            for i, r in enumerate(frame.itertuples(index=False)):
                mine = scores[i][((t.labels == r.label) == same) & (t.ids != r.anchor_id)]
                least, most = np.array(r.low, np.int64), np.array(r.high, np.int64)
                for w in range(len(least)):
                    inside = mine[(mine >= least[w]) & (mine <= most[w])]
                    if len(inside) >= k:
                        least[w] = np.partition(inside, -k)[-k]
                same_anchor = np.repeat(anchors[i : i + 1], len(least), 0)
                outer, nearest = t.space.radius(same_anchor, least), t.space.radius(same_anchor, most)
                touched = (low[i] <= outer[:, None] + t.space.slack) & (high[i] >= nearest[:, None] - t.space.slack)
                keys = np.array(r.keys, np.int64)
                for leaf in np.flatnonzero(touched.any(0)).tolist():
                    w = touched[:, leaf]
                    out.append((leaf, r.anchor_id, r.label, r.v, keys[w], least[w], most[w]))
            yield pd.DataFrame(out, columns=["leaf", "anchor_id", "label", "v", "keys", "low", "high"])

    return route


class Block:
    """Rows of one leaf and their tree: bucket b has the rows ``first[b]`` to ``first[b + 1]``, whose distances from
    vantage point p lie between ``near[b, p]`` and ``far[b, p]``."""

    def __init__(self, longest: int, **arrays: np.ndarray):
        self.longest, self.space, self.arrays = int(longest), Space(int(longest)), arrays
        self.ids, self.labels, self.x, self.first, self.vantages, self.near, self.far = (arrays[c] for c in ("ids", "labels", "x", "first", "vantages", "near", "far"))

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, longest: int) -> "Block":
        points = Space(longest).of_rows(x)
        n_buckets = 1
        while n_buckets * BUCKET < len(x):
            n_buckets *= 2
        nodes, bucket = split(points, n_buckets)
        order = np.argsort(bucket, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))])
        first = np.unique(first)  # without empty buckets
        vantages = points[[v for v, _ in nodes]] if nodes else points[:1]
        d = Space.distances(points[order], vantages)
        near, far = np.minimum.reduceat(d, first[:-1]), np.maximum.reduceat(d, first[:-1])
        return Block(longest, ids=ids[order], labels=labels[order], x=x[order], first=first, vantages=vantages, near=near, far=far)

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, longest=np.array(self.longest), **self.arrays)
        return out.getvalue()

    @staticmethod
    def loaded(raw: bytes) -> "Block":
        return Block(**dict(np.load(io.BytesIO(raw))))

    def reach(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest distance that rows of each bucket may have from each anchor."""
        d = Space.distances(self.space.of_anchors(anchors), self.vantages)
        near, far = np.zeros((len(anchors), len(self.near))), np.full((len(anchors), len(self.near)), np.inf)
        for p in range(len(self.vantages)):
            here = d[:, p : p + 1]
            np.maximum(near, np.maximum(here - self.far[:, p], self.near[:, p] - here), out=near)
            np.minimum(far, here + self.far[:, p], out=far)
        return near, far

    def search(self, anchor_ids, labels, anchors: np.ndarray, owner, low, high, k: int, same: bool):
        """For each window (the anchor that owns it, its lowest and highest score) its k highest rows in this block, as
        (window, vec_id, score). All windows are taken on together, each opening its own next buckets."""
        slack, n_rows, none = self.space.slack, len(self.ids), -(2**63)
        near, far = self.reach(anchors)
        inner_radius, outer = self.space.radius(anchors[owner], high), self.space.radius(anchors[owner], low)
        nearest = np.where(far[owner] >= inner_radius[:, None] - slack, near[owner], np.inf)
        path = np.argsort(nearest, axis=1, kind="stable")
        nearest = np.take_along_axis(nearest, path, 1)
        fits = ((self.labels == labels[:, None]) == same) & (self.ids != anchor_ids[:, None])
        scores = np.zeros((len(anchors), n_rows), np.int64)
        known = np.zeros(near.shape, bool)
        found = np.full((len(owner), n_rows), none)  # scores of the rows that a window has opened and that fit
        at, step = 0, 2
        while at < path.shape[1]:
            opens = nearest[:, at : at + step] <= outer[:, None] + slack
            active = np.flatnonzero(opens.any(1))
            if not len(active):
                break
            window, place = np.nonzero(opens)
            bucket = path[window, at + place]
            need = np.zeros(known.shape, bool)
            need[owner[window], bucket] = True
            need &= ~known
            known |= need
            for b in np.flatnonzero(need.any(0)).tolist():
                a, rows = np.flatnonzero(need[:, b]), slice(self.first[b], self.first[b + 1])
                scores[a, rows] = inner(anchors[a], self.x[rows])
            for b in np.unique(bucket).tolist():
                w, rows = window[bucket == b], slice(self.first[b], self.first[b + 1])
                s = scores[owner[w], rows]
                found[w, rows] = np.where(fits[owner[w], rows] & (s >= low[w, None]) & (s <= high[w, None]), s, none)
            if n_rows >= k:
                least = np.partition(found[active], n_rows - k, axis=1)[:, n_rows - k]
                full = active[least > none]
                outer[full] = self.space.radius(anchors[owner[full]], least[least > none])
            at, step = at + step, 2 * step
        if n_rows > k:  # rows behind the k-th score; those that tie with it stay
            found[found < np.partition(found, n_rows - k, axis=1)[:, n_rows - k, None]] = none
        window, row = np.nonzero(found > none)
        order = np.lexsort((self.ids[row], -found[window, row], window))
        window, row = window[order], row[order]
        first = np.searchsorted(window, np.arange(len(owner)))
        kept = np.arange(len(window)) - first[window] < k
        return window[kept], self.ids[row[kept]], found[window[kept], row[kept]]


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _runs(frames, column: str):
    """The rows of each value of a column by which frames are sorted."""
    held: list = []
    for frame in frames:
        for value, part in frame.groupby(column, sort=False):
            if held and held[0][column].iloc[0] != value:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _block_writer(folder: str, longest: int):
    def write(frames):
        system, top = _folder(folder)
        system.create_dir(top, recursive=True)
        for rows in _runs(frames, "block"):
            block = Block.of(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), matrix(rows["v"]), longest)
            name = f"{uuid.uuid4().hex}.npz"  # of this attempt; it counts once its row is in the written table
            with system.open_output_stream(f"{top}/{name}") as f:
                f.write(block.saved())
            yield pd.DataFrame({"leaf": [int(rows["leaf"].iloc[0])], "file": [name], "n": [len(rows)]})

    return write


def _searcher(folder: str, k: int, same: bool):
    def search(frames):
        system, top = _folder(folder)
        name, block = None, None
        for frame in frames:
            for file, visits in frame.groupby("file", sort=False):
                if file != name:
                    with system.open_input_file(f"{top}/{file}") as f:
                        name, block = file, Block.loaded(f.read())
                for at in range(0, len(visits), TOGETHER):
                    some = visits.iloc[at : at + TOGETHER]
                    owner = np.repeat(np.arange(len(some)), some["keys"].map(len))
                    keys, low, high = (np.concatenate(some[c].tolist()).astype(np.int64) for c in ("keys", "low", "high"))
                    ids, labels = some["anchor_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64)
                    window, found, scores = block.search(ids, labels, matrix(some["v"]), owner, low, high, k, same)
                    yield pd.DataFrame({"anchor_id": ids[owner[window]], "key": keys[window], "vec_id": found, "score": scores})

    return search


def integers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, v array<int>) of the rows that take part, one for each vec_id."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).where("vec_id is not null and label is not null and v is not null").where(finite)
    common = whole.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = common[0].dim if common else 0
    fits = F.forall("v", lambda x: F.abs(x * SCALE) < limit(dim) - 1)
    scaled = F.transform("v", lambda x: F.floor(x * SCALE).cast("int"))
    rows = whole.where(F.size("v") == dim).where(fits).select("vec_id", "label", scaled.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


class Index:
    """The tree over all rows: its top, broadcast, and the table of its blocks' files."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, rows_a_block: int = ROWS):
        """rows: (vec_id, label, v) of integers, one for each vec_id."""
        spark = rows.sparkSession
        square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        self.n, longest = rows.agg(F.count("*"), F.max(square)).first()
        if not self.n:
            return
        chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        n_leaves = 1
        while n_leaves * rows_a_block < self.n and 2 * n_leaves <= min(MOST_LEAVES, len(chosen) // 16):
            n_leaves *= 2
        top = Top(np.array([r.vec_id for r in chosen]), np.array([r.label for r in chosen]), matrix([r.v for r in chosen]), longest, n_leaves)
        self.top, self.folder = spark.sparkContext.broadcast(top), new_folder(spark, "vantage-blocks")
        given = self.top

        def route(frames):
            for frame in frames:
                yield frame.assign(leaf=given.value.leaves(matrix(frame["v"])) if len(frame) else np.zeros(0, np.int64))

        dealt = written(rows.mapInPandas(route, "vec_id long, label long, v array<int>, leaf long"), "vantage-leaves")
        held = dealt.groupBy("leaf").count().collect()  # MOST_LEAVES rows at most
        parts = F.create_map(*(F.lit(y).cast("long") for r in held for y in (r.leaf, -(-r["count"] // rows_a_block))))
        salt = F.pmod(F.xxhash64("vec_id"), parts[F.col("leaf")])
        dealt = dealt.withColumn("block", F.concat_ws("-", "leaf", salt)).repartition("block").sortWithinPartitions("block")
        self.blocks = written(dealt.mapInPandas(_block_writer(self.folder, longest), "leaf long, file string, n long"), "vantage-blocks")
        # Searches are long for their few bytes, so their tasks are counted by blocks.
        self.n_tasks = max(spark.sparkContext.defaultParallelism, self.blocks.count())

    def search(self, requests: DataFrame, n_anchors: int, k: int, same: bool) -> DataFrame:
        """For each of the n_anchors anchors and its windows (a key, with its lowest and highest score) the first k rows of
        the same label, or of others, as (anchor_id, key, vec_id, score, rank)."""
        visits = requests.repartition(self.n_tasks, "anchor_id").mapInPandas(_router(self.top, k, same), f"leaf long, {REQUEST}")
        visits = visits.join(self.blocks.select("leaf", "file"), "leaf").repartition(self.n_tasks, "file", F.pmod(F.xxhash64("anchor_id"), F.lit(-(-n_anchors // ANCHORS)))).sortWithinPartitions("file")
        found = visits.select("file", "anchor_id", "label", "v", "keys", "low", "high").mapInPandas(_searcher(self.folder, k, same), FOUND)
        order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, k: int = 10, window: tuple[int, int] = (3, 9), sample: int = SAMPLE, rows_a_block: int = ROWS) -> DataFrame:
    """For each anchor (vec_id) and each of its nearest positives, the k nearest rows of other labels with a score from
    window[0] to window[1] tenths of the positive's. rows: (vec_id, label, v) of integers, one for each vec_id."""
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    index = Index(rows, sample, rows_a_block)
    if not index.n:
        return spark.createDataFrame([], MINED)
    asked = rows.join(anchors.select("vec_id").distinct(), "vec_id").select(F.col("vec_id").alias("anchor_id"), "label", "v")
    n_anchors = asked.count()
    if not n_anchors:
        return spark.createDataFrame([], MINED)
    one = lambda x: F.array(F.lit(x).cast("long"))
    positives = index.search(asked.select("*", one(0).alias("keys"), one(-ANY).alias("low"), one(ANY).alias("high")), n_anchors, n_positives, True)
    positives = written(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where("score >= 0"), "positives")
    tenths, rest = F.expr("positive_score div 10"), F.col("positive_score") % 10
    low = tenths * window[0] + F.floor((rest * window[0] + 9) / 10)
    high = tenths * window[1] + F.floor(rest * window[1] / 10)
    windows = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", low.alias("low"), high.alias("high"))).alias("w"))  # n_positives at most
    requests = asked.join(windows, "anchor_id").select("anchor_id", "label", "v", F.col("w.positive_id").alias("keys"), "w.low", "w.high")
    found = index.search(requests, n_anchors, k, False).withColumnsRenamed({"key": "positive_id", "vec_id": "negative_id", "score": "negative_score"})
    return found.join(positives, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: hard negatives of the anchors, whose vec_id 100 divides; where 7 divides it, the label is the next one."""
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))
