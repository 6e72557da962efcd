"""b-bit MinHash near-duplicates (operator 7).

A document's set is its distinct word shingles. Documents of equal sets are one class from the start. Each class has
HASHES minima; those of the bands give candidate buckets, and the low two bits of all of them, packed, give an estimate
of similarity, corrected for the quarter of bits that agree by chance. Pairs whose estimate is more than MARGIN below
the threshold are out (almost five standard deviations); the others are confirmed on the full sets.

Links are needed for components only, so buckets are first cut into blocks of BLOCK members, each with the bucket's lead,
and give the edges of a maximum spanning forest of the estimates in each block. After these are confirmed, only the
outsiders of a bucket, members of other components than most of its members, are compared with all of the bucket; a
pair is looked at in the first band that both share. Such a comparison lists its candidates, gets each of their texts
once, and confirms on full sets inside the block, so copies cost about their number and no link is lost to a cap.

Defined results: a text of fewer words than a shingle has one, all its words; a text without words has none and is
linked with nothing; repeated rows are one class; among rows that share a doc_id each has its own text's component.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.shared import apart, key_of, keyed, keyed_id, restored, written
from paperloom.llm.words import SPACED, Words, mix, ngram_hashes, words_of

BANDS, ROWS = 32, 4  # a pair at 0.8 shares no band with a chance of 5e-8
HASHES = 256
MARGIN = 0.14
BLOCK = 512
AT_ONCE = 1 << 21  # shingles compared with one set at once
_rng = np.random.default_rng(7)
FLIP = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
FACTOR = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    h = w.hashes()
    g = ngram_hashes(h, size)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(ngram_hashes(h[a:b], int(b - a))[:1] ^ np.uint64(b - a))
        else:
            out.append(g[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of the sets, which are not empty: one row a set."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint64)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((values ^ FLIP[j]) * FACTOR[j], starts)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    key = np.zeros((len(minima), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key ^ minima[:, r : BANDS * ROWS : ROWS])
    return key


def packed_bits(minima: np.ndarray) -> np.ndarray:
    """The two low bits of each mixed minimum, 32 a word."""
    two = mix(minima) & np.uint64(3)
    shifted = two.reshape(len(minima), HASHES // 32, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(shifted, axis=2)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of all rows of a with all rows of b: the share of equal pairs of bits, without chance agreement."""
    unequal = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        unequal += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return ((1 - unequal / HASHES) - 0.25) / 0.75


def _sketcher(size: int, lower: bool):
    names = ["_k", "_t", "n", "v", "bits", "bands"]

    def sketch(batches):
        for batch in batches:
            for i, w in words_of(batch.column("text"), SPACED, lower):
                sets = shingle_sets(w, size)
                some = [d for d, s in enumerate(sets) if len(s)]
                n = np.array([len(s) for s in sets], np.int64)
                digests: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if some:
                    minima = signatures([sets[d] for d in some])
                    keys, packed = band_keys(minima).view(np.int64), packed_bits(minima)
                    for row, d in enumerate(some):
                        digests[d] = hashlib.blake2b(sets[d].tobytes(), digest_size=16).digest()
                        bits[d], bands[d] = packed[row].tobytes(), keys[row]
                rows = batch.slice(i, len(sets))
                data = [rows.column("_k"), rows.column("_t"), pa.array(n), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(data, names)

    return sketch


def _forest(sim: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over pairs of at least ``least`` (Prim's algorithm, a row of sim at a time)."""
    m = len(sim)
    best, source, left, out = np.full(m, -1.0), np.full(m, -1), np.ones(m, bool), []
    for _ in range(m):
        i = int(np.argmax(np.where(left, best, -2.0)))
        left[i] = False
        if best[i] >= least:
            out.append((int(source[i]), i))
        closer = left & (sim[i] > best)
        best[closer], source[closer] = sim[i][closer], i
    return out


def _grouped(batches, keys: list[str], columns: list[str]):
    """(key, rows) of each group of rows that lie together."""
    held: list = []
    group = None
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in (*keys, *columns)]
        for row in zip(*lists, strict=True):
            if row[: len(keys)] != group:
                if held:
                    yield group, held
                held, group = [], row[: len(keys)]
            held.append(row[len(keys) :])
    if held:
        yield group, held


def _comparable(v, n, bits, threshold: float) -> np.ndarray:
    """Estimates of all pairs, -1 where the sizes rule the similarity out."""
    n = np.array(n)
    words = np.frombuffer(b"".join(bits), np.uint64).reshape(len(v), -1)
    sim = estimates(words, words)
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    sim[low < threshold * high - 1e-9] = -1
    np.fill_diagonal(sim, -1)
    return sim


def _first_pairs(threshold: float):
    """Edges of a spanning forest of each (key, block)."""

    def find(batches):
        out: set = set()
        for _, rows in _grouped(batches, ["key", "block"], ["v", "n", "bits"]):
            v, n, bits = zip(*rows, strict=True)
            out.update((min(v[i], v[j]), max(v[i], v[j])) for i, j in _forest(_comparable(v, n, bits, threshold), threshold - MARGIN))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])

    return find


GROUP = ["key", "one", "two"]


def _last_candidates(threshold: float):
    """For each group and member with candidates in it: its root, and for an outsider (side 1; side 2: another block of
    outsiders) the candidates."""

    def find(batches):
        for group, rows in _grouped(batches, GROUP, ["v", "n", "bits", "bands", "root", "side"]):
            v, n, bits, bands, root, side = zip(*rows, strict=True)
            side, bands = np.array(side), np.array(bands, np.int64).view(np.uint64)
            good = _comparable(v, n, bits, threshold) >= threshold - MARGIN
            code = np.unique(np.array(root, object), return_inverse=True)[1]
            good &= code[:, None] != code[None, :]
            good[side != 1] = False  # rows are the outsiders' side
            if group[1]:  # outsiders of one block meet in the first of its groups
                good[:, side == 1] = False
            key = np.uint64(group[0] % 2**64)
            own = int(np.flatnonzero((bands == key).all(0))[0])  # the band of this bucket
            i, j = np.nonzero(good)
            for band in range(own):
                other = bands[i, band] != bands[j, band]
                i, j = i[other], j[other]
            if not len(i):
                continue
            partners: dict = {int(x): [] for x in np.unique(np.concatenate([i, j]))}
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                partners[x].append(v[y])
            data = [pa.array([g] * len(partners), pa.int64()) for g in group]
            data += [pa.array([v[x] for x in partners], pa.binary()), pa.array([root[x] for x in partners], pa.binary()), pa.array(list(partners.values()), pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(data, [*GROUP, "v", "root", "others"])

    return find


def _group_confirmer(size: int, lower: bool, percent: int):
    """Links of each group's candidates, of those of one outsider and one component one at most."""

    def sets_of(batches):
        for batch in batches:
            hashes = pa.array([s.tobytes() for _, w in words_of(batch.column("text"), SPACED, lower) for s in shingle_sets(w, size)], pa.large_binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*GROUP, "v", "root", "others")), hashes], [*GROUP, "v", "root", "others", "hashes"])

    def confirm(batches):
        for _, rows in _grouped(sets_of(batches), GROUP, ["v", "root", "others", "hashes"]):
            sets = {v: np.frombuffer(h, np.uint64) for v, _, _, h in rows}
            joined = {root: root for _, root, _, _ in rows}
            roots = {v: root for v, root, _, _ in rows}

            def find(x, joined=joined):
                while joined[x] != x:
                    x = joined[x] = joined[joined[x]]
                return x

            links = []
            for v, _, others, _ in rows:
                at = 0
                while at < len(others):
                    some, total = [], 0
                    while at < len(others) and (not some or total + len(sets[others[at]]) <= AT_ONCE):
                        if find(roots[others[at]]) != find(roots[v]):
                            some.append(others[at])
                            total += len(sets[others[at]])
                        at += 1
                    if not some:
                        continue
                    held, x = np.concatenate([sets[o] for o in some]), sets[v]
                    sizes = np.array([len(sets[o]) for o in some])
                    hits = x[np.minimum(np.searchsorted(x, held), len(x) - 1)] == held
                    common = np.add.reduceat(hits.astype(np.int64), np.cumsum([0, *sizes[:-1]]))
                    for o in np.flatnonzero(100 * common >= percent * (len(x) + sizes - common)):
                        one, two = find(roots[v]), find(roots[some[o]])
                        if one != two:
                            joined[one] = two
                            links.append((v, some[o]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links, strict=True)], ["a", "b"])

    return confirm


def _confirmer(size: int, lower: bool, percent: int):
    """Keeps pairs of texts with 100 * intersection >= percent * union."""

    def confirm(batches):
        for batch in batches:
            sides = []
            for c in ("text_a", "text_b"):
                sides.append([s for _, w in words_of(batch.column(c), SPACED, lower) for s in shingle_sets(w, size)])
            good = []
            for x, y in zip(*sides, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _first_links(members: DataFrame, texts: DataFrame, size: int, percent: int, lower: bool) -> DataFrame:
    """Confirmed links (a, b) between members (key, v, n, bits, c) of buckets of c members."""
    blocks = F.ceil(F.col("c") / BLOCK)
    dealt = members.select("key", F.pmod(F.xxhash64("v"), blocks).alias("block"), "v", "n", "bits", blocks.alias("blocks"))
    leads = dealt.where("blocks > 1").groupBy("key").agg(F.min_by(F.struct("block", "v", "n", "bits", "blocks"), "v").alias("l")).select("key", "l.*")
    others = leads.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    dealt = dealt.drop("blocks").unionByName(others.select("key", F.col("other").alias("block"), "v", "n", "bits"))
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    pairs = dealt.mapInArrow(_first_pairs(percent / 100), "a binary, b binary").distinct()
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(size, lower, percent), "a binary, b binary")


def _last_links(members: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, lower: bool) -> DataFrame:
    """Confirmed links between outsiders of buckets and members of other components."""
    rooted = members.select("key", "v").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all")).where("most.c < all")
    mixed = mixed.select("key", F.col("most.root").alias("most"), F.ceil(F.col("most.c") / BLOCK).alias("inner"), F.ceil((F.col("all") - F.col("most.c")) / BLOCK).alias("outer"))
    dealt = rooted.join(mixed, "key").select("key", "v", "root", (F.col("root") != F.col("most")).alias("outsider"), "inner", "outer")
    # Outsiders meet each block of the others, and each other: those of one block in the first of these groups.
    mine = F.pmod(F.xxhash64("v"), F.when(F.col("outsider"), F.col("outer")).otherwise(F.col("inner")))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda one, two, side: F.struct(one.alias("one"), two.alias("two"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    inside = F.transform(each("outer"), lambda o: place(F.col("mine"), o, 0))
    outside = F.transform(each("inner"), lambda m: place(m, F.col("mine"), 1))
    apart_ = F.transform(F.filter(each("outer"), lambda o: o != F.col("mine")), lambda o: place(-1 - F.least(o, F.col("mine")), F.greatest(o, F.col("mine")), F.when(F.col("mine") < o, 1).otherwise(2)))
    dealt = dealt.withColumn("mine", mine)
    dealt = dealt.withColumn("p", F.explode(F.when(F.col("outsider"), F.concat(outside, apart_)).otherwise(inside)))
    dealt = dealt.select("key", "p.*", "v", "root").join(classes.select("v", "n", "bits", "bands"), "v")
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = dealt.mapInArrow(_last_candidates(percent / 100), "key long, one long, two long, v binary, root binary, others array<binary>")
    found = written(found, "candidates").join(texts, "v").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return found.mapInArrow(_group_confirmer(size, lower, percent), "a binary, b binary")


def groups(docs: DataFrame, size: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(_k, _t, n, first): for each distinct (doc_id, text) of docs, keyed as in ``keyed``, its number of shingles and
    the least (_k, _t) of its component."""
    rows = keyed(docs)
    sketches = rows.select("_k", "_t", "text").mapInArrow(_sketcher(size, lower), "_k long, _t long, n long, v binary, bits binary, bands array<long>")
    sketches = written(sketches, "sketches")
    some = sketches.where("v is not null")
    classes = some.groupBy("v").agg(F.min(F.struct("_k", "_t")).alias("first"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("bands").alias("bands"))
    classes = written(classes, "classes")
    in_bands = classes.select("v", F.explode("bands").alias("key"))
    buckets = in_bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = written(in_bands.join(buckets, "key").join(classes.select("v", "n", "bits"), "v"), "members")
    near = members.select("v").distinct().join(classes.select("v", "first._k", "first._t"), "v")
    texts = written(rows.select("_k", "_t", "text").join(near, ["_k", "_t"]).dropDuplicates(["v"]).select("v", "text"), "texts")
    links = written(_first_links(members, texts, size, percent, lower), "links")
    more = written(_last_links(members, written(components(links), "roots"), classes, texts, size, percent, lower), "links")
    roots = written(components(links.unionByName(more)), "roots")
    joined = classes.select("v", "first").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("first"))
    by_class = joined.drop("first").join(firsts, "root").select("v", "first")
    own = F.struct("_k", "_t")
    linked = some.select("_k", "_t", "n", "v").join(by_class, "v").select("_k", "_t", "n", "first")
    return linked.unionByName(sketches.where("v is null").select("_k", "_t", "n", own.alias("first")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: components of documents on 2-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = groups(docs, size=2).select(key_of().alias("doc_id"), F.col("n").alias("n_shingles"), key_of("first._k").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each component on 5-word shingles, the document of the least doc_id stays."""
    first = groups(docs).where((F.col("_k") == F.col("first._k")) & (F.col("_t") == F.col("first._t"))).select("_k", "_t").distinct()
    rows = apart(docs).withColumns({"_k": keyed_id(), "_t": F.xxhash64(F.lit(0), F.col("text"))})
    return rows.join(first, ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"]).select(*restored(docs))
