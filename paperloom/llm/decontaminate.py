"""Benchmark decontamination by a prefix-filtered set join (operator 4).

Items are cut into windows of ``size`` words (a shorter item is one window). A document holds a window exactly where it
holds all of the window's shingles in order, so one shingle is the necessary prefix: the one that the fewest documents
hold, counted over the whole corpus. Documents are matched on prefixes, the place of the prefix in its window gives the
only possible alignment, the window must fit between the document's ends, and what is left is verified word for word.

The windows are broadcast in blocks of at most BLOCK_WINDOWS, so what a task holds is bounded whatever the size of the
benchmark; further blocks cost further passes over documents, each written to the shared folder.

Defined results: words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters; null and empty texts have no
words and are clean; an item without words has no windows; repeated rows are judged each; with an empty benchmark all
documents are clean.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from paperloom.llm.shared import apart, restored, written
from paperloom.llm.words import ALNUM, ngram_hashes, words_of

BLOCK_WINDOWS = 100_000
SHINGLE = 3


class Block:
    """Windows, sorted so that each shingle and each prefix is found by binary search."""

    def __init__(self, windows: list[tuple[bytes, int, str]]):
        """windows: (text, number of words, item)."""
        items: dict[bytes, set] = {}
        for text, _, item in windows:
            items.setdefault(text, set()).add(item)
        self.texts = sorted(items)
        self.items = [sorted(items[t]) for t in self.texts]
        counts = {t: n for t, n, _ in windows}
        self.lengths = np.array([counts[t] for t in self.texts], np.int64)
        self.shingles: dict[int, np.ndarray] = {}  # shingle length -> sorted hashes
        self.whole = np.zeros(len(self.texts), np.uint64)
        self.of: list = []  # for each window: hashes of its shingles in order
        for i, w in enumerate(_words(self.texts)):
            n = int(self.lengths[i])
            s = min(SHINGLE, n)
            self.of.append((s, ngram_hashes(w, s)[: n - s + 1]))
            self.whole[i] = ngram_hashes(w, n)[0]
        for s in {s for s, _ in self.of}:
            self.shingles[s] = np.unique(np.concatenate([h for k, h in self.of if k == s]))
        self.prefix: dict[int, tuple] = {}

    def choose(self, found_in: dict[int, int]) -> None:
        """Takes as prefix of each window its rarest shingle; found_in: documents by shingle hash."""
        picked = []
        for s, h in self.of:
            at = min(range(len(h)), key=lambda j: (found_in.get(int(h[j]), 0), int(h[j])))
            picked.append((s, h[at], at))
        for s in self.shingles:
            mine = sorted((int(h), at, i) for i, (k, h, at) in enumerate(picked) if k == s)
            self.prefix[s] = (np.array([x[0] for x in mine], np.uint64), np.array([x[1] for x in mine]), np.array([x[2] for x in mine]))
        self.of = []


def _words(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for _, w in words_of(pa.array([t.decode() for t in texts], pa.string()), ALNUM, lower=True):
        h = w.hashes()
        out += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def _windows(size: int):
    def cut(batches):
        for batch in batches:
            out = []
            for i, w in words_of(batch.column("text"), ALNUM, lower=True):
                for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                    n = min(size, b - a)
                    out += [(batch.column("item_id")[i + d].as_py(), w.text(k, k + n), n) for k in range(a, b - n + 1) if n]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.int32()), strict=True)], ["item_id", "window", "n_words"])

    return cut


def _counter(shared):
    """Counts for each shingle of the block the documents that hold it, in each task over all its rows."""

    def count(batches):
        block = shared.value
        totals = {s: np.zeros(len(h), np.int64) for s, h in block.shingles.items()}
        for batch in batches:
            for _, w in words_of(batch.column("text"), ALNUM, lower=True):
                h, room = w.hashes(), w.first[w.doc + 1] - np.arange(len(w.doc))
                for s, known in block.shingles.items():
                    at, k = _find(known, ngram_hashes(h, s), room >= s)
                    seen = np.unique(w.doc[at] * len(known) + k)
                    totals[s] += np.bincount(seen % len(known), minlength=len(known))
        for s, n in totals.items():
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(block.shingles[s][some].view(np.int64)), pa.array(n[some])], ["shingle", "n_docs"])

    return count


def _find(known: np.ndarray, g: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in g that hold a known hash, and which one (the first, if known repeats it)."""
    k = np.minimum(np.searchsorted(known, g), len(known) - 1)
    at = np.flatnonzero((known[k] == g) & valid)
    return at, k[at]


def _matches(w, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all exact occurrences of the block's windows."""
    h, room = w.hashes(), w.first[w.doc + 1] - np.arange(len(w.doc))
    firsts, which = [], []
    for s, (known, offset, window) in block.prefix.items():
        at, k = _find(known, ngram_hashes(h, s), room >= s)
        n = np.searchsorted(known, known[k], "right") - k
        each = np.repeat(k, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        start, win = at - offset[each], window[each]
        fits = start >= w.first[w.doc[at]] if len(at) else np.zeros(0, bool)
        fits[fits] &= start[fits] + block.lengths[win[fits]] <= w.first[w.doc[at[fits]] + 1]
        firsts.append(start[fits])
        which.append(win[fits])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, win = np.concatenate(firsts), np.concatenate(which)
    good = np.zeros(len(start), bool)
    for n in np.unique(block.lengths[win]):
        mine = np.flatnonzero(block.lengths[win] == n)
        good[mine] = ngram_hashes(h, int(n))[start[mine]] == block.whole[win[mine]]
    start, win = start[good], win[good]
    same = np.array([w.text(a, a + block.lengths[i]) == block.texts[i] for a, i in zip(start, win, strict=True)], bool)
    return start[same], win[same]


def _scanner(shared, keep: list[str]):
    def scan(batches):
        block = shared.value
        for batch in batches:
            n_words, spans, items = [], batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for i, w in words_of(batch.column("text"), ALNUM, lower=True):
                n_words += w.counts.tolist()
                for a, k in zip(*_matches(w, block), strict=True):
                    d = int(w.doc[a])
                    spans[i + d] += [int(a - w.first[d]), int(a - w.first[d] + block.lengths[k])]
                    items[i + d] += block.items[k]
            items = [sorted(set(x)) for x in items]
            data = [batch.column(c) for c in keep] + [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(data, [*keep, "n_words", "spans", "items"])

    return scan


RESULT = [StructField("n_words", LongType()), StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, keep: tuple[str, ...] = ("doc_id",), block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Columns ``keep`` of docs with n_words, spans (first word and the word behind the last, of each occurrence of an
    item's window, one pair after the other) and items (ids of the items that have them, as sorted strings)."""
    spark = docs.sparkSession
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = texts.mapInArrow(_windows(size), "item_id string, window binary, n_words int").distinct()
    windows = written(windows, "windows")
    n_blocks = max(1, -(-windows.count() // block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(n_blocks)))
    rows = docs.withColumns({"text": F.col("text").cast("string"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    for b in range(n_blocks):
        mine = [(bytes(r.window), r.n_words, r.item_id or "") for r in windows.where(F.col("block") == b).collect()]
        block = Block(mine)
        first = spark.sparkContext.broadcast(block)
        counted = rows.select("text").mapInArrow(_counter(first), "shingle long, n_docs long").groupBy("shingle").agg(F.sum("n_docs").alias("n"))
        block.choose({r.shingle % 2**64: r.n for r in counted.collect()} if mine else {})  # a row a shingle of the block
        cols = [*keep, "text"] if b + 1 < n_blocks and "text" not in keep else list(keep)
        schema = StructType([rows.schema[c] for c in cols] + RESULT)
        chosen = spark.sparkContext.broadcast(block)
        wanted = [*dict.fromkeys([*cols, "text", "spans", "items"])]
        rows = rows.select(*wanted).mapInArrow(_scanner(chosen, cols), schema)
        if b + 1 < n_blocks:
            rows = written(rows, "scanned")
    return rows


def _covered(spans: list[int]) -> int:
    total, reach = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _digest(batches):
    for batch in batches:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        hit = [_covered(x) for x in spans]
        data = [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64())]
        data += [pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in hit])]
        yield pa.RecordBatch.from_arrays(data, DIGEST.names)


DIGEST = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document against every item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).mapInArrow(_digest, DIGEST)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a window of an item go."""
    own = apart(docs)
    judged = decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(own.columns))
    return judged.where(F.size("spans") == 0).select(*restored(docs))


SQL = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id::varchar item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') s from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) k from b where len(w) > 0)),
dw as (select r, k, n, array_to_string(w[k:k + n - 1], ' ') s from (select r, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from bw) where len(w) >= n)),
m as (select r, k, dw.n, item_id from dw join bw using (n, s)),
hits as (select r, count(distinct p) n_hit from (select r, unnest(range(k, k + n)) p from m) group by r),
its as (select r, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from m group by r)
select doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (r) left join its using (r)
"""
