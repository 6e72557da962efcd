"""Substring dedup by super-k-mer partitioning (operator 3).

A window is ``size`` consecutive words of a document; its minimiser is the least hash among its runs of MINIMISER words.
Consecutive windows that share a minimiser are one super-k-mer. Equal windows have equal minimisers, so a minimiser that
only one super-k-mer has needs no further work; the others travel, packed as one string each, to the bucket of their
minimiser, where their windows are counted as text.

A bucket of up to BUCKET super-k-mers is counted in one group. Larger ones (a passage that a third of all documents
share) are dealt out by salt, and their windows' counts, added up within each salt, are summed by a digest of 128 bits.

Defined results: words are runs of characters other than space, tab, newline, vertical tab, form feed and carriage
return; a null text has none; a document of fewer words than a window loses nothing; repeated rows, of whatever doc_id,
are each other's copies; kept_sha256 of no words is that of the empty string.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import key_of, keyed, written
from paperloom.llm.words import SPACED, ngram_hashes, words_of

MINIMISER = 8
BUCKET = 1024


def _sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Least of g[i] to g[i + width - 1], for i up to len(g) - width."""
    out, have = g, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def super_kmers(w, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window's first word, number of windows) over all texts of w."""
    none = np.zeros(0, np.int64)
    if len(w.start) < size:
        return none.astype(np.uint64), none, none
    width = size - MINIMISER + 1
    g = ngram_hashes(w.hashes(), MINIMISER)[: len(w.start) - MINIMISER + 1]
    least = _sliding_min(g, width)
    at = np.flatnonzero(w.doc[: len(least)] == w.doc[size - 1 :])  # windows within one text
    if not len(at):
        return none.astype(np.uint64), none, none
    least, doc = least[at], w.doc[at]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
    return least[new], at[new], np.diff(np.append(new, len(at)))


def _repeats_inside(w, key: np.ndarray, start: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Whether a super-k-mer has its minimiser more than once, without which none of its windows repeats another."""
    g = ngram_hashes(w.hashes(), MINIMISER)
    length = n + size - MINIMISER
    ends = np.cumsum(length)
    places = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
    return np.add.reduceat((g[places] == np.repeat(key, length)).astype(np.int64), ends - length) > 1


def _minimisers(size: int):
    """One row a text: its super-k-mers' minimisers and first words."""

    def find(batches):
        for batch in batches:
            for i, w in words_of(batch.column("text"), SPACED):
                key, start, n = super_kmers(w, size)
                if len(start):  # named twice, so that it counts as repeated
                    twice = 1 + _repeats_inside(w, key, start, n, size)
                    key, start = np.repeat(key, twice), np.repeat(start, twice)
                cut = np.searchsorted(w.doc[start] if len(start) else start, np.arange(len(w.counts) + 1))
                some = np.flatnonzero(np.diff(cut))
                if not len(some):
                    continue
                offsets = pa.array(np.append(cut[some], cut[-1]), pa.int32())
                local = start - w.first[w.doc[start]]
                rows = pa.array(i + some)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key.view(np.int64), local.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("_k").take(rows), batch.column("_t").take(rows), *lists], ["_k", "_t", "keys", "starts"])

    return find


def _packer(size: int):
    """Super-k-mers at the wanted first words, packed: words joined by one space."""

    def pack(batches):
        for batch in batches:
            for i, w in words_of(batch.column("text"), SPACED):
                key, start, n = super_kmers(w, size)
                if not len(start):
                    continue
                doc = w.doc[start]
                local = start - w.first[doc]
                wanted = np.zeros(len(start), bool)
                cut = np.searchsorted(doc, np.arange(len(w.counts) + 1))
                for d in np.unique(doc):
                    mine = batch.column("starts")[i + d].values.to_numpy(zero_copy_only=False)
                    wanted[cut[d] : cut[d + 1]] = np.isin(local[cut[d] : cut[d + 1]], mine)
                pick = np.flatnonzero(wanted)
                packed = [w.text(a, a + k + size - 1) for a, k in zip(start[pick], n[pick], strict=True)]
                rows = pa.array(i + doc[pick])
                data = [pa.array(key[pick].view(np.int64)), batch.column("_k").take(rows), batch.column("_t").take(rows), pa.array(local[pick], pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(data, ["key", "_k", "_t", "start", "packed"])

    return pack


def _spans(offsets: list[int], size: int) -> list[int]:
    """First word and the word behind the last of the runs that windows at ascending offsets cover."""
    out: list[int] = []
    for a in offsets:
        if out and a <= out[-1]:
            out[-1] = a + size
        else:
            out += [a, a + size]
    return out


def _windows(packed: bytes, size: int) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


COUNTED = "_k long, _t long, start int, spans array<int>, packed_id binary, digest binary, place int, n long"
COLUMNS = [("_k", pa.int64()), ("_t", pa.int64()), ("start", pa.int32()), ("spans", pa.list_(pa.int32())), ("packed_id", pa.binary()), ("digest", pa.binary()), ("place", pa.int32()), ("n", pa.int64())]


def _count_group(rows: list[tuple], one_salt: bool, size: int):
    """Rows of COUNTED for the super-k-mers (_k, _t, start, packed) of one group. Of a bucket with one salt: spans of
    repeated windows, for occurrences that have some. With more salts: the group's distinct windows, with their counts,
    and where each packed string has them."""
    strings: dict[bytes, int] = {}
    for row in rows:
        strings[row[3]] = strings.get(row[3], 0) + 1
    counts: dict[bytes, int] = {}
    cut = {s: _windows(s, size) for s in strings}
    for s, k in strings.items():
        for x in cut[s]:
            counts[x] = counts.get(x, 0) + k
    if one_salt:
        spans = {s: _spans([i for i, x in enumerate(v) if counts[x] > 1], size) for s, v in cut.items()}
        for k, t, start, s in rows:
            if spans[s]:
                yield k, t, start, spans[s], None, None, None, None
        return
    seen = set()
    for s, v in cut.items():
        name = hashlib.sha256(s).digest()[:16]
        for i, x in enumerate(v):
            yield None, None, None, None, name, hashlib.sha256(x).digest()[:16], i, 0 if x in seen else counts[x]
            seen.add(x)


def _bucket_counter(size: int):
    """Counts the windows of each (key, salt), by which the rows are sorted."""

    def count(batches):
        out: list[tuple] = []
        held: list[tuple] = []
        group = None

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), COLUMNS, strict=True)], [c for c, _ in COLUMNS])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "salt", "salts", "_k", "_t", "start", "packed")]
            for key, salt, salts, *row in zip(*columns, strict=True):
                if group is not None and group[:2] != (key, salt):
                    out += _count_group(held, group[2] == 1, size)
                    held = []
                    if len(out) > 5_000:
                        yield flushed()
                        out.clear()
                group = (key, salt, salts)
                held.append(tuple(row))
        if held:
            out += _count_group(held, group[2] == 1, size)
        if out:
            yield flushed()

    return count


def _with_salt(occurrences: DataFrame) -> DataFrame:
    return occurrences.withColumn("salt", F.pmod(F.xxhash64("packed", "_k", "start"), F.col("salts")).cast("int"))


def repeated_spans(docs: DataFrame, size: int = 35, bucket: int = BUCKET) -> DataFrame:
    """(_k, _t, spans array<array<int>>) of documents with words in windows that occur more than once; keys as in
    ``keyed``; spans: for a super-k-mer, its first word and then bounds relative to it."""
    rows = keyed(docs)
    lists = written(rows.select("_k", "_t", "text").mapInArrow(_minimisers(size), "_k long, _t long, keys array<long>, starts array<int>"), "minimisers")
    repeated = lists.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    salts = repeated.select("key", F.ceil(F.col("n") / bucket).cast("int").alias("salts"))
    places = lists.select("_k", "_t", F.explode(F.arrays_zip("keys", "starts")).alias("x")).select("_k", "_t", F.col("x.keys").alias("key"), F.col("x.starts").alias("start"))
    wanted = places.join(salts, "key").groupBy("_k", "_t").agg(F.collect_set("start").alias("starts"))
    packed = rows.select("_k", "_t", "text").join(wanted, ["_k", "_t"]).mapInArrow(_packer(size), "key long, _k long, _t long, start int, packed binary")
    packed = written(packed, "super-kmers")
    dealt = _with_salt(packed.join(salts, "key")).repartition("key", "salt").sortWithinPartitions("key", "salt")
    counted = written(dealt.mapInArrow(_bucket_counter(size), COUNTED), "counted")
    plain = counted.where("packed_id is null").select("_k", "_t", "start", "spans")
    hot = counted.where("packed_id is not null").select("packed_id", "digest", "place", "n")
    # Written, so that both sides of the join below are plain shuffles, of which Spark splits a digest in very many places.
    often = written(hot.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"), "often")
    places = hot.join(often, "digest").groupBy("packed_id").agg(F.array_sort(F.collect_set("place")).alias("places"))
    pieces = F.transform("places", lambda p: F.array(p, p + size))
    again = packed.join(salts.where("salts > 1"), "key").select("_k", "_t", "start", F.substring(F.unhex(F.sha2("packed", 256)), 1, 16).alias("packed_id"))
    again = again.join(places, "packed_id").select("_k", "_t", "start", F.flatten(pieces).alias("spans"))
    both = plain.unionByName(again)
    return both.groupBy("_k", "_t").agg(F.collect_set(F.concat(F.array("start"), "spans")).alias("spans"))


def _remover(batches):
    for batch in batches:
        n_words, removed, kept = [], [], []
        spans = batch.column("spans")
        for i, w in words_of(batch.column("text"), SPACED):
            for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                gone = np.zeros(b - a + 1, np.int64)
                for s in spans[i + d].as_py() or ():
                    np.add.at(gone, np.array(s[1::2]) + s[0], 1)
                    np.add.at(gone, np.array(s[2::2]) + s[0], -1)
                stay = np.cumsum(gone)[:-1] == 0
                n_words.append(int(b - a))
                removed.append(int(b - a - stay.sum()))
                kept.append(b" ".join(w.data[w.start[k] : w.end[k]].tobytes() for k in a + np.flatnonzero(stay)))
        data = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(data, ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, size: int = 35, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay joined by one space, for each row of docs (doc_id, text)."""
    spans = repeated_spans(docs, size, bucket)
    rows = keyed(docs).join(spans, ["_k", "_t"], "left").select(key_of().alias("doc_id"), "text", "spans")
    return rows.mapInArrow(_remover, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: words of every document that no repeated window covers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from documents),
win as (select r, k, hash(array_to_string(w[k:k + 34], ' ')) a, md5_number(array_to_string(w[k:k + 34], ' ')) b from (select r, w, unnest(range(1, len(w) - 33)) k from d where len(w) >= 35)),
rep as (select a, b from win group by a, b having count(*) > 1),
gone as (select distinct r, unnest(range(k, k + 35)) p from win join rep using (a, b)),
lists as (select r, list(p) ps, count(*) n from gone group by r)
select doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(n, 0)::bigint n_removed,
  sha256(coalesce(array_to_string(case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' '), '')) kept_sha256
from d left join lists using (r)
"""
