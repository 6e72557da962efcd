"""Token-id shards with a keyed index (operator 1).

``write`` encodes documents in ascending doc_id order into raw little-endian id payloads, one file a range of doc_ids,
and builds an index: keys are hashed to buckets, and each bucket's file holds a minimal perfect hash from a key to its
slot, and in the slot a stored fingerprint, shard, offset and length. ``read`` looks keys up: bucket, slot, fingerprint,
then one read of the payload, whatever the size of the corpus.

Files are named by a fresh id in each task attempt and count only when the attempt's rows are in the written table of
entries, so a task that is lost or runs twice leaves at most a file that nothing names.

Defined results: a null text has the end id only; a null doc_id comes first and is looked up as null; rows that repeat a
doc_id lie together, in the order of a hash of their texts, and each is returned; an empty table has no files.
"""

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import perfect_hash
from paperloom.llm.shared import NULL_ID, new_folder, written
from paperloom.llm.tokens import encoded, encoder

DOCS_A_SHARD = 4096  # so shards hold some tens of MB, and a corpus of 1e10 documents has 2.5 million
KEYS_A_BUCKET = 100_000
ENTRY = "_k long, shard string, at long, n_ids long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _shard_writer(path: str, end_id: int, folder: str):
    def write(batches):
        e = encoder(path)
        end = np.array([end_id], e.width).tobytes()
        out, at, name = None, 0, f"{uuid.uuid4().hex}.ids"
        keys: list = []
        sizes: list = []

        def entries():
            n = len(keys)
            data = [pa.array(keys, pa.int64()), pa.array([name] * n), pa.array(np.cumsum([0, *sizes[:-1]])[:n] + (at - sum(sizes))), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(data, ["_k", "shard", "at", "n_ids"])

        for batch, row, ids in encoded(path, batches):
            if out is None:
                system, top = _filesystem(folder)
                system.create_dir(top, recursive=True)
                out = system.open_output_stream(f"{top}/{name}")
            out.write(ids + end)
            keys.append(batch.column("_k")[row].as_py())
            sizes.append((len(ids) + len(end)) // e.width.itemsize)
            at += sizes[-1]
            if len(keys) >= 10_000:
                yield entries()
                keys, sizes = [], []
        if out is not None:
            out.close()
        if keys:
            yield entries()

    return write


def _bucket_writer(folder: str):
    def write(frames):
        for bucket in _groups(frames, "bucket"):
            keys = bucket["_k"].to_numpy(np.int64)
            sizes, bits = perfect_hash.build(keys)
            slot = perfect_hash.PerfectHash(sizes, bits).slots(keys)
            order = np.argsort(slot)
            shards, code = np.unique(bucket["shard"].to_numpy(str), return_inverse=True)
            name = f"{uuid.uuid4().hex}.npz"
            system, top = _filesystem(folder)
            system.create_dir(top, recursive=True)
            with system.open_output_stream(f"{top}/{name}") as f:
                buffer = pa.BufferOutputStream()
                np.savez(
                    buffer,
                    sizes=sizes,
                    bits=np.packbits(bits),
                    n_bits=np.array([len(bits)]),
                    fingerprint=perfect_hash.fingerprints(keys.view(np.uint64))[order],
                    shards=shards,
                    shard=code[order].astype(np.int32),
                    at=bucket["at"].to_numpy(np.int64)[order],
                    n_rows=bucket["n_rows"].to_numpy(np.int64)[order],
                )
                f.write(buffer.getvalue())
            yield pd.DataFrame({"bucket": [int(bucket["bucket"].iloc[0])], "file": [name], "n_keys": [len(keys)]})

    return write


def _groups(frames, column: str):
    """The rows of each value of a column by which the frames are sorted."""
    held: list = []
    for frame in frames:
        for value, part in frame.groupby(column, sort=False):
            if held and held[0][column].iloc[0] != value:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


class TokenFiles:
    """What write() leaves: a folder of payloads and index files, and small tables that name the ones that count."""

    def __init__(self, folder: str, path: str, shards: DataFrame, buckets: DataFrame, entries: DataFrame, n_buckets: int):
        self.folder, self.path, self.shards, self.buckets, self.entries, self.n_buckets = folder, path, shards, buckets, entries, n_buckets


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> TokenFiles:
    """Writes ids of ``text`` and then end_id for each row of docs (doc_id, text), in ascending doc_id order."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_k"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    n_shards = max(spark.sparkContext.defaultParallelism, -(-n // DOCS_A_SHARD))
    ordered = rows.repartitionByRange(n_shards, "_k").sortWithinPartitions("_k", F.xxhash64("text"))
    entries = written(ordered.mapInArrow(_shard_writer(path, end_id, f"{folder}/ids"), ENTRY), "entries")
    totals = entries.groupBy("shard").agg(F.min("_k").alias("least"), F.sum("n_ids").alias("n_ids"), F.count("*").alias("n_docs"))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    shards = written(totals.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "shards")
    # Rows of one key lie together in one shard: one index entry says where they begin and how many they are.
    runs = entries.groupBy("_k", "shard").agg(F.min("at").alias("at"), F.count("*").alias("n_rows"))
    n_buckets = max(1, -(-n // KEYS_A_BUCKET))
    runs = runs.withColumn("bucket", F.pmod(F.xxhash64("_k"), F.lit(n_buckets)).cast("int"))
    index = runs.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    buckets = written(index.mapInPandas(_bucket_writer(f"{folder}/index"), "bucket int, file string, n_keys long"), "buckets")
    return TokenFiles(folder, path, shards, buckets, entries, n_buckets)


def _prober(folder: str):
    def probe(frames):
        for part in _groups(frames, "bucket"):
            keys = part["_k"].to_numpy(np.int64)
            system, top = _filesystem(folder)
            with system.open_input_file(f"{top}/{part['file'].iloc[0]}") as f:
                index = np.load(pa.BufferReader(f.read()))
                bits = np.unpackbits(index["bits"], count=int(index["n_bits"][0])).astype(bool)
                slot = perfect_hash.PerfectHash(index["sizes"], bits).slots(keys)
                found = slot >= 0
                found[found] = index["fingerprint"][slot[found]] == perfect_hash.fingerprints(keys.view(np.uint64))[found]
                slot = slot[found]
                yield pd.DataFrame({"_k": keys[found], "shard": index["shards"][index["shard"][slot]], "at": index["at"][slot], "n_rows": index["n_rows"][slot]})

    return probe


def lookup(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """(_k, shard, at, n_rows) of each distinct key (doc_id) that the index has. A key that was never written is taken
    for another one with a chance of 2**-32."""
    wanted = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_k")).distinct()
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("_k"), F.lit(files.n_buckets)).cast("int"))
    wanted = wanted.join(files.buckets, "bucket").repartition(files.n_buckets, "bucket").sortWithinPartitions("bucket")
    return wanted.mapInPandas(_prober(f"{files.folder}/index"), "_k long, shard string, at long, n_rows long")


def _payload_reader(folder: str, path: str):
    def read(frames):
        width = encoder(path).width
        system, top = _filesystem(folder)
        name, file = None, None
        for frame in frames:
            crcs, ids = [], []
            for shard, at, n in zip(frame["shard"], frame["at"], frame["n_ids"], strict=True):
                if shard != name:
                    name, file = shard, system.open_input_file(f"{top}/{shard}")
                file.seek(at * width.itemsize)
                raw = np.frombuffer(file.read(n * width.itemsize), width).astype("<u4")
                ids.append(raw.tobytes())
                crcs.append(zlib.crc32(ids[-1]))
            yield frame[["_k", "start", "n_ids"]].assign(crc=crcs)

    return read


def read(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """For each written row of the keys: doc_id, start (ids of all rows before it), n_tokens and ids_crc32, from the files."""
    found = lookup(files, keys)
    # The lengths of the rows that share one key follow its first place in the shard's own list of entries.
    own = files.entries.alias("e").join(found.alias("f"), ["_k", "shard"]).where("e.at >= f.at")
    rows = own.join(files.shards.select("shard", "base"), "shard").select("_k", "shard", F.col("e.at").alias("at"), "n_ids", (F.col("base") + F.col("e.at")).alias("start"))
    rows = rows.repartition(F.col("shard")).sortWithinPartitions("shard", "at")
    out = rows.mapInPandas(_payload_reader(f"{files.folder}/ids", files.path), "_k long, start long, n_ids long, crc long")
    return out.select(F.when(F.col("_k") != NULL_ID, F.col("_k")).alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's place and checksum, read back by key."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(write(docs, public_tokenizers.path("byte_bpe_50k.json"), 0), docs)
