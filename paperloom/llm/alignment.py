"""Alignment of the tokens of two vocabularies (operator 11).

Vocabulary A is byte-level BPE and reads a space and the text; vocabulary B is a piece model, which adds that space itself.
The documents of a whole Arrow batch are laid end to end with their byte offsets; the ends of A's and of B's tokens are
counted by byte (bincount), and the bytes at which both end cut the tokens into groups. A token's group is the number of cuts
before its end, and what a document has of anything is a difference of prefix sums at its offsets.

The links of a document are kept as its distinct id pairs, each with the number of its occurrences. Counts of pairs over the
corpus are a shuffle of one row a pair and batch. They come back to the documents in two ways: the HOT most frequent pairs by
a broadcast table, which those rows bound, and the rest by a join on the pair, which has no frequent keys any more.

Defined results: special tokens' strings are ordinary text. Texts that are null or empty, or whose joined tokens are not the
bytes of a space and the text (a character U+2581 becomes a space in B), have zeros and an empty digest. Each row is a document:
rows that repeat a doc_id, or the whole row, are aligned and counted each; a null doc_id stays null. A very long text is one
task's work; its links are made in slices of SLICE pairs, by classes of A ids, so tokens without a common end don't multiply in
memory. An empty table gives no rows; other columns are not read.
"""

import hashlib
import itertools
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import written
from paperloom.llm.tokens import LONGEST, Encoder

BYTES = 1 << 19  # of text laid end to end at once
KEPT = 200_000  # remembered stretches of text in a worker, for each vocabulary
SLICE = 1 << 20  # pairs expanded at once
HOT = 1 << 19  # pairs that are broadcast
SPACE = "▁"  # B's space

DOCUMENT = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, a array<int>, b array<int>, n array<long>"


def _expanded(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Consecutive places at, at + 1, ... of each run."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)


class Vocabulary:
    """The bytes of each id: ``flat[at[i] : at[i] + size[i]]``."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_expanded(self.at[ids], self.size[ids])]


class ByteLevel:
    """Vocabulary A."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, plain=True, kept=KEPT)
        shown = [b if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b else None for b in range(256)]
        free = itertools.count(256)
        byte = {chr(next(free) if c is None else c): b for b, c in enumerate(shown)}
        names = self.encoder.tokenizer.get_vocab()
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        self.vocabulary = Vocabulary(tokens)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.encoder.width).astype(np.int64) for x in self.encoder.encode([" " + t for t in texts])]


class Pieces:
    """Vocabulary B. No piece has a space after another character, so a text may be cut before each space that follows
    one, and the ids of the stretches between are remembered; a model with other pieces is given whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        is_byte = [self.model.is_byte(i) for i in range(len(names))]
        self.vocabulary = Vocabulary([bytes([int(n[3:5], 16)]) if b else n.replace(SPACE, " ").encode() for n, b in zip(names, is_byte, strict=True)])
        self.cuts = not any(SPACE in n.lstrip(SPACE) for n in names)
        self.code = "H" if len(names) <= 1 << 16 else "I"
        self.kept: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x).tobytes() for x in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if not self.cuts or "  " in t or t[:1] in ("", " ") or t[-1:] == " "]
        alone = dict(zip(whole, self._ids([texts[i] for i in whole]), strict=True))
        parts = [None if i in alone else t.split(" ") for i, t in enumerate(texts)]
        kept = self.kept
        new = list({w for p in parts if p for w in p if w not in kept})
        full = len(kept) >= KEPT
        kept.update(zip(new, self._ids(new), strict=True))
        out = [alone[i] if p is None else b"".join(map(kept.__getitem__, p)) for i, p in enumerate(parts)]
        for w in new:
            if full or len(w) > LONGEST:
                del kept[w]
        return [np.frombuffer(x, self.code).astype(np.int64) for x in out]


_sides: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """The worker's two vocabularies."""
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = ByteLevel(path_a), Pieces(path_b)
    return _sides[path_a, path_b]


def _matching(vocabulary: Vocabulary, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
    """Whether the joined tokens of each document are its bytes."""
    n = np.array([vocabulary.size[x].sum() for x in ids], np.int64)
    joined = vocabulary.joined(np.concatenate([*ids, np.zeros(0, np.int64)]))
    ends = np.cumsum(n)
    return np.array([joined[e - k : e].tobytes() == r for e, k, r in zip(ends, n, raw, strict=True)], bool)


def _counted(group: np.ndarray, ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), ascending, and how often each occurs."""
    key, n = np.unique(group * n_ids + ids, return_counts=True)
    return key // n_ids, key % n_ids, n


def _links(group_a, a, group_b, b, n_groups: int, size_a: int, size_b: int):
    """Distinct pairs of ids that share a group: (a, b, occurrences), in parts that have no pair in common."""
    group_a, a, n_a = _counted(group_a, a, size_a)
    group_b, b, n_b = _counted(group_b, b, size_b)
    in_group = np.bincount(group_b, minlength=n_groups)
    first = np.concatenate([[0], np.cumsum(in_group)[:-1]]) if n_groups else np.zeros(0, np.int64)
    fan = in_group[group_a]
    n_parts = int(fan.sum() // SLICE) + 1
    for part in range(n_parts):
        mine = np.flatnonzero(a % n_parts == part) if n_parts > 1 else np.arange(len(a))
        right = _expanded(first[group_a[mine]], fan[mine])
        left = np.repeat(mine, fan[mine])
        pair, place = np.unique(a[left] * size_b + b[right], return_inverse=True)
        if len(pair):
            yield pair // size_b, pair % size_b, np.bincount(place, n_a[left] * n_b[right]).astype(np.int64)


_texts: dict[int, np.ndarray] = {}


def _shown(n_ids: int) -> np.ndarray:
    """The text of each id after the mark before it: a comma, or what begins a group's A or B ids."""
    if n_ids not in _texts:
        _texts[n_ids] = np.array([[m + str(i) for i in range(n_ids)] for m in ",;|"], object)
    return _texts[n_ids]


class Aligned:
    """The alignment of consecutive documents: for document d, its tokens ``a[first_a[d] : first_a[d + 1]]`` with their
    groups ``group_a``, the same of B, and its groups ``first_group[d]`` to ``first_group[d + 1]``."""

    def __init__(self, path_a: str, path_b: str, texts: list[str]):
        left, right = sides(path_a, path_b)
        self.size_a, self.size_b = len(left.vocabulary.size), len(right.vocabulary.size)
        raw = [(" " + t).encode() if t else b"" for t in texts]
        ids = [side.encode([t or "" for t in texts]) for side in (left, right)]
        good = np.array([bool(t) for t in texts], bool) & _matching(left.vocabulary, ids[0], raw) & _matching(right.vocabulary, ids[1], raw)
        none = np.zeros(0, np.int64)
        a, b = ([x if g else none for x, g in zip(side, good, strict=True)] for side in ids)
        offsets = np.concatenate([[0], np.cumsum([len(r) if g else 0 for r, g in zip(raw, good, strict=True)])]).astype(np.int64)
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in (a, b))
        self.a, self.b = np.concatenate([*a, none]), np.concatenate([*b, none])
        end_a, end_b = np.cumsum(left.vocabulary.size[self.a]), np.cumsum(right.vocabulary.size[self.b])
        n = int(offsets[-1]) + 1
        ends = (np.bincount(end_a, minlength=n) > 0) & (np.bincount(end_b, minlength=n) > 0)
        before = np.concatenate([[0], np.cumsum(ends)])  # cuts before each byte
        self.group_a, self.group_b = before[end_a], before[end_b]
        self.first_group = before[offsets + 1] if len(offsets) else none
        n_groups = int(before[-1])
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n_groups), np.bincount(self.group_b, minlength=n_groups)
        self.links_before = np.concatenate([[0], np.cumsum(self.in_a * self.in_b)])

    def digests(self, with_groups: bool):
        """For each document the sha256 of its groups as text, and that text if it is asked for."""
        tokens = np.concatenate([self.group_a * 2, self.group_b * 2 + 1])
        order = np.argsort(tokens, kind="stable")  # groups, A before B, each in its order
        side = tokens[order]
        begins = np.ones(len(side), bool)
        begins[1:] = side[1:] != side[:-1]
        shown = _shown(max(self.size_a, self.size_b))[begins * (1 + (side & 1)), np.concatenate([self.a, self.b])[order]].tolist()
        first = self.first_a + self.first_b
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            text = "".join(shown[s:e])[1:]
            yield (hashlib.sha256(text.encode()).hexdigest() if text else ""), (text if with_groups else None)

    def totals(self, d: int) -> list[int]:
        """n_a, n_b, n_groups, n_links."""
        g, h = self.first_group[d], self.first_group[d + 1]
        return [int(self.first_a[d + 1] - self.first_a[d]), int(self.first_b[d + 1] - self.first_b[d]), int(h - g), int(self.links_before[h] - self.links_before[g])]

    def links(self, d: int):
        """Its distinct pairs (a, b, occurrences), in parts."""
        x, y, u, v = self.first_a[d], self.first_a[d + 1], self.first_b[d], self.first_b[d + 1]
        g = self.first_group[d]
        n = int(self.first_group[d + 1] - g)
        return _links(self.group_a[x:y] - g, self.a[x:y], self.group_b[u:v] - g, self.b[u:v], n, self.size_a, self.size_b)


def _aligner(path_a: str, path_b: str, with_groups: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DOCUMENT))
    none = np.zeros(0, np.int64)

    def batch_of(rows: list[list]):
        *plain, a, b, n = zip(*rows, strict=True)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in a])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((a, np.int32), (b, np.int32), (n, np.int64))]
        arrays = [pa.array(c, f.type) for c, f in zip(plain, schema, strict=False)]
        return pa.RecordBatch.from_arrays([*arrays, *(x.cast(f.type) for x, f in zip(lists, list(schema)[-3:], strict=True))], schema=schema)

    def align(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 36)
        for batch in batches:
            doc_ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            at, rows, held = 0, [], 0
            while at < len(doc_ids):
                texts, size, begin = [], 0, at
                while at < len(doc_ids) and (not texts or size < BYTES):
                    texts.append(column[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                x = Aligned(path_a, path_b, texts)
                for d, (doc_id, shown) in enumerate(zip(doc_ids[begin:at], x.digests(with_groups), strict=True)):
                    row, head = next(numbers), [doc_id, *x.totals(d), *shown]
                    for a, b, n in x.links(d) if head[3] else [(none, none, none)]:
                        rows.append([row, *head, a, b, n])
                        head, held = [None] * len(head), held + len(a)
                        if held >= SLICE // 4:
                            yield batch_of(rows)
                            rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return align


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row a document (_row numbers them): n_a, n_b, n_groups, n_links, groups_sha256, groups (if asked for), and its
    distinct linked pairs a, b with their occurrences n. Where these are more than SLICE, further rows of the same _row
    have the rest of the pairs and nulls."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_aligner(path_a, path_b, with_groups), DOCUMENT)


def _pairs(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.explode(F.arrays_zip("a", "b", "n")).alias("_p")).select(*more, "_p.a", "_p.b", "_p.n")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many documents have each pair, and whether no pair of its A id is in more."""
    counts = written(_pairs(rows).groupBy("a", "b").agg(F.count("*").alias("documents")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))  # at most a row an id of A
    return counts.join(highest, "a").select("a", "b", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def threshold(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs are in as many documents or more."""
    held, least = 0, 0
    sizes = counts.groupBy(F.length(F.bin("documents")).alias("bits")).count().collect()  # 64 rows at most
    for bits, n in sorted(((r.bits, r["count"]) for r in sizes), reverse=True):
        if held + n > most:
            return 1 << bits  # pairs of this many bits stay out
        held, least = held + n, 1 << (bits - 1)
    return least


def link_sums(rows: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """(_row, n_best, count_sum): over each document's links, those whose pair is best, and the sum of their counts."""
    least = threshold(counts, hot)
    value = F.struct("documents", "best")
    often = F.broadcast(counts.where(F.col("documents") >= least))  # hot rows at most
    looked_up = _pairs(rows, "_row").join(often, ["a", "b"], "left")
    sums = (F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum"))
    out = looked_up.groupBy("_row").agg(*sums)
    if least > 1:
        missing = looked_up.where(F.col("documents").isNull()).drop("documents", "best")
        rest = counts.where(F.col("documents") < least).select("a", "b", value.alias("_v"))
        joined = missing.join(rest, ["a", "b"]).select("_row", "n", "_v.documents", "_v.best")
        out = out.unionByName(joined.groupBy("_row").agg(*sums)).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def align(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """For each row of docs (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = written(aligned(docs, path_a, path_b), "aligned")
    counts = written(pair_counts(rows), "pair-counts")
    sums = link_sums(rows, counts, hot)
    documents = rows.where(F.col("n_a").isNotNull()).select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return documents.join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the alignment of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
