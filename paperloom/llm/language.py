"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 10).

A text's subwords are the runs of three and four bytes of its letters, with A-Z in lower case and other ASCII characters
as spaces, hashed to DIM rows of an embedding table. Table and softmax are trained in numpy by stochastic gradient descent
on at most ``sample`` labelled rows, the ones with the least hash; a tenth of them sets the temperature that calibrates
scores and the score below which a target precision is missed. A text's logits are the mean of its subwords' logits, so
after training the table holds those.

Defined results: a null text, or one without a letter, is ``und`` with score 0; repeated rows are scored each; rows with
a null doc_id or lang are never learned from; without any row to learn from, all is ``und``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.words import chunks

SAMPLE = 3000  # rows at most that the model learns from
DIM = 1 << 15
WIDTH = 16
SIZES = (3, 4)
SHOWN = np.full(256, 0x20, np.uint8)
SHOWN[0x80:] = np.arange(0x80, 0x100)
SHOWN[0x61:0x7B] = np.arange(0x61, 0x7B)
SHOWN[0x41:0x5B] = np.arange(0x61, 0x7B)


def subwords(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each size, the table row of the subword that begins at each byte of consecutive texts; DIM where it would
    reach into the next text."""
    data = SHOWN[raw].astype(np.uint32)
    out = []
    for n in SIZES:
        h = np.zeros(len(data), np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h[: len(data) - j] ^= data[j:]
        h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
        for j in range(1, n):
            past = offsets[1:] - j
            h[past[past >= offsets[:-1]]] = DIM
        out.append(h)
    return out


def _bags(batches):
    """For training rows: which subwords a text has, and how often."""
    for batch in batches:
        rows = []
        for i, data, offsets in chunks(batch.column("text")):
            found = subwords(data, offsets)
            for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                counts = np.bincount(np.concatenate([h[a:b] for h in found]), minlength=DIM + 1)[:DIM]
                ids = np.flatnonzero(counts)
                rows.append((ids.tolist(), counts[ids].tolist(), batch.column("lang")[i + d].as_py()))
        ids, n, langs = zip(*rows, strict=True) if rows else ((), (), ())
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, n, langs), kinds, strict=True)], ["ids", "n", "lang"])


class Model:
    """Logits of subwords (table), biases, languages, temperature, and the score below which to reject."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, langs: list[str], temperature: float, reject_below: float):
        self.table, self.bias, self.langs, self.temperature, self.reject_below = table, bias, langs, temperature, reject_below


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[list[int], list[int], str]], target_precision: float = 0.95, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Model:
    """rows: (subwords, counts, language)."""
    rows = [r for r in rows if r[0]]
    langs = sorted({r[2] for r in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, rows = rows[: len(rows) // 10], rows[len(rows) // 10 :]
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (DIM, WIDTH))
    soft, bias = np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    bags = [(np.array(i), np.array(n) / sum(n), langs.index(lang)) for i, n, lang in rows]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(bags)):
            ids, share, y = bags[k]
            mean = share @ table[ids]
            wrong = _softmax(mean @ soft + bias)
            wrong[y] -= 1
            back = soft @ wrong
            soft -= step * np.outer(mean, wrong)
            bias -= step * wrong * 0.1
            # Shares are small; scaled by their squares' sum, the step moves the mean as far for long and short texts.
            table[ids] -= step / (share @ share) * np.outer(share, back)
    logits = table @ soft
    temperature, least = 1.0, 0.0
    if held:
        z = np.array([np.array(n) / sum(n) @ logits[i] + bias for i, n, _ in held])
        y = np.array([langs.index(lang) for _, _, lang in held])
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        temperature = min(np.geomspace(0.05, 5, 60), key=loss)
        p = _softmax(z / temperature)
        score, right = p.max(1), p.argmax(1) == y
        for cut in np.sort(np.append(score, 0.0)):
            if right[score >= cut].mean() >= target_precision:
                least = float(cut)
                break
    return Model(logits, bias, langs, float(temperature), least)


def fit(docs: DataFrame, sample: int = SAMPLE, target_precision: float = 0.95) -> Model:
    """A model of the rows of docs (text, lang) that have both, ``sample`` at most."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id", F.lit(10)).alias("h"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    picked = rows.where(F.col("h") <= F.lit(last)).select("text", "lang").limit(sample)  # more only if hashes are equal
    bags = picked.mapInArrow(_bags, "ids array<int>, n array<int>, lang string")
    return train([(r.ids, r.n, r.lang) for r in bags.collect()], target_precision)


def _has_letter(raw: np.ndarray) -> bool:
    shown = SHOWN[raw]
    if ((shown != 0x20) & (shown < 0x80)).any():
        return True
    return bool((shown >= 0x80).any()) and any(map(str.isalpha, raw.tobytes().decode(errors="replace")))


def _predictor(shared, reject: bool):
    def predict(batches):
        model = shared.value
        k = len(model.langs)
        table = np.vstack([model.table, np.zeros((1, k))]).astype(np.float32)
        for batch in batches:
            langs, scores = [], []
            for _, data, offsets in chunks(batch.column("text")):
                size = np.diff(offsets)
                sums = np.zeros((len(size), k))
                some = np.flatnonzero(size > 0)
                if len(some):
                    for h in subwords(data, offsets):
                        sums[some] += np.add.reduceat(table[h], offsets[some], dtype=np.float64)
                n = sum(np.maximum(size - j + 1, 0) for j in SIZES)
                p = _softmax((sums / np.maximum(n, 1)[:, None] + model.bias) / model.temperature) if k else np.zeros((len(size), 1))
                best = p.argmax(1)
                for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    score = float(p[d, best[d]])
                    if not k or not _has_letter(data[a:b]):
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        langs.append("und" if reject and score < model.reject_below else model.langs[best[d]])
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, reject: bool = True) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text). reject: a score below the model's bound gives ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predictor(shared, reject), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the language of every document; a quarter of them, by crc32 of doc_id, is never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.where(remainder != 2))
    found = identify(docs, model, reject=False)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
