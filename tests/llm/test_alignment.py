"""Operator 11 against a plain version that follows the contract token by token."""

import hashlib
from collections import Counter

import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import alignment
from tests.llm.conftest import SF

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(docs):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    shown, linked = [], []
    for _, text in docs:
        groups = []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = pieces.encode(text)
            bytes_a = [bytes(byte[c] for c in tokenizer.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p := pieces.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = [[], []]
                for side, tokens in enumerate((bytes_a, bytes_b)):
                    at = 0
                    for t in tokens:
                        at += len(t)
                        ends[side].append(at)
                cuts, last, x, y = sorted(set(ends[0]) & set(ends[1])), 0, 0, 0
                for cut in cuts:
                    u, v = x, y
                    while x < len(a) and ends[0][x] <= cut:
                        x += 1
                    while y < len(b) and ends[1][y] <= cut:
                        y += 1
                    groups.append((a[u:x], b[v:y]))
                    last = cut
                assert last == len((" " + text).encode())
        shown.append(groups)
        linked.append(Counter((i, j) for g in groups for i in g[0] for j in g[1]))
    counts = Counter(pair for pairs in linked for pair in pairs)
    highest: dict = {}
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    for (doc_id, _), groups, pairs in zip(docs, shown, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in pairs.items() if counts[p] == highest[p[0]])
        total = sum(n * counts[p] for p, n in pairs.items())
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(pairs.values()), best, total, digest


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


HARD = [None, "", " ", "  ", "a", " a", "a ", "a  b   c ", "▁", "a▁b c", "x ▁ y", "<0x41> <unk></s>", "<|endoftext|> a", "a\x00b", "ﬁ　x", "日本語 テキスト👩‍👩‍👧", "naïve café Größe", "é́", "\n\n\ta\r\nb", "x" * 3000, "ab" * 700 + " " + "ba" * 700, "a" * 41 + " " + "b" * 41, "don't  stop.", "1234567 89", "   x"]


@pytest.mark.parametrize("where", ["sf", "odd", "repeated"])
def test_query_gives_the_rows_of_the_contract(spark, odd, repeated, docs_of, where):
    folder = {"sf": SF, "odd": odd, "repeated": repeated}[where]
    assert rows(alignment.query(spark, folder)) == sorted(plain(docs_of(folder)), key=str)


def test_hard_texts_and_repeated_rows(spark):
    docs = [*enumerate(HARD), *enumerate(HARD), (None, "a b"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(alignment.align(df, A, B)) == sorted(plain(docs), key=str)


def test_pairs_that_are_not_broadcast_are_joined(spark, odd, docs_of):
    df = spark.read.parquet(f"{odd}/documents.parquet")
    want = sorted(plain(docs_of(odd)), key=str)
    for hot in (0, 3, 100):
        assert rows(alignment.align(df, A, B, hot)) == want


def test_links_in_slices(spark, odd, docs_of, monkeypatch):
    df = spark.read.parquet(f"{odd}/documents.parquet")
    want = {d: alignment.Aligned(A, B, [t]) for d, t in docs_of(odd) if t}
    monkeypatch.setattr(alignment, "SLICE", 10)
    for x in want.values():
        parts = [(int(a), int(b), int(n)) for part in x.links(0) for a, b, n in zip(*part, strict=True)]
        assert len({p[:2] for p in parts}) == len(parts) and sum(p[2] for p in parts) == x.totals(0)[3]
    assert df.count() > 0


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    row = alignment.aligned(df, A, B, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert len(row.groups.split(";")) == row.n_groups and sum(row.n) == row.n_links


def test_threshold_keeps_to_its_bound(spark):
    counts = spark.range(1000).select((F.col("id") % 37 + 1).alias("documents"))
    for most in (0, 10, 200, 999, 1000):
        least = alignment.threshold(counts, most)
        assert counts.where(F.col("documents") >= least).count() <= most
    assert alignment.threshold(counts, 1000) == 1
