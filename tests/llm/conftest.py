import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


def documents(rows):
    """Of rows (doc_id, text), with columns whose names the operators use themselves."""
    n = len(rows)
    return pa.table(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "text": pa.array([r[1] for r in rows], pa.string()),
            "lang": pa.array([("en", "de", None)[i % 3] for i in range(n)], pa.string()),
            "source": pa.array([None] * n, pa.string()),
            "n_chars": pa.array([None] * n, pa.int64()),
            **{c: pa.array([i if i % 2 else None for i in range(n)], pa.int64()) for c in ("_k", "_t", "key", "n", "spans", "items", "n_words", "n_lines", "n_removed", "gone", "quality_score", "length", "rank", "row_key", "salt", "v", "_row")},
        }
    )


def write(folder, docs, items, labels, vectors):
    urls = [d and f"http://x{d % 3}.example.net/en/{d}" for d, _ in docs]
    pq.write_table(pa.table({"page_id": pa.array([d for d, _ in docs], pa.int64()), "url": pa.array(urls, pa.string()), "host": pa.array([None] * len(docs), pa.string())}), folder / "pages.parquet")
    pq.write_table(documents(docs), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.string()), "text": pa.array([t for _, t in items], pa.string()), "block": pa.array([1] * len(items), pa.int64())}), folder / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "text": pa.array([None] * len(labels), pa.string())}), folder / "labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([x[0] for x in vectors], pa.int64()), "embedding": pa.array([x[1] for x in vectors], pa.list_(pa.float32())), "label": pa.array([x[0] and x[0] % 3 for x in vectors], pa.int64()), "v": pa.array([None] * len(vectors), pa.date32())}), folder / "embeddings.parquet")
    return str(folder)


def odd_documents():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "delta-x", "42", "naïve", "end."]) + str(rng.randrange(60))
    passage = " ".join(word() for _ in range(60))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(900))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "!!! ???"), (8, "日本 語"), (9, "naïve text")]
    rows += [(10 + i, passage) for i in range(6)]
    rows += [(20 + i, f"{word()} {word()} {passage} {word()}\nsame line here, again and again, of many words {i}\n\n{word()}") for i in range(12)]
    rows += [(40, long), (41, long + " more"), (42, "ab " * 3000), (43, "x" * 50_000), (44, "<|endoftext|> <|startoftext|>  a"), (45, "A  b\n\n\nc\t\td \n")]
    rows += [(60 + i, " ".join(word() for _ in range(rng.randrange(1, 80)))) for i in range(20)]
    return rows


ITEMS = [("i1", None), ("i2", ""), ("i3", "..."), ("i4", "One TWO"), ("i5", "naïve"), ("i6", " ".join(f"w{i}" for i in range(30))), ("i6", " ".join(f"w{i}" for i in range(30)))]


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Tables of odd cases, with each doc_id once."""
    docs = odd_documents()
    passage = next(t for d, t in docs if d == 10)
    vectors = [(i, [float(i % 7), 1.0, float(i % 5) - 2]) for i in range(60)]
    vectors += [(80, None), (100, [0.0, 0.0, 0.0]), (120, [1.0, None, 2.0]), (140, [float("nan"), 1.0, 1.0]), (160, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0])]
    items = [*ITEMS, ("i7", " ".join(passage.split()[3:20]).upper())]
    labels = [(d, i % 2) for i, (d, _) in enumerate(docs)] + [(None, 1), (1, None), (999, 1)]
    return write(tmp_path_factory.mktemp("odd"), docs, items, labels, vectors)


@pytest.fixture(scope="session")
def repeated(tmp_path_factory):
    """The odd cases, with null and repeated doc_ids and repeated rows."""
    docs = odd_documents()
    docs += [(None, "no id at all, but some words"), (None, None), (4, "one"), (4, "another text of doc four"), (20, docs[12][1])]
    vectors = [(20, [1.0, 0.0])] * 3 + [(21, [1.0, 0.0])] * 2
    return write(tmp_path_factory.mktemp("repeated"), docs, ITEMS, [(4, 1), (4, 0)], vectors)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.fixture(scope="session")
def docs_of():
    def read(folder):
        t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
        return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))

    return read




@pytest.fixture(scope="session")
def line_links():
    """Pairs of lines that operator 6 puts into one group: each line with its group's first."""
    from paperloom.llm import lines
    from paperloom.llm.shared import keyed, written

    def links(df):
        distinct = written(lines.distinct_lines(keyed(df)), "lines")
        groups: dict = {}
        for r in distinct.join(lines.line_groups(distinct), ["h1", "h2"]).select("norm", "root").collect():
            groups.setdefault(bytes(r.root), []).append(r.norm)
        return [(g[0], x) for g in groups.values() for x in g[1:]]

    return links
