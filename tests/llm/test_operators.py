"""Each numbered query against a plain version, over test tables and odd cases."""

import hashlib
import random
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperloom.llm import catalogue, decontaminate, length_histogram, lines, near_duplicates, neighbours, packing, perfect_hash, quality, shared, substrings, token_files, tokens
from tests.compare import both, connection
from tests.llm import brute
from tests.llm.conftest import SF

QUERIES = catalogue.queries()
COLUMNS = {
    "op1_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def items_of(folder):
    t = pq.read_table(f"{folder}/benchmark.parquet")
    return list(zip(map(str, t["item_id"].to_pylist()), t["text"].to_pylist(), strict=True))


@pytest.mark.parametrize("name", list(QUERIES))
def test_repeated_and_null_ids_and_empty_tables(spark, repeated, empty, docs_of, name):
    n = QUERIES[name](spark, repeated).count()
    if name not in ("op2_neighbours", "op8_packing", "op9_length_histogram", "op13_hard_negatives"):
        assert n == len(docs_of(repeated))
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("where", ["sf", "odd"])
@pytest.mark.parametrize("name", list(COLUMNS))
def test_exact_queries(spark, odd, docs_of, name, where):
    folder = {"sf": SF, "odd": odd}[where]
    docs = docs_of(folder)
    plain = {"op1_token_files": lambda: brute.token_rows(docs), "op3_substring_dedup": lambda: brute.substring_rows(docs), "op4_decontaminate": lambda: brute.decontamination_rows(docs, items_of(folder))}[name]
    assert rows(QUERIES[name](spark, folder), COLUMNS[name]) == sorted(plain(), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    ours, theirs = both(spark, connection(SF), QUERIES[name], catalogue.oracle_sql()[name], SF)
    assert ours == theirs


def test_token_index_knows_only_its_keys(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i * 7, f"text {i}") for i in range(500)], "doc_id long, text string")
    files = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)
    wanted = spark.createDataFrame([(i,) for i in range(0, 4000)], "doc_id long")
    assert token_files.read(files, wanted).count() == 500
    assert files.buckets.agg(F.sum("n_keys")).first()[0] == 500


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    sizes, bits = perfect_hash.build(keys)
    assert sorted(perfect_hash.PerfectHash(sizes, bits).slots(keys)) == list(range(len(keys)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_short_ways_of_the_encoder(name):
    import public_tokenizers

    texts = ["", " ", "a", " a", "a  b", "a \n b", "\n\na", "Don't stop. it's 12,345!", "naïve café", "ß İ ǅ", "日本語 テキスト", "<|endoftext|>x", "one <|endoftext|> two", "a<|startoftext|>  b <|ENDOFTEXT|>", "tab\tx  ", "end.\nNext;\n\nline", " x   y", "é́ a", "ÀÉÎ õ", "a" * 100, "x\r\ny", "ª º µ"]
    plain, fast = brute.encoder(name), tokens.Encoder(public_tokenizers.path(name))
    for _ in range(2):
        got = [np.frombuffer(x, fast.width).tolist() for x in fast.encode(texts)]
        assert got == [plain(t) for t in texts]


def test_substrings_in_hot_buckets(spark, odd, docs_of):
    docs = docs_of(odd)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size, bucket in ((35, 2), (9, 3)):
        got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.dedup(df, size, bucket).collect()]
        assert sorted(got) == sorted(brute.substring_rows(docs, size))


def test_decontamination_in_blocks(spark, odd, docs_of):
    docs = spark.createDataFrame(docs_of(odd), "doc_id long, text string")
    items = spark.createDataFrame(items_of(odd), "item_id string, text string")
    one, many = (rows(decontaminate.decontaminate(docs, items, block_windows=n), ["doc_id", "n_words", "items"]) for n in (100_000, 5))
    assert one == many


def test_similar_lines_are_those_of_the_edit_distance_and_half_are_settled_by_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    pairs = [("", "a"), ("a b", "a"), ("abcde", "abcdf"), ("a", "a")]
    for _ in range(400):
        line = [rng.choice(words) for _ in range(rng.randrange(1, 40))]
        other = list(line)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(other)) if other else 0
            other[at : at + 1] = rng.choice([[rng.choice(words)], [rng.choice(words)], [], [rng.choice(words), *other[at : at + 1]]])
        pairs.append((" ".join(line), " ".join(other)))
    a, b = F.col("a"), F.col("b")
    longer = F.greatest(F.length("a"), F.length("b"))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein(a, b).alias("d"), longer.alias("n"), lines._edits_by_words(a, b).alias("most"), lines.similar(a, b).alias("similar")).collect()
    assert all(r.most >= r.d and r.similar == (10 * r.d <= 2 * r.n) for r in got)
    assert sum(r.most <= 0.2 * r.n for r in got) > 0.5 * sum(r.similar for r in got) > 50


def test_similar_lines_with_words_put_in_and_left_out_are_settled_between_anchors(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeéß𝔞") for _ in range(rng.randrange(3, 9)))
    pairs = [("", "a"), ("a", ""), ("a" * 200, "a" * 190), ("ab" * 100, "ba" * 100), ("x" * 500, "y" * 500)]
    for i in range(300):
        line = [word() for _ in range(rng.randrange(1, 120))]
        other = list(line)
        for _ in range(len(line) // 12 + 2):
            at = rng.randrange(len(other)) if other else 0
            other[at : at + 1] = rng.choice([[], [word(), *other[at : at + 1]], [word()]])
        pairs.append((" ".join(line), " ".join(other if i % 5 else [word() for _ in line])))
    a, b = F.col("a"), F.col("b")
    longer = F.greatest(F.length("a"), F.length("b"))
    most = F.floor(longer * 0.2 + 1e-9).cast("int")
    settled = lines._edits_by_anchors(a, b, most), lines._edits_by_words(a, b), lines.similar(a, b)
    got = spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein(a, b).alias("d"), most.alias("most"), *(c.alias(n) for n, c in zip(("anchors", "words", "similar"), settled, strict=True))).collect()
    assert all(r.anchors >= min(r.d, r.most + 1) and r.similar == (r.d <= r.most) for r in got)
    left = [r for r in got if r.similar and r.words > r.most]
    print("lines that words don't settle:", len(left), "between anchors", sum(r.anchors <= r.most for r in left))
    assert sum(r.anchors <= r.most for r in left) > 0.7 * len(left) > 50


def test_neighbours_find_nine_tenths(spark):
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), np.float64)
    got = QUERIES["op2_neighbours"](spark, sf).toPandas()
    found = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = got[got.query_id == ids[q]].sort_values("rank")
        sims = x @ x[q]
        sims[q] = -np.inf
        assert list(mine["rank"]) == list(range(1, 21))
        assert np.allclose(mine.score, [sims[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], rtol=1e-12)
        assert (np.diff(mine.score) <= 0).all()
        best = np.lexsort((ids, -sims))[:20]
        found, total = found + len({*ids[best]} & {*mine.vec_id}), total + 20
    assert found >= 0.9 * total


def test_neighbours_of_few_and_odd_vectors(spark, odd, repeated):
    got = QUERIES["op2_neighbours"](spark, odd).collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    assert all(r.vec_id is not None and r.vec_id < 60 and r.vec_id != r.query_id for r in got)
    assert {r.vec_id for r in QUERIES["op2_neighbours"](spark, repeated).collect()} == {21}
    few = spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    base = neighbours.vectors(few)
    assert rows(neighbours.search(base, base.where("vec_id = 20")), ["query_id", "rank", "vec_id", "score"]) == [(20, 1, 1, 3.0), (20, 2, 2, 3.0)]


def test_neighbours_deal_and_find_rows_by_queries_not_by_probed_parts():
    rng = np.random.default_rng(1)
    n_parts, k, n, n_queries = 64, 5, 9000, 40
    x = np.round(rng.normal(size=(n, 8)), 1)
    x[100:4500] = x[99]  # copies, which tie
    part = rng.integers(0, n_parts, n)
    ids = rng.permutation(n) + 1
    x[-200:], ids[-200:], part[-200:] = x[:200], ids[:200], part[::-1][:200]  # vec_ids in several parts
    probed = [rng.choice(n_parts, 48, replace=False) for _ in range(n_queries)]
    asked = [(0, 0, -1, int(ids[i]), x[i].tobytes(), probed[i].tolist()) for i in range(n_queries)]
    passing = sorted((0, 0, int(p), int(i), v.tobytes(), None) for p, i, v in zip(part, ids, x, strict=True))
    types = zip(("slice", "qb", "part", "vec_id", "v", "parts"), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)
    table = pa.table({c: pa.array(v, t) for (c, t), v in zip(types, zip(*asked, *passing, strict=True), strict=True)})
    found = pa.Table.from_batches(neighbours._searcher(k, n_parts)(table.to_batches(1000))).to_pandas()
    assert len(found) == n_queries * k
    for i in range(n_queries):
        best = {}
        for j in np.flatnonzero(np.isin(part, probed[i]) & (ids != ids[i])):
            score = float((x[j] * x[i]).sum())
            best[int(ids[j])] = max(score, best.get(int(ids[j]), score))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
        assert list(found[found.query_id == ids[i]][["vec_id", "score"]].itertuples(index=False, name=None)) == want
    weights = [rng.normal(size=s) for s in ((8, 4), (4,), (4, n_parts), (n_parts,))]
    shared = SimpleNamespace(value=neighbours.Router(weights, 1.0, 48))
    base = pa.record_batch({"vec_id": pa.array(ids), "v": pa.array(list(x))})
    assert sum(b.num_rows for b in neighbours._dealer(shared, 48)([base])) == n


def test_neighbours_of_repeated_rows_and_few_candidates(spark):
    rng = np.random.default_rng(8)
    made = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(100)]
    made += [made[20]] * 4 + [made[33]] * 30 + [(35, [9.0, 9.0, 9.0, 9.0])]
    few = [m for m in made if m[0] < 15] + [made[0]] * 5
    for table, n in ((made, 20), (few, 14)):
        base = neighbours.vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>"))
        got = neighbours.search(base, base.where("vec_id % 20 = 0"), 20).toPandas()
        for q in {v for v, _ in table if v % 20 == 0}:
            best: dict = {}
            for v, x in table:
                if v != q:
                    best[v] = max(best.get(v, -np.inf), float(np.dot(x, dict(table)[q])))
            mine = got[got.query_id == q].sort_values("rank")
            assert list(mine["rank"]) == list(range(1, n + 1))
            assert len({*mine.vec_id}) == n
            assert np.allclose(mine.score, [best[v] for v in mine.vec_id])
            assert len({*mine.vec_id} & {*sorted(best, key=lambda v: (-best[v], v))[:n]}) >= 0.9 * n


def test_quality_on_rows_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op5_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    held = out.join(labels, F.col("doc_id") == F.col("id")).where("held_out").toPandas()
    right = (held.predicted == held.quality).mean()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    ranked = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    print("quality: accuracy", right, "AUC", ranked)
    assert right > 0.9 and ranked > 0.9
    assert out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()


def test_quality_needs_no_labels(spark, empty):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.quality_score for r in quality.scored(docs, quality.fit(docs, none)).collect()] == [0.5, 0.5]


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_line_dedup_removes_what_is_linked(spark, odd, docs_of, line_links, where):
    docs = sorted(docs_of({"sf": SF, "odd": odd}[where]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(lines.dedup(df), ["doc_id", "n_lines", "n_removed", "text"])
    assert got == sorted(((d, *x) for (d, _), x in zip(docs, brute.deduped_lines(docs, line_links(df)), strict=True)), key=str)


def test_line_dedup_keeps_no_texts_of_lines_that_meet_nothing(spark, monkeypatch):
    held, similar = [], lines._similar

    def seen(pairs, texts):
        folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
        held.append((len(list(folder.glob("lines-????????*/*.parquet"))) - before, texts.count()))
        return similar(pairs, texts)

    shared.shared_dir(spark)
    before = len(list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("lines-????????*/*.parquet")))
    monkeypatch.setattr(lines, "_similar", seen)
    alone = [(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(20)]
    near = [(100 + i, f"one line of many words that is almost the same as others {i}") for i in range(3)]
    got = rows(lines.dedup(spark.createDataFrame(alone + near, "doc_id long, text string")), ["doc_id", "n_removed"])
    assert sum(n for _, n in got) == 2
    assert held and all(h == (0, 3) for h in held)


def test_line_dedup_tests_no_pair_twice(spark, monkeypatch):
    tested, similar = [], lines._similar

    def seen(pairs, texts):
        tested.append({(bytes(r.a), bytes(r.b)) for r in pairs.collect()})
        return similar(pairs, texts)

    monkeypatch.setattr(lines, "_similar", seen)
    texts = [f"common passage everywhere {c * 12} {chr(ord(c) + 1) * 9} {c * 7}" for c in "abcdefghijkl"]
    texts += ["common passage everywhere \t and then\x0b the  same words again", "Common passage everywhere and then the same words again!"]
    got = rows(lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), ["doc_id", "n_removed"])
    assert dict(got) == {i: int(i == 13) for i in range(14)}
    assert len(tested) == 2 and all(tested) and not tested[0] & tested[1]


def planted_lines():
    """Lines, and variants of them with a word replaced, left out, put in or marked."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(2, 11)))
    out = []
    for i in range(120):
        w = [word() for _ in range(8 + i % 24)]
        at = int(rng.integers(0, len(w)))
        changed = [w[:at] + [word()] + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + [word()] + w[at:], w[:at] + [w[at] + "!!"] + w[at + 1 :]][i % 4]
        out += [" ".join(w), " ".join(changed)]
    return out


@pytest.mark.parametrize("where", ["sf", "planted"])
def test_line_dedup_links_nine_tenths_of_similar_lines_and_no_others(spark, docs_of, line_links, where):
    docs = sorted(docs_of(SF)) if where == "sf" else list(enumerate(planted_lines()))
    docs = [(d, "\n".join(x for x in (t or "").split("\n") if len(x) < 150)) for d, t in docs]  # for the plain version
    order = list(dict.fromkeys(x for _, t in docs for x in map(brute.normal_line, t.split("\n")) if x))
    pairs = [(order.index(a), order.index(b)) for a, b in brute.similar_lines(order)]
    whole = brute.union_find(len(order), pairs)
    found = [(order.index(a), order.index(b)) for a, b in line_links(spark.createDataFrame(docs, "doc_id long, text string"))]
    assert all(whole[i] == whole[j] for i, j in found)
    roots = brute.union_find(len(order), found)
    share = sum(roots[i] == roots[j] for i, j in pairs) / len(pairs)
    print("lines:", len(pairs), "pairs, recall", share)
    assert share >= 0.9


def spread_changes():
    """Pairs of similar lines of 2 to 150 words, of which a tenth, evenly spread, and one at least, is changed by a letter,
    replaced, left out, or has a word before it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(5, 12)))
    pairs = []
    for i in range(120):
        n = [2, 3, 4, 5, 7, 9, 12, 15, 20, 30, 50, 80, 110, 150][i % 14]
        line, other = [word() for _ in range(n)], []
        at = {n * (2 * j + 1) // (2 * max(1, n // 10)) for j in range(max(1, n // 10))}
        for j, w in enumerate(line):
            other += [w] if j not in at else [w[:-1] + "x"] if n < 6 or i % 4 == 0 else [[word()], [], [word(), w]][i % 3]
        pairs.append((" ".join(line), " ".join(other)))
    return [(a, b) for a, b in pairs if brute.edits(a, b) <= 0.2 * max(len(a), len(b))]


def test_line_dedup_links_all_similar_lines_of_which_a_tenth_of_the_words_is_changed(spark, line_links):
    pairs = spread_changes()
    docs = spark.createDataFrame(list(enumerate(x for p in pairs for x in p)), "doc_id long, text string")
    found = {frozenset(p) for p in line_links(docs)}
    assert len(pairs) > 100 and found == {frozenset(p) for p in pairs}


def test_keys_of_lines_are_the_first_runs_by_one_order(spark):
    words = [[f"{'w' * (i % 9)}{i}x{j}" for i in range(n)] for j, n in enumerate((1, 2, 5, 8, 15, 16, 40, 200))]
    keys = [set(r.keys) for r in spark.createDataFrame([(w,) for w in words], "words array<string>").select(lines._run_keys(F.col("words")).alias("keys")).collect()]
    assert [len(k) for k in keys] == [1, 3, 5, 6, 13, 6, 13, 61]
    runs = [(words[-1][i : i + 3],) for i in range(198)]
    each = [r.keys[0] for r in spark.createDataFrame(runs, "words array<string>").select(lines._run_keys(F.col("words")).alias("keys")).collect()]
    letters = lambda i: min(30, sum(map(len, words[-1][i : i + 3])))
    chosen = [letters(i) for i in range(198) if each[i] in keys[-1]]
    assert len(chosen) == 61 and min(chosen) >= max(letters(i) for i in range(198) if each[i] not in keys[-1])


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("where", ["sf", "odd"])
def test_near_duplicates(spark, odd, docs_of, where, size):
    docs = sorted(docs_of({"sf": SF, "odd": odd}[where]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(near_duplicates.groups(df, size=size), ["_k", "n", "first._k"])
    assert got == sorted(((d, n, docs[r][0]) for (d, _), (n, r) in zip(docs, brute.near_duplicates(docs, size), strict=True)), key=str)


def test_near_duplicates_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(40)]
    docs = []
    for d in range(60):
        w = list(base)
        for i in rng.integers(0, 40, d % 5):
            w[i] = f"x{d}-{i}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(near_duplicates.groups(df, size=2), ["_k", "n", "first._k"])
    assert got == sorted(((d, n, docs[r][0]) for (d, _), (n, r) in zip(docs, brute.near_duplicates(docs, 2), strict=True)), key=str)


@pytest.mark.parametrize("where", ["sf", "odd", "repeated"])
def test_packing(spark, odd, repeated, docs_of, where):
    folder = {"sf": SF, "odd": odd, "repeated": repeated}[where]
    encode, got = brute.encoder("word_bpe_49k.json"), QUERIES["op8_packing"](spark, folder).collect()
    wanted = []
    for d, t in docs_of(folder):
        ids = [*encode(t), 1]
        wanted += [(d, k, at, len(ids[at : at + 4096]), brute.crc(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(wanted, key=str)
    reach: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == reach.get(r.sequence_id, 0)
        reach[r.sequence_id] = r.offset + r.length
    assert max(reach.values()) <= 4096
    assert len(reach) <= max(-(-sum(reach.values()) // 4096) + 1, sum(v > 2048 for v in (w[3] for w in wanted)))


def test_plan_is_as_good_as_best_fit_on_documents():
    rng = np.random.default_rng(2)
    lengths = np.sort(np.minimum(4096, rng.lognormal(6, 1, 3000).astype(int) + 1))[::-1]
    bins: list = []
    for x in lengths:
        fits = [i for i, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(4096 - x)
    values, n = np.unique(lengths, return_counts=True)
    entries, sequences = packing.plan(dict(zip(values.tolist(), n.tolist(), strict=True)), 4096)
    assert sum(e[2] for e in entries) == 3000
    assert sequences <= len(bins) * 1.005 + 1


@pytest.mark.parametrize("where", ["sf", "odd", "repeated"])
def test_length_histogram(spark, odd, repeated, docs_of, where):
    folder = {"sf": SF, "odd": odd, "repeated": repeated}[where]
    sums = QUERIES["op9_length_histogram"](spark, folder)
    columns = ["length", "n_docs", "n_longer", "total_tokens", "truncated_tokens", "lost_tokens", "share_at_most"]
    docs = docs_of(folder)
    plain = list(brute.lengths(docs))
    assert rows(sums, columns) == sorted(plain, key=str)
    got = {r.context_limit: r for r in length_histogram.at_limits(sums, [1, 100, 10**6]).collect()}
    for limit in (1, 100, 10**6):
        assert got[limit].truncated_tokens == sum(min(x[0], limit) * x[1] for x in plain)
        assert got[limit].n_longer == sum(x[1] for x in plain if x[0] > limit)
    each = sorted(x for p in plain for x in [p[0]] * p[1])
    assert length_histogram.quantile(sums, 0.5).first()[0] == each[-(-len(each) // 2) - 1]


def test_language_on_rows_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op10_language"](spark, sf)
    langs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    held = out.join(langs, F.col("doc_id") == F.col("id")).where("held_out and lang is not null").toPandas()
    right = (held.lang_pred == held.lang).mean()
    print("language: accuracy", right)
    assert right > 0.93
    assert out.where("score < 0 or score > 1").isEmpty()


def test_texts_without_letters_have_no_language(spark, odd):
    got = {r.doc_id: r for r in QUERIES["op10_language"](spark, odd).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 3, 7))
    assert {r.lang_pred for d, r in got.items() if d not in (1, 2, 3, 7)} <= {"en", "de"}
