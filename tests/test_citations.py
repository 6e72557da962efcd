"""Places of excerpts against a scan of all windows, and the statuses of citations."""

import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import places
from paperloom.operators import citations

LEAST = Fraction(85, 100)


def lcs_by_length(excerpt, text):
    """LCS with each prefix of text, by bit vectors."""
    masks = {c: sum(1 << i for i, x in enumerate(excerpt) if x == c) for c in set(excerpt)}
    full, v = (1 << len(excerpt)) - 1, (1 << len(excerpt)) - 1
    for c in text:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
        yield len(excerpt) - v.bit_count()


def scan(text, excerpt, least):
    """All windows, best first, without overlaps."""
    if len(excerpt) < places.SHORTEST or len(text) < len(excerpt):
        return []
    text, excerpt = places.folded(text), places.folded(excerpt)
    found = []
    for s in range(len(text)):
        for n, common in enumerate(lcs_by_length(excerpt, text[s : s + 2 * len(excerpt)]), 1):
            ratio = Fraction(2 * common, len(excerpt) + n)
            if ratio >= least:
                found.append((-ratio, s, s + n))
    out = []
    for r, s, e in sorted(found):
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, -r))
    return out


def mutated(rng, x, n):
    x = list(x)
    for _ in range(n):
        at = rng.randrange(len(x))
        x[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [x[at], "q"], [x[at].upper()]])
    return "".join(x)


@pytest.mark.parametrize("least", [LEAST, Fraction(7, 10), Fraction(95, 100)])
@pytest.mark.parametrize("letters", ["ab", "abcde ", "abcdefghijklmnopqrstuvwxyz   "])
def test_near_places_are_those_of_a_scan_of_all_windows(letters, least):
    rng = random.Random(f"{letters}{least}")
    for _ in range(12):
        excerpt = "".join(rng.choice(letters) for _ in range(rng.choice([8, 12, 20, 29, 64, 90])))
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(4)]
        text = "".join(p + mutated(rng, excerpt, k) for p, k in zip(parts, (1, 2, 4, 9), strict=True))
        assert places.near(text, excerpt, least) == scan(text, excerpt, least)
        assert places.near(text, excerpt, least, 1) == scan(text, excerpt, least)[:1]


@settings(max_examples=80, deadline=None)
@given(st.text("abİß é", max_size=60), st.text("abİß é", max_size=20))
def test_near_places_of_any_text(text, excerpt):
    assert places.near(text, excerpt, LEAST) == scan(text, excerpt, LEAST)


def test_long_excerpts_and_long_texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(20_000))
    at = 60_000
    excerpt = text[at : at + 800]
    assert places.near(text, excerpt[:300] + "#" + excerpt[301:], LEAST) == [(at, at + 800, Fraction(2 * 799, 1600))]
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(50_000))
    excerpt = mutated(rng, letters[20_000:20_200], 12)
    search = places.Search.many([(places._codes(letters), places._codes(excerpt))], LEAST)[0]
    assert sum(b - a for a, b in search.stretches) < 2_000
    assert [x[2] for x in places.near(letters, excerpt, LEAST)] == [x[2] for x in scan(letters[19_000:21_000], excerpt, LEAST)]


TEXT = "The first page says little.\nPayment of 500 EUR is due on 1 May.\nThe second page: PAYMENT OF 500 EUR IS DUE on 1 May, twice. İx abc def ghi jkl"
PAGES = [(1, 0, 28), (2, 28, 64), (3, 64, len(TEXT))]
CASES = [
    ("a", "Payment of 500 EUR is due", 2, "VALID_EXACT", 28, 2),
    ("b", "payment of 500 eur is due", 2, "VALID_EXACT", 28, 2),
    ("c", "payment of 500 eur is due", None, "INVALID_AMBIGUOUS", 28, 2),
    ("d", "The second page", 1, "PAGE_MISMATCH", 64, 3),
    ("e", "The second page", 9, "PAGE_MISMATCH", 64, 3),
    ("f", "The frst page says litle", 1, "VALID_FUZZY", 0, 1),
    ("g", "The frst page says litle", 3, "PAGE_MISMATCH", 0, 1),
    ("h", "abc def ghi jkl", 3, "VALID_EXACT", TEXT.index("abc"), 3),
    ("i", " \n ", 1, "INVALID", None, None),
    ("j", None, 1, "INVALID", None, None),
    ("k", "nothing like this anywhere", 1, "INVALID", None, None),
    ("l", "frst", 1, "INVALID", None, None),
]


def test_statuses(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    pages = spark.createDataFrame([(1, *p) for p in PAGES], "doc_id long, page_num long, page_start long, page_end long")
    given_rows = [(1, i, e, p) for i, e, p, *_ in CASES] + [(2, "m", "Payment", 1), (3, "n", "Payment", 1), (None, "o", "Payment", 1)]
    cited = spark.createDataFrame(given_rows, "doc_id long, item_id string, excerpt string, page_num long")
    got = {r.item_id: (r.status, r.start, r.page_num) for r in citations.checked(docs, pages, cited).collect()}
    assert got == {i: (status, at, page) for i, _, _, status, at, page in CASES} | {i: ("INVALID", None, None) for i in "mno"}


def test_many_citations_of_one_document_are_many_groups(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    cited = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("item_id"), F.lit("payment of 500 eur was due").alias("excerpt"), F.lit(2).cast("long").alias("page_num"))
    assert citations._grouped(docs, None, cited).count() >= 14
    found = citations.near_places(docs, cited)
    assert found.count() == 2 * 1000 and found.select("item_id").distinct().count() == 1000
    want = scan(TEXT, "payment of 500 eur was due", LEAST)
    assert sorted({(r.start, r.end, round(r.ratio, 9)) for r in found.collect()}) == sorted((s, e, round(float(x), 9)) for s, e, x in want)


def test_scores_of_auditors(spark):
    rows = [("A", s) for s in ("VALID_EXACT", "PAGE_MISMATCH", "INVALID", "INVALID_AMBIGUOUS")] + [("B", "VALID_FUZZY")]
    out = citations.auditor_scores(spark.createDataFrame(rows, "auditor_id string, status string")).orderBy("auditor_id").collect()
    assert [tuple(r) for r in out] == [("A", 4, 2, 1, 1, 1, 0.5), ("B", 1, 1, 0, 0, 0, 1.0)]


def near_places_and_sql(spark, tmp_path, texts):
    """Rows of j17_near_places and of its SQL, by doc_id."""
    from paperloom import catalogue
    from tests.compare import duckdb

    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ours = catalogue.QUERIES["j17_near_places"](spark, str(tmp_path)).collect()
    return {r.doc_id: tuple(r) for r in ours}, {r[0]: r for r in c.execute(catalogue.SQL["j17_near_places"]).fetchall()}


def prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n))


def test_near_places_of_odd_ends_are_those_of_the_sql(spark, tmp_path):
    # A final sigma, other white space and line ends at the ends of the 60 characters that are cited.
    texts = [prose(i, 80) + x[0] + prose(i + 50, 60 - len(x[0]) - len(x[1])) + x[1] + "αβ" + prose(i, 200) for i, x in enumerate([("ab", "αβΣ"), ("\u00a0a", "b"), ("a", "b\u00a0"), ("a", "b \u2028"), ("\x0ba", "b\x0c"), ("ab", "b\t\n")])]
    ours, theirs = near_places_and_sql(spark, tmp_path, texts)
    assert ours == theirs and len(ours) == len(texts)


def test_words_repeated_beside_another_are_nearer_or_as_near_before_the_place_of_the_sql(spark, tmp_path):
    # The SQL takes the place of the excerpt before its 30th character was changed, and doesn't search for a better one.
    texts = ["x" + "De " * 36 + "Te " * 60, "he " + "The " * 26 + "Thee " * 40]
    ours, theirs = near_places_and_sql(spark, tmp_path, texts)
    for i, text in enumerate(texts):
        excerpt = text[80:140].strip()
        s, e, ratio = scan(text, excerpt[:29] + "#" + excerpt[30:], LEAST)[0]
        assert ours[i][2:] == (s, e, float(ratio))
        assert ours[i] != theirs[i] and ours[i][4] >= theirs[i][4] and ours[i][2] < theirs[i][2]
