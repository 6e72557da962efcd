from datetime import date

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as x


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("given", "expected"), [("Ação 10!", "acao 10"), ("a0b", "aob"), ("€ 5", "€ s"), ("", "")])
def test_for_matching(spark, given, expected):
    assert one(spark, x.for_matching(F.col("t")), t=given) == expected


def test_jaccard(spark):
    assert one(spark, x.jaccard(x.words(F.col("a")), x.words(F.col("b"))), a="a b c", b="b c d") == 0.5


def test_matches_have_the_offsets_of_the_text(spark):
    found = one(spark, x.matches(F.col("t"), x.DATES), t="12/03/2024 é ação 1.2.24 fim 01-01-2020")
    assert [m["start"] for m in found] == [0, 18, 29]
    assert one(spark, x.matches(F.col("t"), x.DATES), t="no date") == []


@pytest.mark.parametrize(("given", "expected"), [("€ 1.234,50", "1234.50"), ("abc", "abc")])
def test_amount(spark, given, expected):
    assert one(spark, x.amount(F.col("t")), t=given) == expected


@pytest.mark.parametrize(("given", "expected"), [("alta", 0.85), ("0.7", 0.7), ("1.4", 1.0), ("x", 0.5)])
def test_confidence(spark, given, expected):
    assert one(spark, x.confidence(F.col("t")), t=given) == expected


@pytest.mark.parametrize(("n", "expected"), [(19, "SEM_TEXTO"), (20, "SUSPEITA"), (199, "SUSPEITA"), (200, "OK")])
def test_page_status(spark, n, expected):
    assert one(spark, x.page_status(F.col("t")), t="a" * n) == expected


@pytest.mark.parametrize(("given", "expected"), [("Q1\n---\nQ2", ["Q1", "Q2"]), ("", []), ("  \n ", [])])
def test_questions(spark, given, expected):
    assert one(spark, x.questions(F.col("t")), t=given) == expected


def test_verdict_looks_for_the_negative_token_first(spark):
    assert one(spark, x.verdict(F.col("t")), t="é IMPROCEDENTE") == "IMPROCEDENTE"
    assert one(spark, x.verdict(F.col("t")), t="é procedente") == "PROCEDENTE"


def test_chunk_id(spark):
    assert one(spark, x.chunk_id(F.col("d"), F.col("i")), d="d", i="3") == "d_c0003"


@pytest.mark.parametrize(("given", "expected"), [("de 5/3/2001", date(2001, 3, 5)), ("de 5 de março de 2001", date(2001, 3, 5)), ("em 1999", date(1999, 1, 1)), ("nunca", None)])
def test_publication_date(spark, given, expected):
    assert one(spark, x.publication_date(F.col("t")), t=given) == expected


def test_fact_date_prefers_dates_behind_a_keyword(spark):
    t = "em 1/1/2001; celebrado a 2/2/2010"
    assert one(spark, x.fact_date(F.col("t"), ["celebrado"]), t=t) == date(2010, 2, 2)
    assert one(spark, x.fact_date(F.col("t"), ["assinado"]), t=t) == date(2001, 1, 1)


def test_citation(spark):
    c = one(spark, x.citation(F.col("t")), t="artigo 12.º-A do Código Civil, n.º 3, alínea b)")
    assert (c["article"], c["number"], c["clause"]) == ("12º-A", "3", "b)")


def test_table_rows(spark):
    assert one(spark, x.table_rows(F.col("t")), t="| a | b |\n|---|---|\n| 1 | 2 |\ntext") == [["a", "b"], ["1", "2"]]


def test_markers_and_cleaning(spark):
    assert one(spark, x.inject_markers(F.col("t")), t="a\fb") == "[Página 1]\na\n\n[Página 2]\nb"
    assert one(spark, x.accept_cleaned(F.col("a"), F.col("b")), a="abcd", b="a") == "abcd"


def test_marks_and_ligatures_do_not_change_the_hash(spark):
    for a, b in (("Škoda ý ﬁm", "Skoda y fim"), ("ŁÓDŹ  №5", "łodz no5"), ("Ǆ ½", "dž 1⁄2"), ("İstanbul", "istanbul"), ("ASCII, only!", "ascii only"), ("e\u0301te\u0301", "été")):
        assert one(spark, x.semantic_hash(F.col("t")), t=a) == one(spark, x.semantic_hash(F.col("t")), t=b)
    assert one(spark, x.for_matching(F.col("t"), False), t="Ÿ ﬁ É") == "y ﬁ e"
