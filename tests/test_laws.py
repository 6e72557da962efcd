import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.functions import laws
from paperloom.operators import legal
from paperloom.plans.laws import MENTIONS, named


def first_by_one(text):
    for i, (pattern, _) in enumerate(laws.LAWS):
        if m := re.search(pattern, text):
            return i, m.start()
    return None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*MENTIONS, "código", "processo", "cc", "ccc", "lei", "n.º 3/99", "dl", " da ", ",", "x"]), max_size=6).map(" ".join))
def test_one_pass_finds_what_trying_each_pattern_finds(text):
    found = laws._laws.search(text)
    assert (found and (found[0], found[1].start())) == first_by_one(text)


def test_each_pattern_has_its_law():
    assert {laws.law(m) for m in MENTIONS} == {named(m) for m in MENTIONS}
    assert {named(m) for m in MENTIONS} >= {n for _, n in laws.LAWS if "#" not in n}
    for (pattern, _), m in zip(laws.LAWS, MENTIONS, strict=True):
        assert re.search(pattern, m)


CASES = [
    ("artigo 12.º-A do Código Civil, n.º 3, alínea b)", ("Código Civil", "12º-A", "3", "b)", "Código Civil, artigo 12º-A, n.º 3, alínea b)")),
    ("art. 5 da Lei n. 7/2009", ("Lei n.º 7/2009", "5º", "7", None, "Lei n.º 7/2009, artigo 5º, n.º 7")),
    ("art. 5 da Lei n.º 7/2009", ("Diploma não especificado", "5º", "7", None, "Diploma não especificado, artigo 5º, n.º 7")),  # the pattern has one sign behind n
    ("Art. 483º CC, al. c)", ("Código Civil", "483º", None, "c)", "Código Civil, artigo 483º, alínea c)")),
    ("artigo 9 de algo", ("Diploma não especificado", "9º", None, None, "Diploma não especificado, artigo 9º")),
    ("decreto-lei 3/99 e CPC, art 1", ("Código de Processo Civil", "1º", None, None, "Código de Processo Civil, artigo 1º")),
    ("Código Civil", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("text, parts", CASES)
def test_normalised(text, parts):
    assert (laws.normalised(text) if text is not None else None) == parts


def test_in_spark(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i long, excerpt string")
    got = {r.i: (r.law, r.article, r.number, r.clause, r.normalised) for r in legal.normalised_citations(df).collect()}
    assert got == {i: p or (None,) * 5 for i, (_, p) in enumerate(CASES)}
    text = "Ver artigo 12.º, n.º 3 do Código Civil; e art. 5 CPC. E artigo 12.º, n.º 3 do Código Civil;\nCódigo Penal, artigo 4"
    found = legal.citations(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("citation").collect()
    assert [(r.doc_id, r.law, r.article, r.number) for r in found] == [(1, "Código Civil", "12º", "3"), (1, "Código de Processo Civil", "5º", None), (1, "Diploma não especificado", "4º", None), (1, "Código Civil", "5º", None)]
