import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import json_text as j

CASES = [
    ('{"a": 1}', "direct", {"a": 1}),
    (" 12 ", "direct", 12),
    ('{"a": NaN, "a": 2}', "direct", {"a": 2}),
    ('Text\n```json\n{"a": [1]}\n```\nmore {x}', "fenced", {"a": [1]}),
    ("```\n[1, 2]\n```", "fenced", [1, 2]),
    ('```json\n{"a": [1, 2,],}\n```', "fenced, repaired", {"a": [1, 2]}),
    ('```json\n{"items": [{"k": 1}, {"k": 2}, {"k', "fence without end", {"items": [{"k": 1}, {"k": 2}]}),
    ('```json\n{"a": 1, "b": tru', "fence without end, repaired", {"a": 1}),
    ('Sure: {"a": {"b": "}"}} ok', "object", {"a": {"b": "}"}}),
    ('{"x": [{"a": 1}, {"a": 2', "object without end", {"x": [{"a": 1}]}),
    ('{"x": {"y": [1, 2], "z": "cut te', "object without end", {"x": {"y": [1, 2]}}),
    ('{"a": 1, "b": 2, "c": "cut', "object without end", {"a": 1, "b": 2}),
    ('{"a": "has ] and } in it", "b": 2, "c', "object without end", {"a": "has ] and } in it", "b": 2}),
    ('{"a": 12', "object without end", {"a": 12}),
    ("values [1, 2] done", "array", [1, 2]),
    ('[{"a": 1}, {"b": 2}] tail', "array", [{"a": 1}, {"b": 2}]),
    ("values [1, [2, 3], [4", "array without end", [1, [2, 3]]),
    ("values [1, 2, x", "repaired", [1, 2]),
    ("Here is 42", "prefix", 42),
    ('json\n"text"', "prefix", "text"),
    ('{"a": [1, 2, ], }', "repaired", {"a": [1, 2]}),
    ('{"a": "line\nbreak", "b": [tru', "repaired", {"a": "line\nbreak"}),
    ('{"only', None, None),
    ("nothing", None, None),
    ("", None, None),
    (None, None, None),
    ("[" * 100_000, None, None),
    ('{"a": "\\ud800"}', "direct", {"a": "\ud800"}),
]


@pytest.mark.parametrize("text, tier, value", CASES)
def test_each_tier(text, tier, value):
    found = j.extract(text)
    assert found[0] == tier
    assert found[1] is None if tier is None else json.loads(found[1]) == value


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_well_formed_values_come_back(value):
    for shown in (json.dumps(value), json.dumps(value, ensure_ascii=False), json.dumps(value, indent=1)):
        scan = j.Scan(shown)
        assert scan.whole and json.loads(scan.ended_at(scan.valued)) == value
        assert json.loads(j.extract(shown)[1]) == value


def within(part, whole):
    """Whether part is whole with something left out behind."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and within(v, whole[k]) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and len(part) <= len(whole) and all(within(a, b) for a, b in zip(part, whole, strict=False))
    return part == whole


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), VALUES, min_size=1, max_size=4), st.data())
def test_cut_values_keep_what_was_whole(value, data):
    text = json.dumps(value)
    cut = text[: data.draw(st.integers(1, len(text) - 1))]
    scan = j.Scan(cut)
    assert not scan.whole
    kept = scan.ended_at(scan.valued)
    if kept is not None and not (cut[-1].isdigit() or cut[-1] == "-"):  # a number may go on
        assert within(json.loads(kept), value)
    found = j.without_end(cut)
    assert found is None or isinstance(json.loads(found), dict)


@settings(max_examples=500, deadline=None)
@given(st.text('{}[]",:\\ a1`\n-tn', max_size=40))
def test_nothing_throws(text):
    tier, value = j.extract(text)
    assert (tier is None) == (value is None)
    assert value is None or json.loads(value) is not Ellipsis


def test_in_spark(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, text string")
    got = {r.id: r for r in df.select("id", F.inline(F.array(j.extracted(F.col("text"))))).withColumn("shown", F.to_json(j.parsed(F.col("json")))).collect()}
    for i, (text, _, _) in enumerate(CASES):
        assert (got[i].tier, got[i].json) == j.extract(text)
        assert (got[i].shown is None) == (got[i].json is None)


def test_lists_texts_and_continuations(spark):
    rows = [
        ('[{"a": 1}, 2]', 2, None, None),
        ('{"findings": [1, 2, 3], "text": "", "content": "c"}', 3, "c", None),
        ('{"items": [], "text": "t"}', 0, "t", None),
        ('{"status": "to_be_continued"}', 1, None, 0),
        ('{"status": "to_be_continued", "last_item_id": 7}', 1, None, 7),
        ('{"items": [{"id": 1}, {"id": 5, "status": "to_be_continued"}]}', 2, None, 5),
        ('{"items": [{"status": "to_be_continued"}]}', 1, None, 1),
        ("3", 0, None, None),
        (None, 0, None, None),
    ]
    v = j.parsed(F.col("t"))
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").orderBy("i")
    got = df.select(F.size(j.items(v, "findings", "items")), j.text_under(v, "text", "content"), j.continuation(v)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]
