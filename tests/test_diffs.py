import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.functions import line_diff
from paperloom.operators import diffs

LINES = st.lists(st.sampled_from("abcd"), max_size=14)


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def check(a, b):
    found = line_diff.matches(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found[:-1], found[1:], strict=True))
    return len(found)


@settings(max_examples=400, deadline=None)
@given(LINES, LINES)
def test_matches_are_a_longest_common_subsequence(a, b):
    assert check(a, b) == common(a, b)


def rebuilt(old, found):
    """The new text's lines, from the old ones and the changes."""
    lines = old.splitlines()
    replaced = {n: new for n, _, new, k in found if k not in ("removed", "inserted")}
    removed = {n for n, _, _, k in found if k == "removed"}
    out = []
    for n in range(1, len(lines) + 2):
        here = [new for m, _, new, k in found if k == "inserted" and m == n]
        out += here
        if n <= len(lines) and n not in removed:
            out.append(replaced.get(n, lines[n - 1]))
    return out


@pytest.mark.parametrize("long", [2000, 5])
def test_random_edits_are_told_apart(monkeypatch, long):
    monkeypatch.setattr(line_diff, "LONG", long)
    rng = random.Random(long)
    for _ in range(60):
        old = [f"line {rng.randrange(30)} of words" for _ in range(rng.randrange(60))]
        new = []
        for x in old:
            new += rng.choice([[x]] * 8 + [[], [x + "!"], [x, "added"]])
        found = list(line_diff.changes("\n".join(old), "\n".join(new)))
        assert rebuilt("\n".join(old), found) == new
        assert check(old, new) <= common(old, new)
        for n, before, after, kind in found:
            assert kind in ("removed", "inserted") or line_diff.kind(before, after) == kind
            assert kind == "inserted" or old[n - 1] == before


def test_far_changes_in_a_long_text():
    old = [f"line {i}" for i in range(60_000)]
    new = [x for i, x in enumerate(old) if i % 1000 != 7]
    new[31_000] += "?"
    found = list(line_diff.changes("\n".join(old), "\n".join(new)))
    assert sorted(x[3] for x in found) == ["fix_punctuation"] + ["removed"] * 60


def test_kinds(spark):
    cases = [("a b", "a  b", "fix_spacing"), ("a b", "a, b!", "fix_punctuation"), ("caf? 12", "café 12", "fix_encoding"), ("cost 12", "cost 13", "fix_word"), ("x", "", "removed")]
    for old, new, kind in cases[:-1]:
        assert line_diff.kind(old, new) == kind
    rows = [(i, f"same\n{o}\nsame too", f"same\n{n}\nsame too" if n else "same\nsame too") for i, (o, n, _) in enumerate(cases)]
    rows += [(90, None, None), (91, "a", None), (92, None, "b\nc"), (None, "x y", "x  y"), (93, "same", "same")]
    got = sorted(((r.doc_id, r.change, r.line_num, r.change_type) for r in diffs.line_changes(spark.createDataFrame(rows, "doc_id long, original string, cleaned string")).collect()), key=str)
    want = [(i, 0, 2, k) for i, (*_, k) in enumerate(cases)] + [(91, 0, 1, "removed"), (92, 0, 1, "inserted"), (92, 1, 1, "inserted"), (None, 0, 1, "fix_spacing")]
    assert got == sorted(want, key=str)
