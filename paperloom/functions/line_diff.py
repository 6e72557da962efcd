"""Differences of two texts line by line (X17): what tasks run on one pair of texts.

The alignment is a longest common subsequence of lines, by Myers' middle snakes (1986): time is the number of lines times that
of differences, memory their sum. Texts of over LONG lines are first cut at lines that both have just once, in their longest
order, so that far apart changes don't meet; there, a common line that would cross such a cut isn't matched.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

LONG = 2000


def _middle(a: Sequence, b: Sequence) -> tuple[int, int, int, int]:
    """The ends (x, y, u, v) of a run of equal lines, perhaps none, in the middle of a shortest path."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or k != d and ahead[k - 1] < ahead[k + 1] else ahead[k - 1] + 1
            u, v = x, x - k
            while u < n and v < m and a[u] == b[v]:
                u, v = u + 1, v + 1
            ahead[k] = u
            if delta % 2 and abs(delta - k) < d and u + back[delta - k] >= n:
                return x, x - k, u, v
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back[k - 1] < back[k + 1] else back[k - 1] + 1
            u, v = x, x - k
            while u < n and v < m and a[n - 1 - u] == b[m - 1 - v]:
                u, v = u + 1, v + 1
            back[k] = u
            if not delta % 2 and abs(delta - k) <= d and u + ahead[delta - k] >= n:
                return n - u, m - v, n - x, m - x + k
    raise AssertionError("a path always meets")


def _anchors(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Lines that both have once, as places in both that ascend together, as many as can be."""
    once_a, once_b = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    pairs = [(i, place[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in place]
    tails: list[int] = []  # of ascending runs by length: the least last place, and which pair it is
    at: list[int] = []
    before = [-1] * len(pairs)
    for p, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        tails[n : n + 1], at[n : n + 1] = [j], [p]
        before[p] = at[n - 1] if n else -1
    out, p = [], at[-1] if at else -1
    while p >= 0:
        out.append(pairs[p])
        p = before[p]
    return out[::-1]


def matches(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (i, j) of lines that stay, ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    if max(len(a), len(b)) > LONG:
        cuts = _anchors(a, b)
        edges = [(-1, -1), *cuts, (len(a), len(b))]
        todo = [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
        out += cuts
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i < k and j < m:
            x, y, u, v = _middle(a[i:k], b[j:m])
            out += [(i + x + n, j + y + n) for n in range(u - x)]
            todo += [(i, i + x, j, j + y), (i + u, k, j + v, m)]
    return sorted(out)


def kind(old: str, new: str) -> str:
    """What changed in a line: only spaces, only signs, letters but no digits, or more."""
    if old.replace(" ", "") == new.replace(" ", ""):
        return "fix_spacing"
    word = lambda x: "".join(c for c in x if c.isalnum())
    digits = lambda x: "".join(c for c in x if c.isdigit())
    if word(old) == word(new):
        return "fix_punctuation"
    return "fix_encoding" if digits(old) == digits(new) else "fix_word"


def changes(old: str, new: str) -> Iterator[tuple[int, str, str, str]]:
    """(line_num in the old text, from 1; old line; new line; kind) of each change, in order. Between lines that stay, old
    and new lines pair up in order; what is left over is removed or inserted."""
    a, b = old.splitlines(), new.splitlines()
    i = j = 0
    for k, m in [*matches(a, b), (len(a), len(b))]:
        both = min(k - i, m - j)
        for n in range(both):
            yield i + n + 1, a[i + n], b[j + n], kind(a[i + n], b[j + n])
        for n in range(i + both, k):
            yield n + 1, a[n], "", "removed"
        for n in range(j + both, m):
            yield i + both + 1, "", b[n], "inserted"
        i, j = k + 1, m + 1
