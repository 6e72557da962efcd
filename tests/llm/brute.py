"""Plain versions of the numbered operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def encoder(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def token_rows(docs):
    """docs: (doc_id, text), of distinct doc_ids."""
    encode, start = encoder("byte_bpe_50k.json"), 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = [*encode(text), 0]
        yield doc_id, start, len(ids), crc(ids)
        start += len(ids)


def substring_rows(docs, size=35):
    words = [SPACED.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def decontamination_rows(docs, items, size=10):
    windows: dict = {}
    for item_id, text in items:
        w = ALNUM.findall(ascii_lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    sizes = {len(x) for x in windows}
    for doc_id, text in docs:
        w, hit, found = ALNUM.findall(ascii_lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def union_find(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, size):
    w = SPACED.findall(ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else (tuple(w[i : i + size]) for i in range(len(w) - size + 1)))


def near_duplicates(docs, size):
    """For each document (in the order of docs): its number of shingles and the first document that can be reached."""
    sets = [shingles(t, size) for _, t in docs]
    linked = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    roots = union_find(len(docs), [(i, j) for i, j in combinations(range(len(docs)), 2) if linked(sets[i], sets[j])])
    return [(len(s), r) for s, r in zip(sets, roots, strict=True)]


def edits(a, b):
    """Edit distance by bit vectors (Myers, 1999): a column of the table is two integers."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        grown, shrunk = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(grown & last) - bool(shrunk & last)
        grown, shrunk = (grown << 1 | 1) & full, shrunk << 1 & full
        up, down = shrunk | ~(same | down | grown) & full, grown & (same | down)
    return distance


def normal_line(line):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ").lower()


def similar_lines(lines):
    """Pairs of different normalised lines of edit similarity 0.8, by comparing all."""
    for a, b in combinations(lines, 2):
        most = int(max(len(a), len(b)) * (1 - 0.8) + 1e-9)
        if abs(len(a) - len(b)) <= most and edits(a, b) <= most:
            yield a, b


def deduped_lines(docs, links):
    """docs in ascending order; (n_lines, n_removed, text) of each, with lines linked as given."""
    lines = [[normal_line(x) for x in (t or "").split("\n")] for _, t in docs]
    order = list(dict.fromkeys(x for doc in lines for x in doc if x))
    place = {x: i for i, x in enumerate(order)}
    roots = union_find(len(order), [(place[a], place[b]) for a, b in links])
    group, seen = dict(zip(order, roots, strict=True)), set()
    for (_, text), doc in zip(docs, lines, strict=True):
        kept, removed = [], 0
        for raw, x in zip((text or "").split("\n"), doc, strict=True):
            if x and group[x] in seen:
                removed += 1
                continue
            if x:
                seen.add(group[x])
            kept.append(raw)
        yield len(doc) if text else 0, removed, "\n".join(kept) if removed else text


def lengths(docs):
    encode = encoder("byte_bpe_50k.json")
    n = Counter(len(encode(t)) for _, t in docs)
    total = sum(x * k for x, k in n.items())
    for limit in n:
        cut = sum(min(x, limit) * k for x, k in n.items())
        longer = sum(k for x, k in n.items() if x > limit)
        yield limit, n[limit], longer, total, cut, total - cut, (len(docs) - longer) / len(docs)
