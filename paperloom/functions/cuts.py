"""Where texts are cut (G1, G3-G6, W14): ranges of characters, in time linear in the text. What one task runs on a text."""

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

# Fixed values.
PAGE = 3000
ZONE_THRESHOLD, ZONE, ZONE_OVERLAP, MOST_ZONES, LOOK_BACK = 80_000, 40_000, 2_000, 10, 500


def fixed_chunks(n: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """G1: chunks that begin ``size - overlap`` apart, until one reaches the end."""
    if n > 0:
        for start in range(0, max(n - overlap - 1, 0) + 1, max(1, size - overlap)):
            yield start, min(start + size, n)


def synthetic_pages(text: str, size: int = PAGE) -> Iterator[tuple[int, int]]:
    """Pages of ``size`` characters at most, each cut behind its last line break, if that isn't its first character."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            at = text.rfind("\n", start, end)
            end = at + 1 if at > start else end
        yield start, end
        start = end


def zones_by_characters(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Zones of ``size`` characters at most that overlap; cut behind a paragraph where one ends in the last LOOK_BACK
    characters and past the middle. A zone begins ``overlap`` before the last one's end, also at the end of the text, where
    one more zone has the overlap alone."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            at = text.rfind("\n\n", max(end - LOOK_BACK, start), end)
            end = at + 2 if at > start + size // 2 else end
        yield start, end
        again = end - overlap
        start = again if again > start else start + max(1, size // 2)


def zones_by_pages(n: int, pages: Sequence[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """Whole pages (start, end) up to ``size`` characters a zone, as (start, end, first page, last page); a zone that
    closes takes ``overlap`` characters of the next page with it, and the next begins as much before that page."""
    begin, first, held = 0, 1, 0
    for number, (start, end) in enumerate(pages, 1):
        if held > 0 and held + end - start > size:
            yield begin, min(start + overlap, n), first, number - 1
            begin = max(start - overlap, begin)
            first, held = number, end - start + min(overlap, start - begin)
        else:
            held += end - start
    if begin < n:
        yield begin, n, first, len(pages)


def page_of(pages: Sequence[tuple[int, int]], at: int) -> int | None:
    """The number, from 1, of the page that holds a character; behind the end the last. pages: by ascending start."""
    i = bisect_right(pages, at, key=lambda p: p[0])
    if not pages:
        return None
    return i if i and at < pages[i - 1][1] else len(pages)


def zones(text: str, pages: Sequence[tuple[int, int]] = (), threshold: int = ZONE_THRESHOLD, size: int = ZONE, overlap: int = ZONE_OVERLAP, most: int = MOST_ZONES) -> list[tuple]:
    """The zones (start, end, first page, last page) of a text of more than ``threshold`` characters; none of
    another. By pages if there are any; where that gives more than ``most``, by characters with larger zones."""
    n = len(text)
    if n <= threshold:
        return []
    found = [z[:2] for z in zones_by_pages(n, pages, size, overlap)] if pages else list(zones_by_characters(text, size, overlap))
    if len(found) > most:
        found = list(zones_by_characters(text, n // most + overlap, overlap))
    return [(s, e, page_of(pages, s), page_of(pages, e - 1)) for s, e in found]


def greedy(points: Sequence[int], target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Over ascending split points, a chunk ends at the last point within ``target`` of its start, or at the next
    one if there is none; the next begins at the first point in its last ``overlap`` characters, else at its end."""
    if not points:
        return
    start = end = points[0]
    for p in points:
        if p - start > target and end > start:
            yield start, end
            i = bisect_left(points, max(end - overlap, start + 1))
            start = points[i] if i < len(points) and points[i] < end else end
        end = p
    if end > start:
        yield start, end
