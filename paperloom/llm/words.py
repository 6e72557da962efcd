"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK_BYTES = 1 << 21

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


_tables: dict[str, np.ndarray] = {"powers": np.ones(1, U), "back": np.ones(1, U)}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), kept for later calls up to 4 CHUNK_BYTES."""
    if len(_tables[name]) >= n:
        return _tables[name][:n]
    out = np.full(n, base, U)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= 4 * CHUNK_BYTES:
        _tables[name] = out
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of consecutive texts: bytes ``data``, word bounds ``start`` and ``end``, ``first[d]`` the number of
    words before text d, ``doc`` the text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data, n = data, len(data)
        inside = is_word[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes; equal words have equal hashes."""
        n = len(self.data)
        total = np.zeros(n + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * _powers("powers", BASE, n + 1)[:n], out=total[1:])
        back = _powers("back", INVERSE, n + 1)
        return mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(U))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        raw = self.data
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 places are not of use."""
    out = h.copy()
    for j in range(1, n):
        out = out * BASE
        out[: len(h) - j] += h[j:]
    return mix(out)


def chunks(texts: pa.Array, lower: bool = False):
    """(first row, bytes, offsets) of runs of rows with about CHUNK_BYTES; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        data = raw[offsets[i] : offsets[j]]
        yield i, (LOWER[data] if lower else data), offsets[i : j + 1] - offsets[i]
        i = j


def words_of(texts: pa.Array, is_word: np.ndarray, lower: bool = False):
    """(first row, Words) of runs of rows."""
    for i, data, offsets in chunks(texts, lower):
        yield i, Words(data, offsets, is_word)
