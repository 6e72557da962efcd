"""Token ids by the tokenizers library, with the ids of frequent space-separated pieces remembered in each worker."""

import os
import re
from array import array

import numpy as np

KEPT = 700_000  # remembered pieces in a worker; the rest are encoded in each batch that has them
LONGEST = 40

# A text may be cut before a space unless white space stands on both sides of it, for both vocabularies: a run of
# white space is one piece up to its last character, which goes with the word that follows.
UNSAFE = re.compile(r" (?<=\s )(?=\s|\Z)")

MARKS = frozenset(".,;:!?")
LATIN = "\u0250"  # letters below are one code point each, before and after normalisation

# Byte-level vocabularies write a byte as one character: itself if it is printable, else the next one from 256 on.
UNPRINTABLE = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
AS_SHOWN = {b: 256 + i for i, b in enumerate(UNPRINTABLE)}

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes whole texts. Equal to ``Tokenizer.encode(text, add_special_tokens=False).ids`` for byte-level tokenizers
    that cut words at spaces. Texts with an added token of the vocabulary are encoded whole by the library.

    A piece that is one word of Latin letters, or such a word and one mark, goes straight to the library's BPE model;
    all others go through the library's whole path. A probe at the start turns the short way off where the two differ.
    With ``plain``, added tokens' strings are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) or r"(?!)", re.IGNORECASE)
        self.model, self.most_kept = self.tokenizer.model, kept
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.folds = self.tokenizer.normalizer is not None  # lower case; white space has no ids
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.direct = True
        probe = ["the", "Thonre,", "aionqué", "Größe.", "ÀÉ", "end.\nNext", "a\nb\ncé;"]
        for lead in ("", " "):
            whole = self._encode([lead + x for x in probe])
            self.direct = self.direct and all(self._short(x, lead, {}) == y for x, y in zip(probe, whole, strict=True))

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of one word of letters or of one mark, by the BPE model."""
        if self.folds:
            word, lead = word.lower(), ""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(AS_SHOWN)
        ids = [t.id for t in self.model.tokenize("\u0120" + word if lead else word)]
        return array(self.code, ids).tobytes()

    def _short(self, piece: str, lead: str, known: dict[str, bytes]) -> bytes | None:
        """Ids of a piece of plain words, or None."""
        if "\n" in piece:
            out = []
            for i, part in enumerate(piece.split("\n")):
                ids = known.get(part) if i == 0 else self.first.get(part)
                ids = ids or (self._short(part, lead if i == 0 else "", known if i == 0 else self.first) if part else None)
                if not ids:
                    return None
                out.append(ids)
            if "\n" not in self.first:
                self.first["\n"] = self._encode(["\n"])[0]
            return self.first["\n"].join(out)
        core, mark = (piece[:-1], piece[-1]) if piece[-1] in MARKS else (piece, "")
        if not core.isalpha() or not (core.isascii() or max(core) < LATIN and core.lower().isalpha()):
            return None
        ids = (known.get(core) if mark else None) or self._word(core, lead)
        if mark:
            if mark not in self.first:
                self.first[mark] = self._encode([mark])[0]
            ids += self.first[mark]
        return ids

    def _learn(self, kept: dict[str, bytes], pieces: set[str], lead: str) -> list[str]:
        """Puts all pieces into kept; returns those that are to leave it after use."""
        new = [x for x in pieces if x not in kept]
        if not new:
            return []
        found, rest = {}, []
        for x in new:
            ids = self._short(x, lead, kept) if self.direct and x else None
            if ids is None:
                rest.append(x)
            else:
                found[x] = ids
        found.update(zip(rest, self._encode([lead + x for x in rest]), strict=True))
        full = len(kept) >= self.most_kept
        kept.update(found)
        return [x for x in found if full or len(x) > LONGEST]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``width``."""
        out: list[bytes] = [b""] * len(texts)
        cut, whole = [], []
        for i, text in enumerate(texts):
            if text and (UNSAFE.search(text) or self.added.search(text)):
                whole.append(i)
            elif text:
                cut.append((i, text.split(" ")))
        if whole:
            for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
                out[i] = ids
        first, later = self.first, self.later
        leave_first = self._learn(first, {p[0] for _, p in cut}, "")
        leave_later = self._learn(later, set().union(*(p[1:] for _, p in cut)), " ")
        for i, pieces in cut:
            out[i] = first[pieces[0]] + b"".join(map(later.__getitem__, pieces[1:]))
        for x in leave_first:
            del first[x]
        for x in leave_later:
            del later[x]
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(path: str, batches, column: str = "text", most_bytes: int = 1 << 20):
    """(Arrow batch, row, ids bytes) for all rows, encoded in groups of about most_bytes characters; null: no ids."""
    e = encoder(path)
    for batch in batches:
        texts, rows, size = [], [], 0
        column_values = batch.column(column)
        for i in range(batch.num_rows):
            texts.append(column_values[i].as_py() or "")
            rows.append(i)
            size += len(texts[-1])
            if size >= most_bytes or i + 1 == batch.num_rows:
                for r, ids in zip(rows, e.encode(texts), strict=True):
                    yield batch, r, ids
                texts, rows, size = [], [], 0
