"""Whole texts to token ids with the tokenizers library, each distinct piece encoded once per worker.

A text is cut where its tokens can't reach across, the library encodes each distinct piece, and a text's ids are its
pieces' ids in a row. That gives the library's ids at a fraction of its time, as words repeat. Both ways are for byte-level models:

* ``leading``: byte-level BPE, whose pre-tokenizer joins one space to the word that follows and never joins a character
  to white space after it. A cut is made before each run of white space that begins with a space or a line feed.
* ``dropped``: tokenizers that drop white space. Cuts are made at each space and line feed, which are left out.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from policylog.llm.common import CACHES

#: NUL, and white space other than space and line feed, as Python sees it (more than the library does, which is safe).
_OTHER_SPACE = "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
_CUT = re.compile(r"(?<=\S)[ \n]")


def _plain(text: str) -> bool:
    """No white space but single spaces and line feeds between other text."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n") or text[:1] in (" ", "\n") or any(c in text for c in _OTHER_SPACE))


def pieces_leading(text: str) -> list[str]:
    """Pieces with their white space in front; of a piece after a plain space the space itself is left out, and the
    text's first piece is marked by a NUL in front, so that "a" at the start and " a" have different keys."""
    if not text:
        return []
    if _plain(text):
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts
    cuts = [0, *(m.start() for m in _CUT.finditer(text) if m.start()), len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    return ["\0" + parts[0], *(p[1:] if p[0] == " " and p[1:2] not in ("", "\n", "\0") else p if p[0] == "\n" else "\0" + p for p in parts[1:])]


def text_of_leading(piece: str) -> str:
    return piece[1:] if piece[0] == "\0" else piece if piece[0] == "\n" else " " + piece


def pieces_dropped(text: str) -> list[str]:
    return [p for p in text.replace("\n", " ").split(" ") if p]


CUTS = {"leading": (pieces_leading, text_of_leading), "dropped": (pieces_dropped, str)}
_MADE: dict[tuple, PieceEncoder] = {}


def _forget() -> bool:
    held = bool(_MADE)
    for encoder in _MADE.values():
        encoder.cache.clear()
    _MADE.clear()
    return held


CACHES["pieces"] = _forget
#: A word of common letters with punctuation behind it: two pre-tokens in either way of cutting.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers write for each byte: itself where printable, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Cache(dict):
    """Pieces' ids as bytes; a missing piece is encoded and kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.make(piece)
        return ids


class PieceEncoder:
    """ids of texts as little-endian unsigned integers of ``width`` bytes (2 where the vocabulary allows)."""

    def __init__(self, path: str, cut: str, cache_pieces: int = 500_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut, (self.pieces, self.text_of) = cut, CUTS[cut]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.cache = _Cache(self._make)
        self.cache_pieces = cache_pieces
        self.checked = 0
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    @classmethod
    def get(cls, path: str, cut: str) -> PieceEncoder:
        if (path, cut) not in _MADE:
            _MADE[path, cut] = cls(path, cut)
        return _MADE[path, cut]

    def _make(self, piece: str) -> bytes:
        """A plain word goes to the library's model as it is, without its pre-tokenizer; the punctuation behind it, and a
        line feed in front, are pieces of their own."""
        head, body = "", piece
        if self.cut == "leading":
            if piece[:1] == "\n":
                return self.cache["\0\n"] + self.cache["\0" + piece[1:]] if _WORD.fullmatch(piece, 1) else self._encoded(piece)
            head, body = (" ", piece) if piece[:1] != "\0" else ("", piece[1:])
        found = _WORD.fullmatch(body)
        if not found:
            return self._encoded(piece)
        word, rest = found.groups()
        if rest:
            start = word if head or self.cut == "dropped" else "\0" + word
            return self.cache[start] + self.cache["\0" + rest if self.cut == "leading" else rest]
        text = word.lower() if self.cut == "dropped" else head + word
        ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in text.encode()]))]
        return self._packed(ids)

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _encoded(self, piece: str) -> bytes:
        return self._packed(self.tokenizer.encode(self.text_of(piece), add_special_tokens=False).ids)

    def _trim(self) -> None:
        if len(self.cache) > self.cache_pieces:
            self.cache.clear()

    def sizes(self, pieces: list[str]) -> list[int]:
        """How many ids each piece has."""
        self._trim()
        return [len(self._make(p)) // self.width for p in pieces]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text counts as empty. A few short texts are also encoded whole, to prove the cuts right for this file."""
        self._trim()
        get = self.cache.__getitem__
        out = [b"".join(map(get, self.pieces(t))) if t else b"" for t in texts]
        for text, ids in zip(texts, out):
            if self.checked >= 5:
                break
            if text and len(text) < 5000:
                self.checked += 1
                if self.whole(text) != np.frombuffer(ids, self.dtype).tolist():
                    raise ValueError("this tokenizer's tokens reach across the cuts")
        return out


def batches_of(column, most_chars: int = 1 << 20):
    """Runs of an Arrow text column's values, with the first row's number, of bounded total length (one text at least)."""
    start, texts, size = 0, [], 0
    for i, x in enumerate(column):
        text = x.as_py() or ""
        if texts and size + len(text) > most_chars:
            yield start, texts
            start, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield start, texts
