"""Token ids of whole texts by a public tokenizer file, with caches over words.

The tokenizer in question drops white space and never joins text across it, so a text's ids
are those of its white-space-separated chunks in order; most chunks come out of a cache.
Any tokenizer file of another shape is used plainly, text by text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

from tomeloom.llm.arrow import kept

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = regex.compile(_PATTERN)
#: Above it, normalisation is left to the tokenizer; up to it there are no combining marks.
_PLAIN = regex.compile("[ɐ-\U0010ffff]|<\\|")
#: str.split() splits at these, the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level tokenizers: bytes that print keep their own."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenIds:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    A lower-case chunk of letters is its own piece and kept once.  Caches end just below the sizes
    (two thirds of a power of two) at which dictionaries double.
    """

    def __init__(self, tokenizer_json: str, chunks: int = 170_000, pieces: int = 87_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most = (chunks, pieces)
        self.letters = _byte_letters()
        shape = json.loads(tokenizer_json)
        parts = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [n.get("type") for n in (shape.get("normalizer") or {}).get("normalizers", [])]
        self.by_chunk = parts[0].get("pattern", {}).get("Regex") == _PATTERN and steps == ["NFC", "Replace", "Lowercase"]

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str, keep: bool = True) -> bytes:
        found = self.pieces.get(piece)
        if found is None and piece.isalpha():
            found = self.chunks.get(piece)  # a chunk of letters, in lower case, is one piece
        if found is None:
            spelt = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
            found = np.asarray([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
            if keep and len(self.pieces) < self.most[1]:
                self.pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and _PLAIN.search(chunk) or "<|" in chunk:
            found = self.plain(chunk)
        else:
            low = chunk.lower()
            if low.isalpha():
                found = self._piece(low, low != chunk)
            elif low[:-1].isalpha() and low[-1] in ".,;:!?":
                found = self._piece(low[:-1]) + self._piece(low[-1])
            else:
                found = b"".join(map(self._piece, _PIECES.findall(low)))
        if len(self.chunks) < self.most[0] and len(chunk) < 64:
            self.chunks[chunk] = found
        return found

    def __call__(self, text: str) -> bytes:
        if not self.by_chunk or any(c in text for c in _ODD):
            return self.plain(text)
        words = text.split()
        found = list(map(self.chunks.get, words))
        if None in found:
            found = [self._chunk(w) if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)


def token_ids(tokenizer_json: str) -> TokenIds:
    """One per worker process and tokenizer, so that its caches serve all its tasks."""
    key = ("tokenizer", hash(tokenizer_json))
    if key not in kept:
        kept.clear()
        kept[key] = TokenIds(tokenizer_json)
    return kept[key]
