"""Encoding whole texts with a byte-level BPE of the tokenizers library, each different piece of text only once.

A single space between two characters that aren't white space always begins a new pre-token of the byte-level
pattern, so what stands between two such spaces is encoded the same in any text. Texts are cut there; the library's
model encodes each piece when it is first met and a bounded table keeps the ids.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

LITTLE = sys.byteorder == "little"

#: Pieces kept by one encoder before it starts afresh.
MOST_PIECES = 1_500_000

#: The byte-level pre-tokenizer's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)]


SPACE = byte_characters()[0x20]


class PieceEncoder(dict):
    """piece -> its ids in little-endian bytes, where a space comes before the piece; None: not to be cut here."""

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        told = json.loads(tokenizer_json)
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letter = "H" if self.type.itemsize == 2 else "I"
        pre, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        #: Whether texts may be cut; with any other set-up the library gets whole texts.
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in added)
        self.odd = re.compile("|".join([r"[^\0-ɏ]", *(re.escape(x["content"]) for x in added)]))
        self.model = self.library.model
        #: Whether every added token holds something that plain words with a mark after them don't.
        self.marked = all(re.search(r"[^A-Za-z.,;:!?]", x["content"]) for x in added)
        self.pattern = regex.compile(PATTERN)
        self.as_characters = dict(enumerate(byte_characters()))
        self.tokens: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.letter, ids).tobytes() if LITTLE else np.array(ids, dtype=self.type).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        # Letters alone hold no added token, which has others; ASCII ones need no look at their age either.
        plain, last = (piece, "") if piece.isalpha() else (piece[:-1], piece[-1])
        if (not last or last in ".,;:!?") and plain.isalpha() and (piece.isascii() and self.marked or not self.odd.search(piece)):
            found = self.token(" " + plain) + self.token(last) if last else self.token(" " + plain)
        else:
            found = self.spaced(" " + piece)
        self[piece] = found
        return found

    def token(self, token: str) -> bytes:
        """The ids of one pre-token."""
        if (ids := self.tokens.get(token)) is None:
            if token.isascii() and token[1:].isalpha():  # a space or letter, and letters: only the space is written otherwise
                as_bytes = token.replace(" ", SPACE)
            else:
                as_bytes = token.encode().decode("latin-1").translate(self.as_characters)
            ids = self.tokens[token] = self.packed([x.id for x in self.model.tokenize(as_bytes)])
        return ids

    def spaced(self, piece: str) -> bytes:
        # Past U+024F the two libraries' Unicode tables may differ in age.
        if self.odd.search(piece):
            return self.whole(piece)
        return b"".join(map(self.token, self.pattern.findall(piece)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian bytes of self.type."""
        if not text:
            return b""
        if not self.cuts:
            return self.whole(text)
        if len(self) + len(self.tokens) > MOST_PIECES:
            self.clear()
            self.tokens.clear()
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise TypeError
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        except TypeError:  # a space beside other white space: cut at single spaces only
            first, *rest = re.split(r"(?<=\S) (?=\S)", text)
            return self.whole(first) + b"".join(self[x] if x and not x[-1].isspace() and not x[0].isspace() else self.whole(" " + x) for x in rest)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(tokenizer_json: str) -> PieceEncoder:
    """One encoder for each tokenizer and worker process, with what it has kept from earlier tasks."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = PieceEncoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]
