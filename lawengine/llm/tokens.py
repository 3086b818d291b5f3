"""Encoding whole texts with the tokenizers library.

A text is cut at places where the tokenizer's own pre-tokenizer cuts too, and each different piece is encoded
once by the library; the ids are those of the whole text. This holds for texts of ASCII and Latin-1 letters,
for which the pre-tokenizer's classes can be stated; any other text is given to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: The letters of Latin-1 beyond ASCII, and the pre-tokenizers' patterns over them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[\t\n\r\x20-\x7e{LETTERS}]*")
PIECES = {
    "byte": re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^ \t\n\r0-9{LETTERS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"),
    "word": re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^ \t\n\r0-9{LETTERS}]+"),
}
#: A space beside white space: there a cut before each space is not one of the pre-tokenizer's.
MIXED = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
#: Pieces, and words with what clings to them, that a worker keeps before it starts again; bounds its memory only.
KEPT = 400_000


class Pieces(dict):
    """The ids of each piece, from the library's model; a piece is one pre-token, with its bytes written as the model's letters."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = tokenizer.model
        one = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: "".join(x for x, _ in one(chr(c))) for c in (9, 10, 13, *range(32, 127), *range(192, 256))}
        self.model._resize_cache(0)  # this dictionary takes its place

    def made(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() and piece.isalnum() else piece.translate(self.letters))]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT // 2:
            self.clear()
        self[piece] = ids = self.made(piece)
        return ids


class Encoder(dict):
    """encode(text): the ids as little-endian unsigned 32-bit integers. kind: a key of PIECES.

    The dictionary holds, for each word between spaces, the ids of the word with the space before it.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.find = Tokenizer.from_file(path), kind, PIECES[kind].findall
        self.pieces, self.space = Pieces(Tokenizer.from_file(path)), " " if kind == "byte" else ""

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def parts(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self.pieces.made(self.space + word)
        elif word[:-1].isalpha() and word[-1] in ".,;:!?)|":
            ids = self.pieces[self.space + word[:-1]] + self.pieces[word[-1]]
        else:
            ids = self.parts(self.space + word)
        if len(word) < 40:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or not PLAIN.fullmatch(text):
            return self.whole(text)
        if self.kind == "word":
            return b"".join(map(self.__getitem__, text.lower().split()))
        if text[0] == " " or text[-1] == " " or any(x in text for x in MIXED):
            return self.parts(text)
        first, *words = text.split(" ")
        return self.parts(first) + b"".join(map(self.__getitem__, words))


_made: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, kind) not in _made:
        _made[path, kind] = Encoder(path, kind)
    return _made[path, kind]
