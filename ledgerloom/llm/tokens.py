"""Token ids as a vocabulary file's own library gives them, with the library asked once per piece.

The vocabularies cut a text into pieces by a pattern before any merge, and the pieces never reach across
certain places (`Layout`). A text is cut at those places, which needs no pattern, and the ids of each part
come from a bounded table; parts not yet in it are cut into pieces, and pieces not yet known go through
the library's model. Texts with characters or white space beyond the plain ones (`Layout.plain`) are
handed to the library whole, as are texts that hold a special token. Results equal the library's in all
cases; the table is only a short cut, and emptying it changes nothing.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

PARTS, PIECES = 400_000, 1_000_000  # what one Python worker keeps: some 250 MB when both are full

# Fixed values of the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = str.maketrans({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)})

_SPACE = " ".translate(_ALPHABET)

# The letters and other signs of the plain range.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = f"[^ -~\n{_LETTERS}]"


def spelled(piece: str) -> str:
    """A piece in the byte-level alphabet, one character a byte."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", _SPACE)
    return piece.encode().decode("latin-1").translate(_ALPHABET)


@dataclass(frozen=True)
class Layout:
    """odd: finds signs, and apart: strings, that make a text go to the library whole. piece: the vocabulary's pattern on
    plain text. lower: whether the vocabulary lowers letters and drops white space."""

    odd: re.Pattern
    apart: tuple[str, ...]
    piece: re.Pattern
    lower: bool


# Patterns as the vocabulary files state them, over the plain characters.
BYTES = Layout(re.compile(_PLAIN), ("  ", " \n", "\n ", "\n\n"),
               re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|[ \n]"), False)
WORDS = Layout(re.compile(_PLAIN), (),
               re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \n0-9{_LETTERS}]+"), True)
LAYOUTS = {"byte_bpe_50k.json": BYTES, "word_bpe_49k.json": WORDS}


class Table(dict):
    """Fills itself by `find`; emptied when it holds `room` entries."""

    def __init__(self, find, room: int):
        self.find, self.room = find, room

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.room:
            self.clear()
        found = self[key] = self.find(key)
        return found


class Encoder:
    def __init__(self, name: str, layout: Layout | None = None, parts: int = PARTS, pieces: int = PIECES):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.layout = layout or LAYOUTS.get(name)
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code).newbyteorder("<")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = Table(self.piece_ids, pieces)
        self.parts = Table(self.part_ids, parts)
        self.spelled_parts = Table(lambda part: [spelled(p) for p in self.cut_part(part)], parts)

    def plain(self, text: str) -> bool:
        return (self.layout is not None and not self.layout.odd.search(text)
                and not any(s in text for s in self.layout.apart) and not any(s in text for s in self.special))

    def ids(self, text: str) -> np.ndarray:
        if not self.plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        # the first part stands behind no white space: it is kept behind a line feed, whose one id goes
        return np.frombuffer(b"".join(map(self.parts.__getitem__, self.cut(text))), self.kind)[not self.layout.lower:]

    def cut(self, text: str) -> list[str]:
        """Parts that no piece reaches across: words with what adheres to them. A part of the byte layout stands for
        itself behind a space, or, if it begins with a line feed, for itself."""
        if self.layout.lower:
            return text.lower().split()
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def cut_part(self, part: str) -> list[str]:
        """The pieces of a part."""
        spaced = part if self.layout.lower or part[:1] == "\n" else " " + part
        if part.isalpha():
            return [spaced]
        return [spaced[:-1], part[-1]] if part[:-1].isalpha() and part[-1] in ".,;:!?" else self.layout.piece.findall(spaced)

    def part_ids(self, part: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.cut_part(part)])

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one piece by the library's model alone."""
        return array(self.code, [t.id for t in self.library.model.tokenize(spelled(piece))]).tobytes()

    def pre_tokens(self, text: str) -> list[str]:
        """What the library itself cuts a text without special tokens into, spelled."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


@cache
def encoder(name: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(name)
