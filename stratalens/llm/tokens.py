"""Token ids of whole texts, as the tokenizers library gives them, at the speed of a dictionary.

The public word BPE splits texts into pieces before it joins anything, so a text's ids are those of its pieces, one
after the other. Pieces that a worker has met come from a dictionary; new ones are encoded by the library's model. That
shortcut holds for texts of characters whose normalisation is plain lower-casing; any other text, and any that names a
special token, is encoded whole by the library. So ids always equal the library's.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Characters that NFC leaves alone and that lower-case one by one: white space, ASCII, Latin letters without the
#: dotted capital I, Cyrillic, kana, common Han and Hangul syllables.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ɏА-яЁёぁ-ゖァ-ヺ一-鿿가-힣‐-‧€]")
MOST_PIECES = 600_000

#: Fixed value: how the vocabulary's tokenizer splits texts, for the characters of _PLAIN: endings after an apostrophe,
#: runs of letters, single numerals, runs of anything else.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\w\s]|_)+")


def _byte_letters() -> list[str]:
    """Byte-level letters: a byte is its own Latin-1 letter if that is printable, else the next one from 256 on."""
    out, following = [], 256
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b and b != 0xAD
        out.append(chr(b if shown else following))
        following += not shown
    return out


_BYTE = _byte_letters()


def _put(table: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """values from at on; the table is doubled until they fit."""
    while at + len(values) > len(table):
        table = np.concatenate([table, np.zeros_like(table)])
    table[at : at + len(values)] = values
    return table


class Encoder:
    """Encodes texts; keeps the ids of at most MOST_PIECES pieces (then starts anew)."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.place: dict[str, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, pieces: list[str]) -> None:
        if len(self.place) + len(pieces) > MOST_PIECES:
            self.place.clear()
            self.used = 0
        tokenize = self.tokenizer.model.tokenize
        made = [[t.id for t in tokenize(p if p.isascii() else "".join([_BYTE[x] for x in p.encode()]))] for p in pieces]
        first = len(self.place)
        self.place.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        self.start = _put(self.start, first, self.used + np.cumsum(sizes) - sizes)
        self.length = _put(self.length, first, sizes)
        self.flat = _put(self.flat, self.used, np.fromiter(chain.from_iterable(made), np.uint32))
        self.used += int(sizes.sum())

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        pieces = _PIECE.findall(text.lower())
        at = [*map(self.place.get, pieces)]
        if None in at:
            new = list(dict.fromkeys([p for p, i in zip(pieces, at, strict=True) if i is None]))
            known = len(self.place) + len(new) <= MOST_PIECES
            self._learn(new if known else list(dict.fromkeys(pieces)))
            at = [*map(self.place.get, pieces)]
        if not at:
            return np.zeros(0, np.uint32)
        at = np.array(at)
        length = self.length[at]
        ends = np.cumsum(length)
        within = np.arange(ends[-1]) - np.repeat(ends - length, length)
        return self.flat[np.repeat(self.start[at], length) + within]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file: kept for later batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
