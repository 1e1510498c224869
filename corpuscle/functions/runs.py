"""Vectorised splitting of texts into runs of characters, over whole Arrow batches.

Texts are laid end to end; one numpy pass finds the borders; the runs become a
string array over the same UTF-8 bytes without copying, and pyarrow gives each
different run a code. Nothing loops over characters or words in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Unicode's White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Classes of ``categories``: the first letter of the general category; digits apart from other numbers.
OTHER, LETTER, MARK, DIGIT, NUMBER, PUNCTUATION, SPACE = range(7)


@lru_cache(1)
def categories() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "M": MARK, "N": NUMBER, "P": PUNCTUATION}
    out = np.full(0x110000, OTHER, np.uint8)
    # Planes 4 to 13 are unassigned, 15 and 16 private use.
    for low, high in ((0, 0x40000), (0xE0000, 0xF0000)):
        out[low:high] = np.fromiter((DIGIT if (c := unicodedata.category(chr(i))) == "Nd" else kinds.get(c[0], OTHER) for i in range(low, high)), np.uint8, high - low)
    out[list(WHITE_SPACE)] = SPACE
    return out


@lru_cache(1)
def word_table() -> np.ndarray:
    """True for letters, combining marks and digits."""
    return np.isin(categories(), (LETTER, MARK, DIGIT))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def byte_places(cp: np.ndarray) -> np.ndarray:
    """The UTF-8 offset of each code point and of the end."""
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(width, dtype=np.int64)])


def pieces(text: str, cp: np.ndarray, borders: np.ndarray) -> pa.DictionaryArray:
    """The pieces of ``text`` between ``borders`` (code points, from 0 to the end), dictionary-encoded."""
    data = text.encode("utf-8", "surrogatepass")
    at = byte_places(cp)[borders].astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()


def slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts with null as empty) of about ``most`` characters at a time; a longer text comes alone, whole."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield first, [x or "" for x in texts[first:i]]
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, [x or "" for x in texts[first:]]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of lower-cased texts: (text number of each word, its code, the words by code)."""
    lowered = [t.lower() for t in texts]
    # A line break parts the texts and belongs to no word.
    joined = "\n".join(lowered)
    cp = code_points(joined)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    inside = word_table()[cp]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    borders = np.concatenate([[0], change, [len(cp)]])
    coded = pieces(joined, cp, borders)
    own = slice(0 if inside[0] else 1, None, 2)
    starts = borders[:-1][own]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    return np.searchsorted(ends, starts, side="right"), coded.indices.to_numpy().astype(np.int64)[own], coded.dictionary
