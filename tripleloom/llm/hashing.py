"""64-bit hashes of the words of many texts at once, in numpy.

A word's hash is a polynomial of its bytes (A-Z lower-cased) modulo 2**64, mixed; it comes as a difference of one running
sum over a block of text, so no word becomes a Python object. Runs of words hash the same way from the hashes of the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Odd factors of the polynomials over bytes and over words, and their inverses modulo 2**64.
BYTE, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BYTE_INVERSE, WORD_INVERSE = pow(BYTE, -1, 1 << 64), pow(WORD, -1, 1 << 64)
#: Bytes of text in a block; a longer word is summed block by block.
BLOCK = 1 << 17
#: Texts and bytes that are hashed at once; a longer text goes alone.
TEXTS, SIZE = 256, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """x, changed in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and about SIZE bytes of text."""
    sizes = np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] - sizes[at] + SIZE, "right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


class Words(NamedTuple):
    """The words of texts one after another."""

    raw: bytes  # the texts, A-Z lower-cased, a line feed after each
    text_at: np.ndarray  # where each text begins in raw, and the end
    starts: np.ndarray  # of words in raw
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # each text's first word, and the number of words

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


class Hasher:
    """Holds the powers that a block needs; one for each task."""

    def __init__(self) -> None:
        self.power = np.cumprod(np.full(BLOCK, BYTE, np.uint64))
        self.inverse = np.cumprod(np.full(BLOCK, BYTE_INVERSE, np.uint64))
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True

    def column(self, texts: pa.Array) -> Words:
        return self.words(texts.cast(pa.binary()).to_pylist())

    def words(self, texts: list[bytes]) -> Words:
        raw = b"\n".join([*texts, b""]).translate(LOWER)
        text_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        a = np.frombuffer(raw, np.uint8)
        space = np.ones(len(a) + 1, bool)
        space[1:] = self.space[a]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        return Words(raw, text_at, starts, ends, self._hash(a, starts, ends), np.searchsorted(starts, text_at))

    def _hash(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, first = np.empty(len(starts), np.uint64), 0
        with np.errstate(over="ignore"):
            while first < len(starts):
                s = int(starts[first])
                last = max(first + 1, int(np.searchsorted(ends, s + len(self.power), "right")))
                part = a[s : int(ends[last - 1])]
                if len(part) > len(self.power):  # one long word
                    out[first] = self._long(part)
                else:
                    sums = np.zeros(len(part) + 1, np.uint64)
                    np.cumsum((part + np.uint64(1)) * self.power[: len(part)], out=sums[1:])
                    here = starts[first:last] - s
                    out[first:last] = (sums[ends[first:last] - s] - sums[here]) * self.inverse[here]
                first = last
        return mix(out)

    def _long(self, word: np.ndarray) -> np.uint64:
        total, scale = np.uint64(0), self.inverse[0]
        for at in range(0, len(word), len(self.power)):
            part = word[at : at + len(self.power)]
            total += ((part + np.uint64(1)) * self.power[: len(part)]).sum(dtype=np.uint64) * scale
            scale *= self.power[-1]
        return total


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` hashed words; those that cross from one text into the next are for the caller to leave out."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * np.cumprod(np.full(len(hashes), WORD, np.uint64)), out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * np.cumprod(np.full(len(hashes) - width + 1, WORD_INVERSE, np.uint64)))
