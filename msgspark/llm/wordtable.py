"""Words of many texts at once: a chunk of an Arrow column becomes one buffer of words with offsets, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 8_000_000  # bytes of text that are worked on at once, about; a longer text is a chunk of its own
#: Fixed value: the bytes that end a word, \x20 and \x09-\x0D.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FACTOR, _MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass
class Words:
    """data: the bytes of all words, without spaces; offsets: where each begins, and the end; first: the first word of each text, and the number of words."""

    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray

    def array(self) -> pa.Array:
        return binary_array(self.data, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spaced(self) -> np.ndarray:
        """All words with one space after each: word w stands from offsets[w] + w to offsets[w + 1] + w."""
        out = np.full(len(self.data) + len(self), 32, np.uint8)
        out[np.arange(len(self.data)) + np.repeat(np.arange(len(self)), np.diff(self.offsets))] = self.data
        return out

    def texts(self) -> list[memoryview]:
        """Each text's words, joined by one space."""
        whole, starts, stops = memoryview(self.spaced()), self.first[:-1], self.first[1:]
        at, to = self.offsets[starts] + starts, self.offsets[stops] + stops - 1
        return [whole[a : max(a, b)] for a, b in zip(at.tolist(), to.tolist(), strict=True)]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries, and where each value begins (nulls are empty)."""
    wide = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = wide.buffers()
    bounds = np.frombuffer(at, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def chunks(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def split_words(texts: pa.Array, spaces: np.ndarray = SPACES, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that aren't spaces, of every text; fold: a table of 256 bytes that all bytes go through first. Nulls have no words."""
    raw, bounds = buffers(texts)
    if fold is not None:
        raw = fold[raw]
    solid = ~spaces[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    begin[heads] = solid[heads]  # a word never goes on in the next text
    begins = np.flatnonzero(begin)
    sizes = np.add.reduceat(solid, begins, dtype=np.int64) if len(begins) else np.empty(0, np.int64)
    return Words(raw[solid], np.concatenate([[0], np.cumsum(sizes)]), np.searchsorted(begins, bounds))


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash of each word: two polynomials of its bytes, mixed. Equal words have equal hashes; whoever uses it confirms what it finds."""
    if not len(words):
        return np.empty(0, np.uint64)
    sizes = np.diff(words.offsets)
    place = np.arange(len(words.data)) - np.repeat(words.offsets[:-1], sizes)
    powers = np.ones(int(sizes.max()), np.uint64)
    powers[1:] = _FACTOR
    powers = np.cumprod(powers)
    h = np.add.reduceat((words.data.astype(np.uint64) + np.uint64(1)) * powers[place], words.offsets[:-1])
    h = (h ^ sizes.astype(np.uint64)) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MORE
    return h ^ h >> np.uint64(29)
