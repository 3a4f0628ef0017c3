"""Word shingles of whole Arrow batches in numpy: no Python object is made for a word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from storygauge.llm.common import per_process

SIZE = 5
CHUNK = 1 << 20  # bytes hashed at once; a longer text is a chunk of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_PARTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64."""
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


WHITE = np.zeros(256, bool)  # bytes between words
WHITE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Hashes of all words of a chunk of texts, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, up: np.ndarray, down: np.ndarray, between: np.ndarray = WHITE):
        blank = between[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.concatenate(([True], blank))[:-1] | first[:-1] if len(data) else blank
        after = np.concatenate((blank, [True]))[1:] | first[1:] if len(data) else blank
        starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)))
        self.hashes = mixed((sums[ends] - sums[starts]) * down[starts])
        self.starts, self.ends, self.places = starts, ends, np.searchsorted(starts, offsets)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the shingle that starts at each word; only those that end in the same text are meant to be used."""
        w = self.hashes
        if len(w) < SIZE:
            return np.empty(0, np.uint64), self.places
        total = w[:len(w) - SIZE + 1] * _PARTS[0]
        for i in range(1, SIZE):
            total += w[i:len(w) - SIZE + 1 + i] * _PARTS[i]
        return mixed(total), self.places


def chunks(column: pa.Array, between: np.ndarray = WHITE, size: int = CHUNK) -> Iterator[Words]:
    """The words of all texts, about ``size`` bytes of whole texts at a time."""
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, place, held = column.buffers()
    offsets = np.frombuffer(place, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    begin, up, down = 0, *(per_process("powers", lambda: powers(CHUNK)) if size == CHUNK else powers(int(offsets[-1] - offsets[0])))
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        chunk, at = data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]
        sides = (up, down) if len(chunk) < len(up) else powers(len(chunk))
        words = Words(chunk, at, *sides, between)
        words.data = chunk
        yield words
        begin = end


def of_texts(column: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text its shingle hashes, repeats included, and a 128-bit digest of its sequence of words.

    Words are runs of other than white space. Fewer than five words are one shingle; no words are none. Nulls are empty.
    """
    for words in chunks(column):
        shingles, places = words.shingles()
        for i in range(len(places) - 1):
            a, b = places[i], places[i + 1]
            own = words.hashes[a:b]
            if b - a >= SIZE:
                found = shingles[a:b - SIZE + 1]
            elif b > a:
                found = mixed((own * _PARTS[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                found = own
            yield found, hashlib.blake2b(own.tobytes(), digest_size=16).digest()
