"""Hashed text features, computed on whole texts with numpy: character n-grams and words.

A text becomes its code points; n-grams and words become 64-bit mixes of them, and the top bits of a mix its bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
GRAM = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Odd multipliers of the places in a word, and of each further 64 places.
PLACES, ROUNDS = np.random.default_rng(20).integers(0, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def gram_buckets(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of all character n-grams of the given sizes, one for each occurrence."""
    shift, found = np.uint64(64 - bits), []
    for n in sizes:
        if len(codes) < n:
            continue
        mixed = codes[: len(codes) - n + 1] * GRAM[0] + np.uint64(n)
        for k in range(1, n):
            mixed = mixed * MIX + codes[k : len(codes) - n + 1 + k] * GRAM[k]
        found.append((((mixed ^ (mixed >> np.uint64(29))) * MIX) >> shift).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def word_hashes(codes: np.ndarray, space: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word between white space (or where `space` is set), in order."""
    if not len(codes):
        return np.empty(0, np.uint64)
    if space is None:
        space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    opens = ~space
    opens[1:] &= space[:-1]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(codes)) - np.maximum(starts[np.maximum(np.cumsum(opens) - 1, 0)], 0)
    factor = PLACES[place & 63]
    if place.max() > 63:
        factor = factor * ROUNDS[(place >> 6) & 63]
    value = (codes + np.uint64(1)) * factor
    value[space] = 0
    return mixed(np.add.reduceat(value, starts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * GRAM[1]
    return x ^ (x >> np.uint64(32))


def word_buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of all words between white space, one for each occurrence."""
    return (word_hashes(codes) >> np.uint64(64 - bits)).astype(np.int64)


def sparse_counts(buckets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty buckets and their counts."""
    counts = np.bincount(buckets, minlength=size)
    some = np.flatnonzero(counts)
    return some, counts[some]


#: A random number for each byte, and the base of the powers by places, with its inverse modulo 2^64.
BYTES = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed together (one word at least), and bytes of text that are handled together (one text at least).
HASH_BYTES, SLICE_BYTES = 1 << 20, 4 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """base ** 0, base ** 1 and so on, modulo 2^64."""
    if len(_powers.get(base, ())) < size:
        factors = np.full(max(size, HASH_BYTES + 64), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base][:size]


@dataclass
class Words:
    """Word hashes of some texts, one text after another; those of text r stand from bounds[r] to bounds[r + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray

    def row(self, r: int) -> np.ndarray:
        return self.hashes[self.bounds[r] : self.bounds[r + 1]]

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(texts: pa.StringArray, separators: bytes) -> Words:
    """64-bit hashes of the words (stretches of other bytes than `separators`, which are ASCII) of texts without nulls.

    A word's hash is the sum of its bytes' random numbers times powers of BASE by place: a difference of running sums
    over all texts, moved back to place 0.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return Words(np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    inside = inside[data]
    opens, closes, edges = inside.copy(), np.zeros(size + 1, bool), offsets[(offsets > 0) & (offsets < size)]
    opens[1:] &= ~inside[:-1]
    opens[edges] = inside[edges]
    closes[1:-1] = inside[:-1] & ~inside[1:]
    closes[edges] = inside[edges - 1]
    closes[-1] = inside[-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(starts, starts[first] + HASH_BYTES))
        a, b = int(starts[first]), int(ends[last - 1])
        running = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTES[data[a:b]] * powers(BASE, b - a), out=running[1:])
        hashes[first:last] = (running[ends[first:last] - a] - running[starts[first:last] - a]) * powers(INVERSE, b - a)[starts[first:last] - a]
        first = last
    return Words(mixed(hashes + (ends - starts).astype(np.uint64) * GRAM[2]), np.searchsorted(starts, offsets).astype(np.int64))


class Rows:
    """Sparse rows with a label each, gathered in two flat buffers: many small arrays would take more memory, which a
    process does not give back."""

    def __init__(self, at_kind: str, value_kind: str):
        self.kinds, self.buffers = (at_kind, value_kind), (bytearray(), bytearray())
        self.ends, self.labels = [0], []

    def add(self, at: bytes | np.ndarray, values: bytes | np.ndarray, label: int) -> None:
        """A row: feature numbers and values, of the kinds given."""
        for buffer, own in zip(self.buffers, (at, values), strict=True):
            buffer += memoryview(own).cast("B")
        self.ends.append(len(self.buffers[0]) // np.dtype(self.kinds[0]).itemsize)
        self.labels.append(label)

    def views(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(feature numbers, values, label) of every row; no row can be added any more."""
        at, values = (np.frombuffer(b, kind) for b, kind in zip(self.buffers, self.kinds, strict=True))
        return [(at[a:b], values[a:b], label) for a, b, label in zip(self.ends, self.ends[1:], self.labels)]


def slices(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches that hold about SLICE_BYTES of text (in column number `text`, without nulls) each."""
    for batch in batches:
        dealt = np.cumsum(np.asarray(pc.binary_length(batch.column(text)), np.int64)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(dealt)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
