"""Static range asymmetric numeral coding of token ids: shared tables, interleaved lanes, checkpoints, checksums.

A block codes the ids of some whole documents. Token j belongs to lane j mod LANES, and one numpy step codes a row of
one token per lane. Every `CHECKPOINT_ROWS` rows the block keeps the lane states and the place in the word stream, so
a reader may start at any checkpoint and decode spans in parallel; each span has a CRC of its words, and the block has
one of its ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"TSRANS1\0"
#: Frequencies add up to 2**PRECISION; a state stays in [LOW, 2**32 * LOW) and moves words of 32 bits.
PRECISION = 20
LOW = np.uint64(1 << 31)
LANES_MOST = 2048
CHECKPOINT_ROWS = 256
HEAD = struct.Struct("<8sIQQIIIII")


@dataclass
class Tables:
    """Frequencies of all symbols (their sum is 2**PRECISION) and what coding derives from them."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.freq = self.freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        """The symbol of each of the 2**PRECISION slots."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbols


def normalised(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to the sum 2**PRECISION; every symbol that occurs keeps at least 1."""
    counts = counts.astype(np.float64)
    total, whole = counts.sum(), 1 << PRECISION
    if total == 0:
        counts, total = np.ones_like(counts), float(len(counts))
    freq = np.maximum(np.floor(counts * (whole / total)), counts > 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    excess = int(freq.sum()) - whole
    if excess < 0:
        freq[order[0]] -= excess
    while excess > 0:  # the most frequent symbols give, in proportion to what they have
        give = np.minimum(freq[order] - (freq[order] > 0), np.ceil(freq[order] * (excess / whole)).astype(np.int64))
        give = np.minimum(give, np.maximum(0, excess - np.concatenate([[0], np.cumsum(give)[:-1]])))
        freq[order] -= give
        excess = int(freq.sum()) - whole
    return freq.astype(np.uint64)


def encode_block(ids: np.ndarray, doc_lengths: np.ndarray, first: int, tables: Tables) -> bytes:
    """One block: head, document lengths, checkpoints, words. `first` is the number of ids before the block."""
    n = len(ids)
    lanes = 1
    while lanes < LANES_MOST and lanes * 128 < n:
        lanes *= 2
    rows = -(-n // lanes) if n else 0
    x = np.full(lanes, LOW, np.uint64)
    shift, word = np.uint64(PRECISION), np.uint64(32)
    limit_unit = np.uint64(1 << (63 - PRECISION))
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray, int]] = []
    emitted = 0
    freq_of, start_of = tables.freq[ids], tables.start[ids]
    for row in range(rows - 1, -1, -1):
        at = row * lanes
        f, s = freq_of[at : at + lanes], start_of[at : at + lanes]
        own = x[: len(f)]
        full = own >= f * limit_unit
        if full.any():
            out = own[full].astype(np.uint32)
            words.append(out)
            emitted += len(out)
            own[full] >>= word
        quotient = own // f
        own[:] = (quotient << shift) + (own - quotient * f) + s
        if row % CHECKPOINT_ROWS == 0:
            marks.append((row, x.copy(), emitted))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    marks.reverse()
    places = [len(stream) - m[2] for m in marks] + [len(stream)]
    payload = stream.astype("<u4")
    body = [doc_lengths.astype("<u4").tobytes()]
    for k, (row, states, _) in enumerate(marks):
        span = payload[places[k] : places[k + 1]].tobytes()
        body.append(struct.pack("<IQI", row, places[k], zlib.crc32(span)))
        body.append(states.astype("<u8").tobytes())
    body.append(payload.tobytes())
    ids_crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
    return HEAD.pack(MAGIC, tables.crc, first, n, len(doc_lengths), lanes, len(marks), len(stream), ids_crc) + b"".join(body)


def block_head(blob: bytes) -> dict:
    """The fields of a block, without decoding its ids."""
    magic, table_crc, first, n, docs, lanes, marks, words, ids_crc = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEAD.size
    lengths = np.frombuffer(blob, "<u4", docs, at)
    at += 4 * docs
    spans = []
    for _ in range(marks):
        row, place, crc = struct.unpack_from("<IQI", blob, at)
        spans.append((row, place, crc, np.frombuffer(blob, "<u8", lanes, at + 16)))
        at += 16 + 8 * lanes
    return {"table_crc": table_crc, "first": first, "n": n, "lanes": lanes, "lengths": lengths, "spans": spans, "words": np.frombuffer(blob, "<u4", words, at), "ids_crc": ids_crc}


def decode_span(head: dict, k: int, tables: Tables) -> np.ndarray:
    """The ids between checkpoint k and the next one; needs no other span."""
    row, place, crc, states = head["spans"][k]
    last = k + 1 == len(head["spans"])
    end_word = len(head["words"]) if last else head["spans"][k + 1][1]
    lanes, n = head["lanes"], head["n"]
    rows = -(-n // lanes) if last else head["spans"][k + 1][0]
    words = head["words"][place:end_word]
    if zlib.crc32(words.tobytes()) != crc:
        raise ValueError(f"checksum of span {k} differs")
    x = states.astype(np.uint64)
    shift, word, mask = np.uint64(PRECISION), np.uint64(32), np.uint64((1 << PRECISION) - 1)
    out = np.empty(min(n, rows * lanes) - row * lanes, np.uint32)
    at = 0
    for r in range(row, rows):
        to = (r - row) * lanes
        width = min(lanes, len(out) - to)
        own = x[:width]
        slot = own & mask
        symbol = tables.symbols[slot.astype(np.int64)]
        out[to : to + width] = symbol
        own[:] = tables.freq[symbol] * (own >> shift) + slot - tables.start[symbol]
        low = own < LOW
        count = int(np.count_nonzero(low))
        if count:
            own[low] = (own[low] << word) | words[at : at + count]
            at += count
    return out


def decode_block(blob: bytes, tables: Tables) -> tuple[dict, np.ndarray]:
    """All ids of a block, checked against its table and its checksums."""
    head = block_head(blob)
    if head["table_crc"] != tables.crc:
        raise ValueError("the block was coded with other tables")
    parts = [decode_span(head, k, tables) for k in range(len(head["spans"]))]
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")) != head["ids_crc"]:
        raise ValueError("checksum of the ids differs")
    return head, ids
