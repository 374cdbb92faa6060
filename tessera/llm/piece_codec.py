"""SentencePiece (BPE) encoding by a merge-type prefix table, and decoding.

For every prefix of a text the encoding of that prefix ends in one unique token. That token is a vocabulary match
that ends there (found by an automaton) and is compatible with the last token of the prefix before it: merging the
two tokens' characters together yields just these two tokens. The table keeps this last token for each prefix; the
ids are then read off backwards from the end.

No piece of the vocabulary goes on after a space mark that follows another character, so no merge reaches across
such a place: the text is cut there, and the table of each distinct stretch is filled once per worker memory.

Defined results: a null text counts as empty; an empty text has only the end id; rows are independent of each other,
so repeated rows repeat their result; texts are coded whole, however long; where two ways to split a text tie, it is
split as the library does; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Stretches (and token pairs) that a Python worker remembers; beyond it the memory is emptied. A speed setting only.
CACHE_STRETCHES = 400_000
CACHE_PAIRS = 1_000_000


class PieceCodec:
    """One vocabulary: its pieces, scores and byte pieces, and the prefix-table encoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end = model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.silent = set()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.byte_of[i] = i, value
            elif model.is_control(i):
                self.silent.add(i)
            elif not model.is_unknown(i):
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
        crossing = [p for p in self.ids if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing:
            raise ValueError(f"pieces go on across a space, so a text cannot be cut there: {crossing[:3]}")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.text_of = [p.replace(MARK, " ") for p in self.pieces]
        self.unknown = model.unk_id()
        if self.unknown >= 0:
            self.text_of[self.unknown] = model.decode([self.unknown])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.stretches: dict[str, str] = {}
        self.cut = re.compile(f"(?<=[^{MARK}])(?={MARK})")

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging: always the best-scored neighbouring pair, leftmost at ties. Used on token pairs only."""
        scores = self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        """Whether the characters of two tokens merge into just these two tokens."""
        key = (left, right)
        if (ok := self.pairs.get(key)) is None:
            ok = self.merged(list(left + right)) == [left, right]
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def tokens(self, stretch: str) -> list[str]:
        """The prefix table of one stretch, read backwards.

        Single characters outside the vocabulary belong to no piece: any neighbour is compatible with them.
        """
        n = len(stretch)
        ending: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for at, match in self.automaton.iter(stretch):
            ending[at].append(match)
        last: list[str] = []
        pairs, compatible = self.pairs, self.compatible
        for i in range(n):
            token = None
            for length, piece in ending[i]:
                start = i - length
                if start < 0:
                    token = piece
                    break
                before = last[start]
                ok = pairs.get((before, piece))
                if ok or (ok is None and compatible(before, piece)):
                    token = piece
                    break
            last.append(token or stretch[i])
        found, i = [], n
        while i > 0:
            found.append(last[i - 1])
            i -= len(found[-1])
        return found[::-1]

    def spelled(self, stretch: str) -> str:
        """Decimal ids of a stretch, joined by blanks."""
        found: list[str] = []
        for token in self.tokens(stretch):
            i = self.ids.get(token)
            if i is None:
                found.extend(str(self.bytes[b]) for b in token.encode())
            else:
                found.append(str(i))
        return " ".join(found)

    def encode_text(self, text: str) -> str:
        """Decimal ids of a whole text without the end id, joined by blanks; empty for an empty text."""
        if not text:
            return ""
        if MARK in text:
            parts = self.cut.split(MARK + text.replace(" ", MARK))
        elif "  " in text or text[0] == " " or text[-1] == " ":
            parts = self.cut.split((" " + text).replace(" ", MARK))
        else:
            parts = text.split(" ")  # each stands for a stretch that begins with one mark
        seen = self.stretches
        try:
            return " ".join([seen[p] for p in parts])
        except KeyError:
            return " ".join([self.remembered(p) for p in parts])

    def remembered(self, part: str) -> str:
        """A stretch's ids from memory; a part without a leading mark stands for one with it."""
        if (ids := self.stretches.get(part)) is None:
            ids = self.spelled(part if part[:1] == MARK else MARK + part)
            if len(self.stretches) >= CACHE_STRETCHES:
                self.stretches.clear()
            if len(part) <= 64:
                self.stretches[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text with the end id."""
        spelled = self.encode_text(text)
        return [*map(int, spelled.split()), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, marks as blanks, the added first blank taken off, byte runs as UTF-8.

        A byte that is part of no valid character becomes U+FFFD, one for each such byte. Control ids are silent.
        """
        if self.byte_of.keys().isdisjoint(ids):
            silent, text_of = self.silent, self.text_of
            text = "".join([text_of[i] for i in ids if i not in silent])
        else:
            out, run = [], bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(utf8(bytes(run)))
                    run.clear()
                if i not in self.silent:
                    out.append(self.text_of[i])
            text = "".join(out) + utf8(bytes(run))
        if text[:1] != " ":
            return text
        first = next((i for i in ids if i not in self.silent), self.unknown)
        return text if first == self.unknown or first in self.byte_of else text[1:]


def utf8(run: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is part of no valid character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for width in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + width].decode())
                    at += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Vocabulary:
    """A vocabulary to broadcast; a worker makes its codec when first asked. It outlives a task, but not the job: a
    worker that takes up a task without this broadcast lets go of it, with all that the codec remembers."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __reduce__(self) -> tuple:
        return Vocabulary, (self.path,)

    @cached_property
    def codec(self) -> PieceCodec:
        return PieceCodec(self.path)


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, ids (array of int, with the end id) and decoded text for every row. One pass, no shuffle."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))  # a path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.codec
        for batch in batches:
            ids = [own.encode(t.as_py()) for t in batch.column(1)]
            decoded = [own.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_tokens, ids_sha256, decoded_sha256: the same encoding and decoding, digested where it is made."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))  # a path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.codec
        sha = hashlib.sha256
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for t in batch.column(1):
                spelled = own.encode_text(t.as_py())
                spelled = f"{spelled} {own.end}" if spelled else str(own.end)
                ids = [*map(int, spelled.split(" "))]
                counts.append(len(ids))
                id_digests.append(sha(spelled.encode()).hexdigest())
                text_digests.append(sha(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
