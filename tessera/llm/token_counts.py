"""Token counts by heap-and-linked-list byte-pair merging.

A word's bytes form a doubly linked list. A heap holds every adjacent pair that has a merge rank; the lowest rank
(leftmost at ties) is popped and merged until none is left. The count is the number of initial symbols less the
number of merges: no token identifier is ever looked up or emitted.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a row's count does not depend on other rows, so
ties and repeated rows each get their own row; texts are counted whole, however long (merging takes one word at a time);
an empty table gives an empty result; columns other than the key and the text are not
read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a Python worker remembers; beyond it the memory is emptied. A speed setting only.
CACHE_WORDS = 600_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each of the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    spare = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + i) for i, b in enumerate(spare)})
    return [letters[b] for b in range(256)]


def merges_needed(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes in one word.

    Merged symbols live at their left position; `after` and `before` link the live positions. A heap entry whose two
    symbols have changed since it was pushed is stale and is skipped.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merged = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, ""
        merged += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return merged


class WordCounter:
    """Counts for one vocabulary file of the kind "BPE with word ends; lower case, white space dropped".

    Only the merge list, the word-end mark, the splitting pattern and the special strings of the file are used.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(self.split)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.chunks: dict[str, int] = {}

    def word(self, word: str) -> int:
        letters = self.letters
        symbols = [letters[b] for b in word.encode()]
        symbols[-1] += self.end
        return len(symbols) - (merges_needed(symbols, self.ranks) if len(symbols) > 1 else 0)

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch of normalised text; no word reaches across white space."""
        if (n := self.chunks.get(chunk)) is None:
            n = sum(map(self.word, self.words.findall(chunk)))
            if len(self.chunks) >= CACHE_WORDS:
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            # Letters are lower-cased one by one: no final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split() also cuts at four control characters that belong to words here.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return sum(map(self.word, self.words.findall(text)))
        parts, seen = text.split(), self.chunks
        try:
            return sum([seen[p] for p in parts])
        except KeyError:
            return sum(map(self.chunk, parts))

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token, as in the library's default."""
        if self.special is None or "<" not in text or not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, self.special.split(text)))


_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    """The worker's counter for a vocabulary; it outlives a task."""
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """`key`, n_bytes, n_tokens, over_limit for every row. No shuffle: one pass over the text in Arrow batches."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            n_tokens = pa.array([count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["key", "n_bytes", "n_tokens"])

    kind = source.schema["key"].dataType.simpleString()
    counted = source.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
