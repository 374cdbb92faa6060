"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks.

Benchmark items and passages of documents (windows of 32 and of 64 words, starting at every 16th word) are TF-IDF
vectors over 2^16 buckets of word hashes; document frequencies come from all documents. A randomised SVD, whose sums
over the passages Spark makes, takes them to a latent space of `RANK` dimensions. It is fitted on every document of the
corpus, cut into passages of 64 words: their leading directions are summed up once, and decomposed together with the
items, both with the same total weight, so words that stand together in the corpus come to lie together, whether items
have them or not.

An item longer than a passage is searched by parts of at most a passage's length. `GROUP_PARTS` parts share a space, a
search of the corpus holds up to `PASS_GROUPS` spaces, and a larger benchmark takes further searches; so what workers
hold does not grow with the benchmark, and any length of item or benchmark is searched. Every passage is compared with
every part. A part whose latent cosine with a passage is at least `COSINE` is a candidate, and counts if the longest
common subsequence of words with the passage's surroundings, as wide as the item on each side, covers enough of the
whole item, and of its answer (its last sentence). Subsequences are only taken where the surroundings hold as many of
the item's words as they need; that is counted for all candidates of an item in a batch at once.

Idf is that of a corpus of `IDF_DOCUMENTS` documents with the same shares where there are more, so that cosines do not
change as the corpus grows.

Defined results: null and empty texts, and items without words, match nothing; an empty table or benchmark gives an
empty result; rows that share a key, and repeated items, give one row per pair of key and item, with the best cosine
and covers; other columns are not read; a text is searched whole, however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.hashing import PLACES, Words, mixed, slices, words_of

#: Words per block, and blocks per passage.
BLOCK, WINDOWS = 16, (2, 4)
LONGEST = BLOCK * WINDOWS[-1]
#: Features are the top bits of word hashes.
BITS = 16
FEATURES = 1 << BITS
#: Dimensions of a latent space, leading directions of the corpus.
RANK, DIRECTIONS = 64, 80
#: Least share of the largest eigenvalue that is more than rounding.
LEAST = 1e-5
#: Parts of items that share a space; spaces that one search holds.
GROUP_PARTS, PASS_GROUPS = 256, 8
#: Least latent cosine of a candidate; least share of the item, and of its answer, that the subsequence covers.
COSINE, COVER, ANSWER = 0.7, 0.7, 0.5
#: A task of the passes over all passages takes so many distinct words of documents, if there are as many tasks as cores:
#: each writes sums of up to FEATURES rows, however little it reads.
TASK_WORDS = 1 << 21
#: Idf is that of a corpus of so many documents at most.
IDF_DOCUMENTS = 10_000
#: Blocks or passages that are handled together; features of no more of these passages are added up side by side.
CHUNK, SELDOM = 4096, 16
#: Words of items in stretches that are counted together (one stretch at least).
HITS = 1 << 18
#: ASCII but digits and letters separates words.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())


def words(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a text."""
    return lowered(pa.array([text], pa.string())).hashes


def lowered(texts: pa.StringArray) -> Words:
    return words_of(pc.utf8_lower(texts), SEPARATORS)


def features_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def answer_of(text: str) -> str:
    """The last sentence."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine word row per element of b."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for x in b:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def parts_of(item: np.ndarray) -> list[np.ndarray]:
    """An item's words in parts of about equal length, none longer than the longest passage."""
    return np.array_split(item, -(-len(item) // LONGEST))


@dataclass
class Portion:
    """Items of one search: keys, word hashes of each item and answer, and parts of items as (item, word hashes)."""

    keys: list = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)
    answers: list[np.ndarray] = field(default_factory=list)
    parts: list[tuple[int, np.ndarray]] = field(default_factory=list)

    def add(self, key: object, item: np.ndarray, answer: np.ndarray, parts: list[np.ndarray]) -> None:
        self.parts += [(len(self.items), p) for p in parts]
        self.keys.append(key)
        self.items.append(item)
        self.answers.append(answer)

    def groups(self) -> list[list[np.ndarray]]:
        """The word hashes of parts, by the space they share."""
        parts = [p for _, p in self.parts]
        return [parts[i : i + GROUP_PARTS] for i in range(0, len(parts), GROUP_PARTS)]


def portions(benchmark: DataFrame, item: str, text: str) -> Iterator[Portion]:
    """The benchmark in portions of at most GROUP_PARTS * PASS_GROUPS parts (one item at least)."""
    own, last = Portion(), None
    for row in benchmark.select(item, text).where(F.col(item).isNotNull() & F.col(text).isNotNull()).orderBy(item, text).toLocalIterator():
        found = words(row[1])
        if not len(found) or tuple(row) == last:
            continue
        last, parts = tuple(row), parts_of(found)
        if own.parts and len(own.parts) + len(parts) > GROUP_PARTS * PASS_GROUPS:
            yield own
            own = Portion()
        own.add(row[0], found, words(answer_of(row[1])), parts)
    if own.parts:
        yield own


def document_frequencies(own: Words) -> np.ndarray:
    """How many of the texts have each feature."""
    found, features = np.zeros(FEATURES, np.int64), features_of(own.hashes)
    for low in range(0, len(own.bounds) - 1, 1 << 16):  # a row and a feature fit 32 bits
        bounds = own.bounds[low : low + (1 << 16) + 1]
        row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint32), np.diff(bounds))
        met = np.sort((row << np.uint32(BITS)) | features[bounds[0] : bounds[-1]].astype(np.uint32))
        met = met[np.append(True, met[1:] != met[:-1])] if len(met) else met
        found += np.bincount(met & np.uint32(FEATURES - 1), minlength=FEATURES)
    return found


def idf_of(df: np.ndarray, total: int) -> np.ndarray:
    most = min(total, IDF_DOCUMENTS)
    return np.log((1.0 + most) / (1.0 + df * (most / max(1, total)))) + 0.1


def unit(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a passage and their TF-IDF values, at unit length."""
    some, n = np.unique(features_of(hashes), return_counts=True)
    x = n * idf[some]
    return some, (x / (math.sqrt(float(x @ x)) or 1.0)).astype(np.float32)


def corpus_of(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, DataFrame]:
    """Idf of every feature, and the staged features of the words of every document (`words`, two bytes each)."""
    total = docs.count()
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES, np.int64)
        for batch in slices(batches, 0):
            own = lowered(batch.column(0))
            df += document_frequencies(own)
            held = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(own.bounds * 2), pa.py_buffer(features_of(own.hashes).astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([held.cast(pa.binary()), pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.int64())], ["words", "f", "n"])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(df[some])], ["words", "f", "n"])

    seen = staged(source.mapInArrow(run, "words binary, f int, n long"), "words")
    df = np.zeros(FEATURES)
    for row in seen.where(F.col("f").isNotNull()).groupBy("f").agg(F.sum("n").alias("n")).toLocalIterator():  # one row per feature
        df[row["f"]] = row["n"]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(df.sum()) // TASK_WORDS)
    return idf_of(df, total), seen.where(F.col("f").isNull()).select("words").coalesce(tasks)


def passages_of(held: pa.BinaryArray) -> Iterator[np.ndarray]:
    """Features of the passages (consecutive words, LONGEST each) of all documents of a batch, sorted within a passage,
    up to CHUNK passages at a time; FEATURES fills up short ones."""
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64) // 2
    features = np.frombuffer(held.buffers()[2] or b"", np.uint16)
    sizes = -(-np.diff(offsets) // LONGEST)
    ends = np.cumsum(sizes)
    for low in range(0, int(sizes.sum()), CHUNK):
        number = np.arange(low, min(low + CHUNK, int(ends[-1])))
        row = np.searchsorted(ends, number, side="right")
        start = offsets[row] + LONGEST * (number - ends[row] + sizes[row])
        at = start[:, None] + np.arange(LONGEST)
        yield np.sort(np.where(at < offsets[row + 1][:, None], features[np.minimum(at, offsets[-1] - 1)], np.int32(FEATURES)), axis=1)


def add_products(passages: np.ndarray, idf: np.ndarray, basis: np.ndarray | None, total: np.ndarray) -> None:
    """Add X'(X G) to `total`: X has a unit row for each passage, G is `basis`; without a basis X'S, where S has one
    random sign for each passage, in a random column. Both `idf` and `basis` end in zeros, for no word."""
    flat = passages.ravel()
    edges = np.flatnonzero(np.diff(flat, prepend=-1) | (np.arange(len(flat)) % LONGEST == 0))  # runs of one feature in a passage
    counts = np.diff(edges, append=len(flat))[some := flat[edges] < FEATURES]
    f, row = flat[edges[some]].astype(np.uint16), edges[some] // LONGEST
    x = counts * idf[f]
    squares = np.maximum(np.bincount(row, x * x, len(passages)), 1e-12)
    if basis is None:
        column = mixed(passages.astype(np.uint64) @ PLACES)  # of its words, so that it is the same when computed again
        signs = np.where(column >> np.uint64(63), 1.0, -1.0) / np.sqrt(squares)
        return np.add.at(total.reshape(-1), f * np.int64(total.shape[1]) + (column % np.uint64(total.shape[1])).astype(np.int64)[row], (x * signs[row]).astype(np.float32))
    y = np.empty((len(passages), basis.shape[1]), np.float32)
    for low in range(0, len(passages), 256):
        own = passages[low : low + 256]
        y[low : low + 256] = np.matmul(idf[own][:, None, :], np.take(basis, own, axis=0))[:, 0]
    y /= squares[:, None].astype(np.float32)  # both rows at unit length
    order = np.argsort(f, kind="stable")
    f, row, x = f[order].astype(np.int64), row[order], x[order].astype(np.float32)
    first = np.flatnonzero(np.diff(f, prepend=-1))
    sizes = np.diff(first, append=len(f))
    for a, b in zip(first[often := sizes > SELDOM].tolist(), (first + sizes)[often].tolist(), strict=True):
        total[f[a]] += x[a:b] @ y[row[a:b]]
    for k in range(SELDOM):  # the k-th passage of each seldom feature
        at = first[~often & (sizes > k)] + k
        for low in range(0, len(at), 1 << 13):
            own = at[low : low + (1 << 13)]
            total[f[own]] += x[own, None] * y[row[own]]


def make_orthonormal(made: np.ndarray) -> None:
    """Put an orthonormal basis of its columns in place of `made`: from the QR of each of 16 blocks of rows, and that of
    all blocks' triangles, so that no more than a block at a time is held in double precision."""
    blocks = np.array_split(made, 16)
    triangles = [np.linalg.qr(own.astype(np.float64))[1] for own in blocks]
    turned = np.split(np.linalg.qr(np.vstack(triangles))[0], np.cumsum([len(t) for t in triangles])[:-1])
    for own, turn in zip(blocks, turned, strict=True):
        own[:] = np.linalg.qr(own.astype(np.float64))[0] @ turn


def corpus_directions(corpus: DataFrame, idf: np.ndarray) -> np.ndarray:
    """B (features x DIRECTIONS), so that B B' is X'X / n, X being the unit rows of all n passages of the corpus, as
    far as its leading directions go.

    A first sum X'S, with a random sign for each passage, gives a basis G; a second one, Y = X'(X G), gives X'X as
    Y (G'Y)^-1 Y' (Nystrom). Both run over all passages.
    """
    spark, width = corpus.sparkSession, DIRECTIONS

    def summed(basis: np.ndarray | None) -> tuple[np.ndarray, int]:
        given = spark.sparkContext.broadcast((np.append(idf, 0.0).astype(np.float32), basis))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (own_idf, basis), n = given.value, 0
            total = np.zeros((FEATURES + 1, width), np.float32)
            for batch in slices(batches, 0):
                for passages in passages_of(batch.column(0)):
                    n += len(passages)
                    add_products(passages, own_idf, basis, total)
            some = np.flatnonzero(total[:FEATURES].any(1)).astype(np.int32)
            for at in np.split(some, np.flatnonzero(np.diff(some >> 8)) + 1) if n else []:
                yield pa.RecordBatch.from_arrays([pa.array([int(at[0]) >> 8] if len(at) else [0], pa.int32()), pa.array([at.tobytes()]), pa.array([total[at].tobytes()]), pa.array([n])], ["block", "at", "sums", "n"])
                n = 0

        def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros((256, width)), 0
            for part in parts:
                for at, own in zip(part["at"], part["sums"], strict=True):
                    sums[np.frombuffer(at.as_buffer(), np.int32) & 255] += np.frombuffer(own.as_buffer(), np.float32).reshape(-1, width)
                n += pc.sum(part["n"]).as_py()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sums.astype(np.float32).tobytes()]), pa.array([n])], ["block", "sums", "n"])

        made, n = np.zeros((FEATURES + 1, width), np.float32), 0  # a last row of zeros, for no word
        added = corpus.mapInArrow(run, "block int, at binary, sums binary, n long").groupBy("block").applyInArrow(add, "block int, sums binary, n long")
        for row in added.toLocalIterator():  # FEATURES / 256 rows at most
            made[row["block"] << 8 : (row["block"] + 1) << 8] = np.frombuffer(row["sums"], np.float32).reshape(256, width)
            n += row["n"]
        given.destroy()  # on the driver too
        return made, n

    basis = summed(None)[0]
    make_orthonormal(basis[:FEATURES])
    made, n = summed(basis)
    basis, made = basis[:FEATURES], made[:FEATURES]
    small = (basis.T @ made).astype(np.float64)
    del basis
    values, turned = np.linalg.eigh((small + small.T) / 2)
    some = values > LEAST * values[-1]
    return made @ (turned[:, some] / np.sqrt(values[some] * max(1, n))).astype(np.float32)


def latent_spaces(corpus: DataFrame, groups: list[list[np.ndarray]], idf: np.ndarray, directions: np.ndarray | None = None) -> list[np.ndarray]:
    """All spaces of `each_space`."""
    return list(each_space(groups, idf, corpus_directions(corpus, idf) if directions is None else directions))


def each_space(groups: list[list[np.ndarray]], idf: np.ndarray, directions: np.ndarray) -> Iterator[np.ndarray]:
    """For each group of parts, the leading right singular vectors (features x dimensions) of its items and the corpus.

    The matrix has a unit row for each part, and the corpus's directions, scaled so that all its passages weigh as much
    as all parts. Its Gram matrix has as many rows as there are parts and directions, and is decomposed on the driver.
    """
    for group in groups:
        vectors = [unit(p, idf) for p in group]
        held, at = np.unique(np.concatenate([f for f, _ in vectors]), return_inverse=True)
        parts = np.zeros((len(group), len(held)), np.float32)
        parts[np.repeat(np.arange(len(group)), [len(f) for f, _ in vectors]), at] = np.concatenate([x for _, x in vectors])
        across, scale = parts @ directions[held], math.sqrt(len(group))
        gram = np.block([[(directions.T @ directions) * len(group), across.T * scale], [across * scale, parts @ parts.T]])
        values, turned = (x[..., ::-1][..., :RANK] for x in np.linalg.eigh(gram.astype(np.float64)))
        turned = (turned * np.where(values > LEAST * values[0], 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)).astype(np.float32)  # what has no weight is no direction
        axes = directions @ (turned[: directions.shape[1]] * np.float32(scale))
        axes[held] += parts.T @ turned[directions.shape[1] :]
        yield axes


@dataclass
class Space:
    """A latent space: for each feature what a word of it adds to a passage's place (a last row of zeros stands for no
    word), and the places of the parts from number `first` on, at unit length."""

    first: int
    adds: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, first: int, axes: np.ndarray, idf: np.ndarray, group: list[np.ndarray]) -> Space:
        adds = np.zeros((len(axes) + 1, axes.shape[1]), np.float32)
        np.multiply(axes, idf[:, None].astype(np.float32), out=adds[:-1])
        parts = np.array([adds[features_of(p)].sum(0) for p in group])
        return cls(first, adds, (parts / np.maximum(np.linalg.norm(parts, axis=1, keepdims=True), 1e-9)).astype(np.float32))

    def candidates(self, features: np.ndarray, after: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(blocks, parts, cosines, blocks per passage) of candidates; `features` are blocks x words, `after[k]` says
        where the k-th next block belongs to the same document. A document's last passages may be shorter."""
        reach = WINDOWS[-1] - 1
        for low in range(0, len(features), CHUNK):
            size = min(CHUNK, len(features) - low)
            high = min(len(features), low + size + reach)
            part = self.adds[features[low:high]].sum(1)
            own, span = part, 1
            while span < WINDOWS[-1]:
                longer = own.copy()
                longer[: len(own) - span] += own[span:] * after[span][low : high - span, None]
                own, span = longer, 2 * span
                if span in WINDOWS:
                    length = np.maximum(np.sqrt(np.einsum("ij,ij->i", own[:size], own[:size])), 1e-9)
                    cosines = own[:size] @ self.parts.T
                    at, c = np.divmod(np.flatnonzero(cosines >= COSINE * length[:, None]), len(self.parts))
                    yield at + low, c + self.first, cosines[at, c] / length[at], span


def blocks_of(own: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every document's blocks (blocks x words, short ones filled up), and each block's row and first word."""
    counts = np.diff(own.bounds)
    sizes = -(-counts // BLOCK)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = own.bounds[row] + inside * BLOCK
    at = start[:, None] + np.arange(BLOCK)
    features = np.append(features_of(own.hashes), FEATURES)
    return features[np.where(at < own.bounds[row + 1][:, None], at, len(own.hashes))], row, start


@dataclass
class Vocabulary:
    """The distinct words of some items: their hashes, sorted, and for each item its words' places among them, with the
    times that it has each."""

    hashes: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Vocabulary:
        hashes = np.unique(np.concatenate(items))
        return cls(hashes, [np.unique(np.searchsorted(hashes, item), return_counts=True) for item in items])

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word; for a word of no item one beyond the last."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, place, len(self.hashes))


def enough(places: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray, least: float) -> np.ndarray:
    """Which stretches of words, from `low` up to `high` in rows in ascending order, hold so many of an item's words
    that a common subsequence of length `least` is possible. `times` says for each place of the vocabulary how often the
    item has that word."""
    edges = np.flatnonzero(np.diff(row, prepend=-1))
    first, last = np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges)
    at = ranges(first, last - first)
    hits = at[times[places[at]] > 0]
    word = places[hits]
    first, last = np.searchsorted(hits, low), np.searchsorted(hits, high)
    fit = last - first >= least
    order = np.argsort(word, kind="stable")
    before, same = np.full(len(hits), -1), word[order[1:]] == word[order[:-1]]
    before[order[1:][same]] = order[:-1][same]  # the same word's last hit before each
    some = np.flatnonzero(fit)
    dealt = np.cumsum((last - first)[some]) // HITS
    for own in np.split(some, np.flatnonzero(np.diff(dealt)) + 1) if len(some) else []:
        sizes = last[own] - first[own]
        at = ranges(first[own], sizes)
        new = before[at] < np.repeat(first[own], sizes)  # the word's first hit in the stretch
        fit[own] = np.add.reduceat(times[word[at]] * new, np.cumsum(sizes) - sizes) >= least
    return fit


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 and so on, sizes[0] of them, then those from first[1] on, and so on."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def covered(text: np.ndarray, low: np.ndarray, high: np.ndarray, item: list[int], answer: list[int]) -> tuple[float, float] | None:
    """The best cover of the item, with its answer's, in stretches of words; None if none is enough."""
    best = None
    for a, b in dict.fromkeys(zip(low.tolist(), high.tolist(), strict=True)):
        around = text[a:b].tolist()
        cover = common_subsequence(item, around) / len(item)
        if cover >= COVER and cover > (best or (0.0, 0.0))[0]:
            told = common_subsequence(answer, around) / len(answer) if answer else 1.0
            if told >= ANSWER:
                best = (cover, told)
                if cover == 1.0:
                    break
    return best


def search(docs: DataFrame, portion: Portion, spaces: list[Space], key: str, text: str) -> DataFrame:
    """Rows (key, number of the item, cosine, cover, answer_cover) of the candidates that pass the checks."""
    shared = docs.sparkSession.sparkContext.broadcast((portion, spaces))  # bounded: PASS_GROUPS spaces, GROUP_PARTS parts each
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spaces = shared.value
        item_of, known = np.array([i for i, _ in own.parts]), Vocabulary.of(own.items)
        times = np.zeros(len(known.hashes) + 1, np.int32)
        for batch in slices(batches, 1):
            found = lowered(batch.column(1))
            features, row, start = blocks_of(found)
            after = {k: row[k:] == row[:-k] for k in (2**i for i in range(WINDOWS[-1].bit_length() - 1))}
            met = [(at, item_of[part], cosines, np.full(len(at), span)) for space in spaces for at, part, cosines, span in space.candidates(features, after)]
            at, item, cosines, spans = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.empty(0, np.int64),) * 4
            order = np.lexsort((-cosines, row[at], item))
            at, item, cosines, spans = at[order], item[order], cosines[order], spans[order]
            start, row, places, rows = start[at], row[at], known.places(found.hashes), []
            edges = np.flatnonzero(np.diff(item, prepend=-1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(at)]):
                i, r = int(item[a]), row[a:b]
                whole, side = own.items[i], max(2 * BLOCK, len(own.items[i]))
                low, high = np.maximum(start[a:b] - side, found.bounds[r]), np.minimum(start[a:b] + spans[a:b] * BLOCK + side, found.bounds[r + 1])
                some, counts = known.items[i]
                times[some] = counts
                fit = enough(places, r, low, high, times, COVER * len(whole) - 1e-9)
                times[some] = 0
                if not fit.any():
                    continue
                first = np.flatnonzero(np.diff(r, prepend=-1))  # of each row: its best cosine
                for c, d in zip(first.tolist(), [*first[1:].tolist(), b - a]):
                    if fit[c:d].any() and (best := covered(found.hashes, low[c:d][fit[c:d]], high[c:d][fit[c:d]], whole.tolist(), own.answers[i].tolist())):
                        rows.append((int(r[c]), i, float(cosines[a + c]), *best))
            if rows:
                at, number, *values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(number, pa.int32()), *(pa.array(v, pa.float64()) for v in values)], ["key", "number", "cosine", "cover", "answer_cover"])

    return source.mapInArrow(run, f"key {kind}, number int, cosine double, cover double, answer_cover double")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """`key`, `item`, cosine, cover, answer_cover: one row for each document and item that it holds."""
    spark, measures = docs.sparkSession, ("cosine", "cover", "answer_cover")
    item_kind = benchmark.schema[item].dataType.simpleString()
    result, corpus = None, None
    for portion in portions(benchmark, item, text):
        if corpus is None:
            idf, held = corpus_of(docs, key, text)
            corpus = idf, held, corpus_directions(held, idf)
        idf, held, directions = corpus
        groups = portion.groups()
        spaces = [Space.of(GROUP_PARTS * g, axes, idf, groups[g]) for g, axes in enumerate(each_space(groups, idf, directions))]
        names = F.broadcast(spark.createDataFrame(list(enumerate(portion.keys)), f"number int, `{item}` {item_kind}"))  # a portion's items
        found = search(docs, portion, spaces, key, text).join(names, "number").drop("number")
        del spaces  # the workers' copy is a broadcast
        result = found if result is None else staged(result, "contaminated").unionByName(staged(found, "contaminated"))
    if result is None:
        return docs.select(F.col(key), F.lit(None).cast(item_kind).alias(item), *[F.lit(0.0).alias(c) for c in measures]).where(F.lit(False))
    return result.groupBy("key", item).agg(*[F.max(c).alias(c) for c in measures]).withColumnRenamed("key", key)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents that hold no benchmark item."""
    held = contaminated(docs, benchmark, key, text, item).select(key).distinct()
    return docs.join(held, key, "left_anti")
