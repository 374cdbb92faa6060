"""Token-id output: texts to token ids to files of entropy-coded blocks, and back.

Steps, each a Spark job over the whole table:

1. documents are dealt out by ranges of the key and sorted, so that the ids of one partition are consecutive;
2. each partition is tokenised once; ids and their place in the partition are staged in the shared folder;
3. the ids' counts over all documents (one row per id of the vocabulary at most) give the shared frequency tables,
   and the partitions' totals (one row per partition) give the place of each partition in the whole sequence;
4. the staged ids are coded in blocks of whole documents and written. A file is a Parquet container whose rows are
   self-contained blocks (`tessera.llm.rans`); the tables are written beside it.

Defined results: a null text counts as empty and yields the end id alone; null keys come first; keys are of any type
that Spark orders; rows that share a key stay separate rows, in the order of their texts' hashes; an empty table
yields a file set without blocks; other columns are not read. A very long text makes one long block.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, staged
from tessera.llm.hashing import slices
from tessera.llm.rans import Tables, decode_block, encode_block, normalised

#: A block is closed once it holds this many ids; a longer document makes a longer block.
BLOCK_TOKENS = 1_000_000
#: Stretches that a Python worker remembers; beyond it the memory is emptied. A speed setting only.
CACHE_STRETCHES = 1_000_000
#: New stretches that go to the library as one text.
BULK_STRETCHES = 4096
#: White space but blank and line feed; a text with any of it goes to the library whole.
RARE_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (0x0A, 0x20)]


class Places(dict):
    """The number of each remembered stretch; an unknown one gets the next number and is noted in `new`."""

    def __init__(self) -> None:
        super().__init__({"": 0})  # the place of a text's head
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        self.new.append(stretch)
        self[stretch] = number = len(self)
        return number


class StretchTokenizer:
    """The tokenizers library, asked once per distinct stretch of text.

    A byte-level vocabulary whose splitting pattern lets a word start with one blank never joins across a blank, or a
    line feed, that stands between visible characters. So a text is cut before them, and the ids of a stretch are
    remembered. New stretches go to the library together, as one text, and are told apart by the ids that begin with
    the blank or the line feed. Other texts (white space in a row, special strings) go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; Spark runs tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.size = size
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = {" ": np.zeros(size, bool), "\n": np.zeros(size, bool)}
        for token, i in self.library.get_vocab().items():
            self.opens[" "][i] = token.startswith("Ġ")
            self.opens["\n"][i] = token.startswith("Ċ")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        """Whether the text may be cut: blanks and line feeds stand alone between visible characters, nothing special occurs."""
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
            return False
        return not any([c in text for c in RARE_SPACE]) and not any([s in text for s in self.special])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian integers of `kind`."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [own.tobytes() for own in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def encode_column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has. Only distinct stretches are looked up."""
        if not len(texts):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        if len(self.seen) > CACHE_STRETCHES:
            self.forget()
        strings = texts.to_pylist()
        plain = [bool(t) and self.plain(t) for t in strings]
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(plain, pa.bool_()), texts, ""), "\n", " \n"), " ")
        firsts = np.asarray(cut.offsets)[:-1]
        heads = self.whole([h if p else t for h, p, t in zip(cut.values.take(pa.array(firsts)).to_pylist(), plain, strings, strict=True)])
        parts = cut.values.dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(parts.dictionary)], parts.dictionary), " ")[0].as_py().split(" ")
        numbers = np.fromiter(map(self.seen.__getitem__, distinct), np.int64, len(distinct))
        if self.seen.new:
            self.learn(self.seen.new)
        numbers = numbers[np.asarray(parts.indices)]

        # The ids of stretch k are pool[starts[k] : starts[k] + lengths[k]]; the heads stand behind what is remembered.
        head_lengths = np.array([len(h) // self.kind.itemsize for h in heads], np.int64)
        pool = np.concatenate([self.pool[: self.filled], np.frombuffer(b"".join(heads), self.kind)])
        starts, lengths = self.starts[numbers], self.lengths[numbers]
        starts[firsts], lengths[firsts] = self.filled + np.cumsum(head_lengths) - head_lengths, head_lengths
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return pool[at], np.add.reduceat(lengths, firsts)

    def forget(self) -> None:
        """Start with an empty memory."""
        self.seen = Places()
        self.pool, self.filled = np.empty(1 << 16, self.kind), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def remember(self, stretches: list[str], ids: np.ndarray, starts: np.ndarray) -> None:
        """`starts` are the places in `ids` where the ids of each stretch begin."""
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool) + len(ids), self.kind)])
        if len(self.seen) > len(self.starts):
            more = np.zeros(len(self.seen), np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.pool[self.filled : self.filled + len(ids)] = ids
        numbers = np.fromiter(map(self.seen.__getitem__, stretches), np.int64, len(stretches))
        self.starts[numbers], self.lengths[numbers] = starts + self.filled, np.diff(starts, append=len(ids))
        self.filled += len(ids)

    def learn(self, new: list[str]) -> None:
        """Remember the ids of new stretches: those with a line feed as they are, others with a blank before them."""
        self.seen.new = []
        by_start = {"\n": [p for p in new if p[0] == "\n"], " ": [p for p in new if p[0] != "\n"]}
        for start, own in by_start.items():
            groups = [own[i : i + BULK_STRETCHES] for i in range(0, len(own), BULK_STRETCHES)]
            for group in groups:
                ids = np.frombuffer(self.whole(["".join(group) if start == "\n" else " " + " ".join(group)])[0], self.kind)
                starts = np.flatnonzero(self.opens[start][ids])
                if len(starts) != len(group):  # a start inside a stretch: ask for each alone
                    alone = self.whole([p if start == "\n" else " " + p for p in group])
                    lengths = np.array([len(i) // self.kind.itemsize for i in alone], np.int64)
                    ids, starts = np.frombuffer(b"".join(alone), self.kind), np.cumsum(lengths) - lengths
                self.remember(group, ids, starts)


_tokenizers: dict[str, StretchTokenizer] = {}


def tokenizer(path: str) -> StretchTokenizer:
    """The worker's tokenizer for a vocabulary; it outlives a task."""
    if path not in _tokenizers:
        _tokenizers[path] = StretchTokenizer(path)
    return _tokenizers[path]


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, key: str, text: str) -> DataFrame:
    """Staged rows (shard, key, place in the shard, n_tokens, ids), sorted by key within and across shards.

    The ranges go by text hash and row number too, so that a key, or a row, that stands often is split.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), whole.alias("text"), F.xxhash64(whole).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange("key", "_hash", "_row").sortWithinPartitions("key", "_hash", "_row").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, place, shard = tokenizer(vocabulary), 0, TaskContext.get().partitionId()
        for some in slices(batches, 1):
            ids, counts = own.encode_column(some.column(1))
            ends = np.cumsum(counts)
            ids, counts = np.insert(ids, ends, end_id), counts + 1
            bounds = np.concatenate([[0], np.cumsum(counts)])
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((bounds * own.kind.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), shard, np.int32)), some.column(0), pa.array(place + bounds[:-1]), pa.array(counts), blobs], ["shard", "key", "place", "n_tokens", "ids"])
            place += int(bounds[-1])

    kind = rows.schema["key"].dataType.simpleString()
    return staged(rows.mapInArrow(run, f"shard int, key {kind}, place long, n_tokens long, ids binary"), "token-ids")


def counted(ids: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """Occurrences of every id in all documents. At most one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            blobs = batch.column(0)
            offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            ids = np.frombuffer(blobs.buffers()[2], kind, (int(offsets[-1]) - int(offsets[0])) // kind.itemsize, int(offsets[0])) if len(blobs) else []
            total += np.bincount(ids, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def write_token_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write `path`/tables and `path`/blocks: the ids of all documents in ascending order of the key."""
    spark = docs.sparkSession
    own = tokenizer(vocabulary)
    size, kind = max(own.size, end_id + 1), own.kind
    ids = tokenised(docs, vocabulary, end_id, key, text)
    freq = normalised(counted(ids, size, kind))
    totals = {r["shard"]: r["n"] for r in ids.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, before = {}, 0
    for shard in sorted(totals):
        bases[shard], before = before, before + totals[shard]
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id int, freq long").coalesce(1).write.mode("overwrite").parquet(f"{path}/tables")
    tables_of = spark.sparkContext.broadcast(freq)  # one entry per id of the vocabulary
    key_kind = ids.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(tables_of.value)
        keys, parts, first, expected, held, key_arrow = [], [], 0, -1, 0, None

        def block() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], np.int64)
            blob = encode_block(np.concatenate(parts), lengths, first, tables)
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([keys], pa.list_(key_arrow)), pa.array([blob], pa.binary())], ["first", "keys", "block"])

        for batch in batches:
            key_arrow = batch.schema.field("key").type
            columns = [batch.column(c) for c in ("shard", "key", "place", "ids")]
            for shard, own_key, place, value in zip(*columns, strict=True):
                start = bases[shard.as_py()] + place.as_py()
                if parts and (held >= BLOCK_TOKENS or start != expected):
                    yield block()
                    keys, parts, held = [], [], 0
                if not parts:
                    first = start
                some = np.frombuffer(value.as_py(), kind)
                keys.append(own_key.as_py())
                parts.append(some)
                held += len(some)
                expected = start + len(some)
        if parts:
            yield block()

    coded = ids.select("shard", "key", "place", "ids").mapInArrow(run, f"first long, keys array<{key_kind}>, block binary")
    coded.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{path}/blocks")


def read_token_ids(spark: SparkSession, path: str, size: int, crc_only: bool = False) -> DataFrame:
    """key, start, n_tokens and ids (or with `crc_only` their CRC-32) of every document of the files.

    A block needs nothing but itself and the tables, so Spark may read blocks in any number of tasks.
    """
    freq = np.zeros(size, np.uint64)
    for row in spark.read.schema("id int, freq long").parquet(f"{path}/tables").collect():  # bounded by the vocabulary
        freq[row["id"]] = row["freq"]
    tables_of = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    key_kind = blocks.schema["keys"].dataType.elementType.simpleString()
    result = "ids_crc32 long" if crc_only else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(tables_of.value)
        for batch in batches:
            for keys, blob in zip(batch.column("keys"), batch.column("block"), strict=True):
                head, ids = decode_block(blob.as_py(), tables)
                lengths = head["lengths"].astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                raw = np.ascontiguousarray(ids, "<u4")
                if crc_only:
                    bytes_ = memoryview(raw).cast("B")
                    found = pa.array([zlib.crc32(bytes_[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.int64())
                else:
                    found = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(raw.view(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(head["first"] + starts[:-1]), pa.array(lengths), found], ["key", "start", "n_tokens", result.split()[0]])

    return blocks.select("keys", "block").mapInArrow(run, f"key {key_kind}, start long, n_tokens long, {result}")


def token_output(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, read them back, and return key, start, n_tokens and ids_crc32 of every document."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_ids(docs, vocabulary, path, end_id, key, text)
    size = max(tokenizer(vocabulary).size, end_id + 1)
    return read_token_ids(spark, path, size, crc_only=True).withColumnRenamed("key", key)
