"""URL rules decided by Bloom filter cascades.

A rule is a host with a path prefix. It fits its host and all subdomains where the url's path starts with the rule's
path; the longest fitting rule wins. A url's candidate keys are its host suffixes joined with its path prefixes, for
the pairs of lengths that rules have. One cascade per list says exactly which keys of the corpus are listed: level 0
encodes the listed keys, level 1 those unlisted keys of the corpus's complete key universe that level 0 lets through,
level 2 the listed keys that level 1 lets through, and so on until nothing is let through. A key is listed if it
first fails at an odd level, so no url is ever joined with a list.

A large list's cascade is cut into parts by key hash, of about `PART_KEYS` listed keys each. All levels of `PASS_PARTS`
parts are built, sent out and applied at a time; a longer list takes further passes over the staged candidates. So what
the driver and the workers hold does not grow with the list.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule; a host that is no
label suffix is no candidate; of fitting rules of equal length the one with the longer host wins, of equal rules the
allowing one; repeated rows are judged alike; an empty table gives an empty result; an empty list has an empty cascade;
other columns are not read; urls are taken whole, however long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.hashing import MIX, mixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits per key: level 0 (a false positive rate near 1 %) and the others (near one half).
FIRST_BITS, LATER_BITS = 10, 2
#: Listed keys of a part of a cascade; parts that are held at a time (some 4 MB of bits each).
PART_KEYS, PASS_PARTS = 3_000_000, 8
#: 64-bit words of a level that are gathered as one value.
CHUNK_WORDS = 1 << 13
#: A seed of the second hash.
SECOND_SEED = 0x5EED


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    found = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty where there is no `://`."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Level:
    """One Bloom filter: `size` bits and `hashes` positions per key. Levels differ in `salt`, or keys that meet in one
    level could meet in all."""

    size: int
    hashes: int
    bits: np.ndarray = field(repr=False)
    salt: int = 0

    def positions(self, first: np.ndarray, second: np.ndarray, i: int) -> np.ndarray:
        salt, turn = np.full(1, self.salt, np.uint64) * MIX, np.full(1, i, np.uint64)
        own = mixed(first.view(np.uint64) + salt) + turn * (second.view(np.uint64) | np.uint64(1))
        return ((own >> np.uint64(32)) * np.uint64(self.size)) >> np.uint64(32)

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found = np.ones(len(first), bool)
        for i in range(self.hashes):
            at = self.positions(first, second, i)
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


@dataclass
class Cascade:
    """Levels in order; exact for the keys of the universe it was built over."""

    levels: list[Level]

    def passing(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many levels each key passes before it first fails (all of them, if it never does)."""
        depth = np.zeros(len(first), np.int64)
        live = np.arange(len(first))
        for level in self.levels:
            live = live[level.has(first[live], second[live])]
            depth[live] += 1
        return depth

    def listed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.passing(first, second) % 2 == 1


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(SECOND_SEED))


def part_of(second: np.ndarray, parts: int) -> np.ndarray:
    return (second.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def filled(batches: Iterator[pa.RecordBatch], levels: dict[int, Level], keys: Callable) -> Iterator[pa.RecordBatch]:
    """The set bits of levels as (slot, word, bits), one row per word and batch; `keys` gives (slot, h1, h2) of a batch."""
    for batch in batches:
        for slot, h1, h2 in keys(batch):
            level = levels[slot]
            at = np.sort(np.concatenate([level.positions(h1, h2, i) for i in range(level.hashes)]))
            if len(at):
                word, bits = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), slot)), pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bits, first).view(np.int64))], ["slot", "word", "bits"])


def gathered(rows: DataFrame, levels: dict[int, Level]) -> None:
    """Put the bits of `rows` (slot, word, bits) into the levels; they reach the driver as values of CHUNK_WORDS words."""

    def chunk(key: tuple, parts: pa.Table) -> pa.Table:
        found = np.zeros(CHUNK_WORDS, np.int64)
        np.bitwise_or.at(found, parts["word"].to_numpy() % CHUNK_WORDS, parts["bits"].to_numpy())
        return pa.table({"slot": pa.array([key[0].as_py()]), "chunk": pa.array([key[1].as_py()]), "bits": pa.array([found.astype("<i8").tobytes()], pa.binary())})

    once = rows.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))
    found = once.groupBy("slot", F.expr(f"word div {CHUNK_WORDS}").alias("chunk")).applyInArrow(chunk, "slot long, chunk long, bits binary")
    for level in levels.values():
        level.bits = np.zeros(level.size // 8, np.uint8)
    for row in found.toLocalIterator():
        bits, at = levels[row["slot"]].bits, row["chunk"] * CHUNK_WORDS * 8
        own = np.frombuffer(row["bits"], np.uint8)[: len(bits) - at]
        bits[at : at + len(own)] = own


def build_cascades(universe: DataFrame, lists: list[str], parts: int = 1, chosen: range = range(1)) -> dict[int, Cascade]:
    """The cascades of the chosen parts of all lists, by slot: list number * parts + part.

    `universe` has one row per key: h1 long, h2 long, and a boolean column for each list. One level of all slots is
    built at a time; the driver sees counts by slot and the levels' bits.
    """
    first = {i * parts + p: 0 for i in range(len(lists)) for p in chosen}
    cascades = {slot: Cascade([]) for slot in first}
    rows = universe.select("h1", "h2", *lists)
    shared = universe.sparkSession.sparkContext.broadcast

    def keys(batch: pa.RecordBatch, cascades: dict[int, Cascade], listed: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(slot, h1, h2) of the listed or the other keys that pass all levels so far."""
        h1, h2 = (np.asarray(batch.column(i)) for i in range(2))
        part = part_of(h2, parts)
        for i in range(len(lists)):
            own = np.asarray(batch.column(i + 2)) == listed
            for p in chosen:
                if i * parts + p in cascades:
                    here = own & (part == p)
                    a, b = h1[here], h2[here]
                    passed = cascades[i * parts + p].passing(a, b) == len(cascades[i * parts + p].levels)
                    yield i * parts + p, a[passed], b[passed]

    def counted(cascades: dict[int, Cascade], listed: bool) -> dict[int, int]:
        given = shared(cascades)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = dict.fromkeys(given.value, 0)
            for batch in batches:
                for slot, a, _ in keys(batch, given.value, listed):
                    total[slot] += len(a)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["slot", "n"])

        return {r["slot"]: r["n"] for r in rows.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 0").collect()}

    depth, counts = 0, counted(cascades, True)
    while counts:
        per_key, listed = LATER_BITS if depth else FIRST_BITS, depth % 2 == 0
        levels = {slot: Level(max(64, -(-n * per_key // 64) * 64), max(1, round(per_key * math.log(2))), np.zeros(0, np.uint8), depth) for slot, n in counts.items()}
        given = shared(({slot: cascades[slot] for slot in levels}, levels))

        def words(batches: Iterator[pa.RecordBatch], given=given, listed: bool = listed) -> Iterator[pa.RecordBatch]:
            before, levels = given.value
            return filled(batches, levels, lambda batch: keys(batch, before, listed))

        gathered(rows.mapInArrow(words, "slot long, word long, bits long"), levels)
        for slot, level in levels.items():
            cascades[slot].levels.append(level)
        depth += 1
        counts = counted({slot: cascades[slot] for slot in levels}, depth % 2 == 0)
    return cascades


def candidates(host: Column, path: Column, pairs: list[tuple[int, int]]) -> Column:
    """Keys that could be rules: a label suffix of the host and a path prefix, of lengths that rules have."""
    keys = []
    for h, p in sorted(pairs, key=lambda p: (-(p[0] + p[1]), -p[0])):
        fits = (F.length(path) >= p) & ((F.length(host) == h) | ((F.length(host) > h) & (F.substring(F.right(host, F.lit(h + 1)), 1, 1) == ".")))
        keys.append(F.when(fits, F.concat(F.right(host, F.lit(h)), F.left(path, F.lit(p)))))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judged(pages: DataFrame, block: list[str], allow: list[str], listed_block: list[str] | DataFrame = (), key: str = "page_id", url: str = "url") -> DataFrame:
    """`key`, host, path, rule, verdict for every row.

    `block` and `allow` are rules (`host/path`); the longest fitting one is named in `rule` and decides. Where none
    fits, a url under one of `listed_block` (same form; a table's first column, if it is one) is blocked, and every
    other allowed.
    """
    spark: SparkSession = pages.sparkSession
    names = ["block", "allow", "more"]
    given = [(r, i) for i, own in enumerate((block, allow, () if isinstance(listed_block, DataFrame) else listed_block)) for r in own]
    listed = spark.createDataFrame(given, "k string, list int")
    if isinstance(listed_block, DataFrame):
        listed = listed.unionByName(listed_block.select(F.col(listed_block.columns[0]).alias("k"), F.lit(2).alias("list")))
    listed = listed.where(F.col("k").isNotNull()).groupBy("k").agg(*[F.max(F.col("list") == i).alias(n) for i, n in enumerate(names)])
    slash = F.instr("k", "/")
    pairs = [(r["h"], r["p"]) for r in listed.select((slash - 1).alias("h"), (F.length("k") - slash + 1).alias("p")).distinct().collect()]  # lengths only
    if any(h < 0 for h, _ in pairs):
        raise ValueError("a rule is a host followed by a path that begins with /")
    sizes = listed.agg(*[F.count_if(n).alias(n) for n in names]).first()
    parts = max(1, -(-max(sizes[n] or 0 for n in names) // PART_KEYS))

    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("keys", candidates(F.col("host"), F.col("path"), pairs))
    corpus = rows.select(F.explode("keys").alias("k")).select("k", *[F.lit(False).alias(n) for n in names])
    h1, h2 = hashed(F.col("k"))
    universe = staged(corpus.unionByName(listed).groupBy("k").agg(*[F.max(n).alias(n) for n in names]).select(h1.alias("h1"), h2.alias("h2"), *names), "url-keys")

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, host string, path string, keys array<string>, h1 array<bigint>, h2 array<bigint>, " + ", ".join(f"{n} array<boolean>" for n in names)
    unknown = F.transform("keys", lambda _: F.lit(False))
    found = rows.withColumn("h1", F.transform("keys", lambda k: hashed(k)[0])).withColumn("h2", F.transform("keys", lambda k: hashed(k)[1])).withColumns(dict.fromkeys(names, unknown))
    passes = range(0, parts, PASS_PARTS)
    for start in passes:
        chosen = range(start, min(parts, start + PASS_PARTS))
        shared = spark.sparkContext.broadcast(build_cascades(universe, names, parts, chosen))  # PASS_PARTS parts of each list

        def decide(batches: Iterator[pa.RecordBatch], shared=shared, chosen: range = chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets = pa.array(np.asarray(batch.column("keys").offsets) - batch.column("keys").offsets[0].as_py(), pa.int32())
                h1, h2 = (np.asarray(batch.column(c).flatten()) for c in ("h1", "h2"))
                part, flags = part_of(h2, parts) if len(h2) else h2, []
                for i, n in enumerate(names):
                    values = np.asarray(batch.column(n).flatten()).astype(bool)
                    for p in chosen:
                        here = part == p
                        values[here] = shared.value[i * parts + p].listed(h1[here], h2[here])
                    flags.append(pa.ListArray.from_arrays(offsets, pa.array(values, pa.bool_())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "host", "path", "keys", "h1", "h2")), *flags], ["key", "host", "path", "keys", "h1", "h2", *names])

        found = found.mapInArrow(decide, schema)
        if start != passes[-1]:
            found = staged(found, "url-flags")

    # Candidates stand longest first, so the first listed one is the rule.
    hits = F.filter(F.arrays_zip("keys", "block", "allow"), lambda c: c["block"] | c["allow"])
    best = found.withColumn("best", F.get(hits, F.lit(0)))
    verdict = F.when(F.col("best").isNotNull(), F.when(F.col("best.allow"), "allow").otherwise("block")).when(F.exists("more", lambda m: m), "block").otherwise("allow")
    return best.select(F.col("key").alias(key), "host", "path", F.col("best.keys").alias("rule"), verdict.alias("verdict"))
