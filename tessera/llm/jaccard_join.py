"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A document's set are its distinct 5-word shingles (64-bit hashes). Documents with equal sets form a class; classes
link when their sets' Jaccard similarity is at least `SIMILARITY`.

1. A first pass makes each document's set size and signature, and finds frequent tokens: those in more than a small
   share of the classes that a task sees (their number is bounded by `MOST_FREQUENT`; which tokens are taken as
   frequent affects speed only).
2. A second pass orders each set, rare tokens first, and takes an extended prefix: n - ceil(0.8 n) tokens and e more,
   so that linked classes share at least e tokens of their prefixes. Rare prefix tokens are indexed singly. Frequent
   ones are dealt to `GROUPS` groups and indexed as 2-token combinations within a group; e is above the number of
   groups with tokens in the prefix, so by the pigeonhole principle some rare token or some combination is shared.
   Small sets, whose overlap may be less than that, index frequent tokens singly, as do sets a little larger, so that
   every possible pair meets in one of both ways.
3. Entries met by two classes are kept; a class's rare prefix tokens that no other prefix holds (unmet) are counted.
   Another set may still hold them beyond its prefix, but not if its rare prefix reaches as far in the order of
   tokens: so of two sets, the one whose rare prefix ends first cannot share its unmet tokens. Of the tokens that two
   prefixes share, all but one per group of frequent tokens show as a shared entry of their own at least. So a class
   lives on only if it shares as many entries as e is above its number of groups (count filter).
4. A third pass makes the whole sets of what lives on. Each entry's members are verified against one of them, in some
   rounds with other pivots; what is linked to it needs no comparison with what else is. Of the pairs of members still
   in different components that meet in an entry of up to `MOST_OPEN` such members, those that share enough entries
   (count filter) are then verified one by one. No pair within a component is made, and none is left out.
5. Members of larger entries, as texts from one template have, are indexed anew by their whole sets: tokens are put in
   the order of their exact frequency among these members, so that what the template gives comes last; the prefix of a
   set is as long as a partner of each band of sizes asks for, and positional filters follow. This is exact as well.

Defined results: without words or text a set is empty and linked with nothing; with fewer than five words the whole
sequence is one shingle; rows with a null key keep a null component; rows that share a key count as one document;
of rows with the same set the smallest key stands for all; an empty table gives an empty result; other columns are not
read; texts are taken whole, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.components import components
from tessera.llm.hashing import GRAM, code_points, mixed, word_hashes
from tessera.llm.url_filters import FIRST_BITS, Level, filled, gathered

#: Words per shingle; links from 80 % of the union on.
WORDS, PERCENT = 5, 80
#: A token is frequent if more than this share of a task's classes hold it, and at least so many do.
FREQUENT_SHARE, FREQUENT_LEAST, MOST_FREQUENT = 0.002, 8, 100_000
#: Groups of frequent tokens; sets of up to SMALL tokens index frequent tokens singly.
GROUPS, SMALL = 16, 64
#: The count filter's part of a set: so many further prefix tokens, in hundredths.
EXTEND = 10
#: End of a rare prefix that holds all rare tokens of its set.
NO_END = np.iinfo(np.int64).max
#: Rounds of comparing an entry's members with one of them.
ROUNDS = 2
#: Entries of more members in different components don't make pairs; their members are indexed by exact frequencies.
MOST_OPEN = 32
#: A filter of documents larger than this isn't sent to the executors; a join takes its place.
MOST_FILTER_BITS = 1 << 28
#: Ratio of the sizes that share a band.
BAND = 1.05
#: Rows of index entries that are handed to Spark together.
ROWS = 1 << 16


def shingles(text: str) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    codes = code_points(text)
    upper = (codes >= 65) & (codes <= 90)
    words = word_hashes(codes + np.uint64(32) * upper)
    n = min(WORDS, len(words))
    if not n:
        return words
    value = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        value = value * GRAM[0] + words[k : len(words) - n + 1 + k]
        value ^= value >> np.uint64(33)
    return np.unique(mixed(value))


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        first = mixed(tokens * GRAM[2]).sum(dtype=np.uint64)
        second = mixed(tokens ^ GRAM[3]).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def least_overlap(n: int) -> int:
    """Tokens that a set of n shares with any set it links with, at least."""
    return -(-PERCENT * n // 100)


def entries(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Index entries of a set, those of rare tokens first; how many entries it shares with any set that it links
    with; how many entries are of rare tokens."""
    n = len(tokens)
    at = np.searchsorted(frequent, tokens)
    often = np.zeros(n, bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] == tokens
    rare, common = tokens[~often], tokens[often]
    base = n - least_overlap(n)
    extra = max(1, EXTEND * n // 100)
    groups = (common % np.uint64(GROUPS)).astype(np.int64)
    while True:  # e grows until it is above the number of groups in the prefix
        length = min(n, base + extra)
        held = max(0, length - len(rare))
        wanted = 1 + len(np.unique(groups[:held])) if n > SMALL else 1
        if extra >= wanted or length == n:
            break
        extra = wanted
    extra = length - base
    common, groups = common[:held], groups[:held]
    found = [rare[:length]]
    if held and 100 * SMALL >= PERCENT * n:
        found.append(mixed(common + GRAM[2]))
    if held and n > SMALL:
        for g in np.unique(groups):
            own = common[groups == g]
            i, j = np.triu_indices(len(own), 1)
            found.append(mixed(own[i] * GRAM[0] + mixed(own[j])))
    return np.concatenate(found), extra - (len(np.unique(groups)) if n > SMALL else 0), len(found[0])


def rare_end(found: np.ndarray, n_rare: int) -> int:
    """Where a rare prefix ends in the order of tokens, from a set's entries; those of frequent tokens come after all
    rare ones."""
    return NO_END if len(found) > n_rare or not n_rare else int((found[n_rare - 1] ^ np.uint64(1 << 63)).view(np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two ascending sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sets_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Staged rows: (key, n, s1, s2) of every document, and rows (token, count) of tokens frequent in a task."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: set[tuple[int, int]] = set()
        held, tokens, counts = 0, np.empty(0, np.uint64), np.empty(0, np.int64)
        fresh: list[np.ndarray] = []

        def settle() -> None:
            """Tokens so far with their counts; what cannot become frequent any more soon is let go (lossy counting)."""
            nonlocal tokens, counts, fresh, held
            some, own = np.unique(np.concatenate(fresh), return_counts=True)
            together, inverse = np.unique(np.concatenate([tokens, some]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([counts, own])).astype(np.int64)
            strong = total > FREQUENT_SHARE * len(classes) / 2
            tokens, counts, fresh, held = together[strong], total[strong], [], 0

        names = ["key", "n", "s1", "s2", "token", "count"]
        for batch in batches:
            sizes, s1, s2 = [], [], []
            for t in batch.column(1):
                own = shingles(t.as_py())
                a, b = signature(own)
                sizes.append(len(own))
                s1.append(a)
                s2.append(b)
                if (a, b) not in classes and len(own):
                    classes.add((a, b))
                    fresh.append(own)
                    held += len(own)
                    if held > 2_000_000:
                        settle()
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), none, none], names)
        if fresh:
            settle()
        strong = counts > max(FREQUENT_LEAST - 1, FREQUENT_SHARE * len(classes))
        some = tokens[strong]
        nothing = lambda t: pa.nulls(len(some), t)
        if len(some):
            key_type = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([nothing(key_type), nothing(pa.int32()), nothing(pa.int64()), nothing(pa.int64()), _signed(some), pa.array(counts[strong])], names)

    return staged(source.mapInArrow(run, f"key {kind}, n int, s1 long, s2 long, token long, count long"), "shingle-sets")


def index_of(docs: DataFrame, frequent: np.ndarray, key: str, text: str) -> DataFrame:
    """Rows (entry, s1, s2, rare, known, need, n_rare, end): index entries of every class, and one row with `need`, the
    number of rare entries and the end of the rare prefix for the class itself. Where an entry has several rows in a
    batch, it is known to be shared: 1 for the first, 2 for the others, which need not be brought together any more."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # MOST_FREQUENT numbers at most
    source = docs.where(F.col(key).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["entry", "s1", "s2", "rare", "known", "need", "n_rare", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            found, sizes, classes = [], [], []
            for t in batch.column(0):
                own = shingles(t.as_py())
                sig = signature(own)
                if not len(own) or sig in seen:
                    continue
                seen.add(sig)
                some, least, n_rare = entries(own, shared.value)
                found += [some, np.array([sig[0] ^ sig[1]], np.int64).view(np.uint64)]
                sizes.append(len(some) + 1)
                classes.append((*sig, least, n_rare, rare_end(some, n_rare)))
            if found:
                yield from rows(np.concatenate(found), np.array(sizes), np.array(classes, np.int64))

    def rows(entry: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A batch's entries, the last one of each class being its own row; what classes hold is repeated for ROWS rows
        at a time."""
        stops = np.cumsum(sizes)
        inner = np.ones(len(entry), bool)
        inner[stops - 1] = False
        order = np.argsort(entry, kind="stable")
        same = (entry[order[1:]] == entry[order[:-1]]) & inner[order[1:]] & inner[order[:-1]]
        known = np.zeros(len(entry), np.int8)
        known[order[:-1][same]] = 1
        known[order[1:][same]] = 2
        del order, same
        for start in range(0, len(entry), ROWS):
            at = np.arange(start, min(start + ROWS, len(entry)))
            of = np.searchsorted(stops, at, side="right")
            own, mask = classes[of], inner[at]
            rare = at - (stops - sizes)[of] < own[:, 3]
            once = [pa.array(own[:, c].astype(kind), mask=mask) for c, kind in ((2, np.int32), (3, np.int32), (4, np.int64))]
            yield pa.RecordBatch.from_arrays([_signed(entry[at]), *(pa.array(own[:, c].copy()) for c in (0, 1)), pa.array(rare), pa.array(known[at]), *once], names)

    return source.mapInArrow(run, "entry long, s1 long, s2 long, rare boolean, known byte, need int, n_rare int, end long")


def filter_of(keys: DataFrame) -> Level | None:
    """A Bloom filter of (h1, h2) rows; None beyond the size bound. Only its bits reach the driver."""
    bits = max(64, -(-keys.count() * FIRST_BITS // 64) * 64)
    if bits > MOST_FILTER_BITS:
        return None
    level = Level(bits, 7, np.zeros(0, np.uint8))
    own = lambda batch: [(0, np.asarray(batch.column(0)), np.asarray(batch.column(1)))]
    gathered(keys.mapInArrow(lambda batches: filled(batches, {0: level}, own), "slot long, word long, bits long"), found := {0: Level(bits, 7, np.zeros(0, np.uint8))})
    return found[0]


def whole_sets(docs: DataFrame, living: DataFrame, key: str, text: str) -> DataFrame:
    """Staged (node, tokens) of the documents whose keys are in `living` (node)."""
    hashes = living.select(F.xxhash64("node").alias("h1"), F.xxhash64("node", F.lit(7)).alias("h2"))
    level = filter_of(hashes)
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(key)).alias("h1"), F.xxhash64(F.col(key), F.lit(7)).alias("h2"))
    kind = source.schema["node"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None:
                batch = batch.filter(pa.array(shared.value.has(np.asarray(batch.column(2)), np.asarray(batch.column(3)))))
            for part in range(0, len(batch), 256):
                some = batch.slice(part, 256)
                tokens = [shingles(t.as_py()).tobytes() for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(tokens, pa.binary())], ["node", "tokens"])

    found = source.mapInArrow(run, f"node {kind}, tokens binary")
    if level is None:
        found = found.join(living, "node", "left_semi")
    made = staged(found.where(F.length("tokens") > 0), "living-sets")
    shared.destroy()  # on the driver too
    return made


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    first = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def possible(one: str, two: str) -> Column:
    """Whether two sets could link: the one whose rare prefix ends first shares none of its unmet rare tokens (both do
    not if the ends are equal), and what is left must be enough. `one` and `two` are patterns of column names."""
    n1, unmet1, end1, n2, unmet2, end2 = (F.col(side.format(c)) for side in (one, two) for c in ("n", "unmet", "end"))
    most = F.least(n1 - F.when(end1 <= end2, unmet1).otherwise(0), n2 - F.when(end2 <= end1, unmet2).otherwise(0))
    return (100 + PERCENT) * most >= PERCENT * (n1 + n2)


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, links): (key, n, s1, s2) of all documents, and links (a, b) between keys that span all components."""
    seen = sets_of(docs, key, text)
    sets = seen.where(F.col("n").isNotNull()).select("key", "n", "s1", "s2")
    top = seen.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r["token"] for r in top.select("token").collect()], np.int64).view(np.uint64))

    salt = F.when(F.col("known") == 2, F.pmod("s1", F.lit(1000)) + 1).otherwise(0).cast("short")
    whole, own = Window.partitionBy("entry", "salt"), F.struct("s1", "s2")
    met = index_of(docs, frequent, key, text).withColumn("salt", salt).select("*", F.min(own).over(whole).alias("least"), F.max(own).over(whole).alias("most"))
    met = staged(met.where(F.col("need").isNotNull() | (F.col("known") > 0) | (F.col("least") != F.col("most"))).drop("least", "most", "known", "salt"), "met-entries")

    once = met.groupBy("s1", "s2", "entry").agg(F.max("rare").alias("rare"), F.max("need").alias("need"), F.max("n_rare").alias("n_rare"), F.max("end").alias("end"))
    by_class = once.groupBy("s1", "s2").agg(F.count_if(F.col("need").isNull()).alias("shared"), F.max("need").alias("need"), (F.max("n_rare") - F.count_if("rare")).alias("unmet"), F.max("end").alias("end"))
    classes = sets.where((F.col("n") > 0) & F.col("key").isNotNull()).groupBy("s1", "s2").agg(F.min("key").alias("node"), F.first("n").alias("n"))
    living = staged(by_class.where((F.col("shared") > 0) & (F.col("shared") >= F.col("need"))).join(classes, ["s1", "s2"]), "living-classes")
    own_need = F.greatest("need", F.lit(1)).alias("need")
    members = staged(met.where(F.col("need").isNull()).select("entry", "s1", "s2").join(living.select("s1", "s2", "node", "n", "unmet", "end", own_need), ["s1", "s2"]).select("entry", "node", "n", "unmet", "end", "need").distinct(), "entry-members")
    tokens = whole_sets(docs, living.select("node"), key, text)

    placed, found = members.withColumn("root", F.col("node")), None
    for turn in range(ROUNDS):
        pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("mark") if turn else F.lit(0).alias("mark"), "node", "n", "unmet", "end", "root")).alias("pivot")
        near = placed.join(placed.groupBy("entry").agg(pivot), "entry").where((F.col("root") != F.col("pivot.root")) & possible("{}", "pivot.{}"))
        pairs = near.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
        made = staged(verified(pairs, tokens), "links-to-pivot")
        found = made if found is None else found.unionByName(made)
        roots = components(found)
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = placed.groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("open")).where("low != high").select("entry", "open")
        placed = staged(placed.join(apart, "entry").select("entry", "open", "node", "n", "unmet", "end", "need", "root"), "open-entries")
    large = placed.groupBy("node").agg(F.count_if(F.col("open") > MOST_OPEN).alias("large"), F.first("n").alias("n"), F.first("root").alias("root"))
    small = placed.where(F.col("open") <= MOST_OPEN).join(large.select("node", "large"), "node")
    left, right = (small.select("entry", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "unmet", "end", "need", "root", "large")]) for k in (1, 2))
    rest = left.join(right, "entry").where((F.col("node1") < F.col("node2")) & (F.col("root1") != F.col("root2")) & possible("{}1", "{}2"))
    shared = F.count("*") + F.first(F.least("large1", "large2"))  # entries that both may share
    rest = rest.groupBy(F.col("node1").alias("a"), F.col("node2").alias("b")).agg(shared.alias("shared"), F.first(F.least("need1", "need2")).alias("need")).where("shared >= need").select("a", "b")
    rest = rest.unionByName(exact_candidates(large.where("large > 0").select("node", "n", "root"), tokens)).distinct()
    return sets, found.unionByName(staged(verified(rest, tokens), "links-across"))


def band(n: Column) -> Column:
    """The band of sizes that n is in."""
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def exact_candidates(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs (a, b) of `nodes` (node, n, root) in different components that could link, by prefixes of whole sets in the
    order of exact token frequencies. A set meets a partner of each band of sizes by the prefix that the least partner
    of the band asks for, so that sets of one size meet by a ninth of their tokens."""

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 64):
                some = batch.slice(row, 64)
                values = [np.frombuffer(x.as_buffer(), np.int64) for x in some.column(1)]
                sizes = [len(v) for v in values]
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), pa.array(np.repeat(np.array(sizes, np.int32), sizes)), some.column(2).take(at), pa.array(np.concatenate(values))], ["node", "n", "root", "token"])

    kind = nodes.schema["node"].dataType.simpleString()
    own = nodes.join(tokens, "node").select("node", "tokens", "root").mapInArrow(singles, f"node {kind}, n int, root {kind}, token long")
    own = staged(own, "open-tokens")
    placed = own.join(own.groupBy("token").agg(F.count("*").alias("df")), "token")
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("df", "token")) - 1)
    n, at, size, other = F.col("n"), F.col("at"), band(F.col("n")), F.col("band")
    least = F.greatest(F.floor(F.pow(F.lit(BAND), other) - 1e-6), F.ceil(F.lit(PERCENT) * n / 100)).cast("long")
    overlap = F.ceil(F.lit(PERCENT) * (n + least) / (100 + PERCENT))
    reach = math.ceil(math.log(100 / PERCENT) / math.log(BAND)) + 1
    keyed = placed.where((F.col("df") > 1) & (at <= n - F.ceil(F.lit(PERCENT) * n / 100))).withColumn("band", F.explode(F.sequence(size - reach, size + reach)))
    low, high = F.least(size, other), F.greatest(size, other)
    keyed = staged(keyed.where(at <= n - overlap).select("token", low.alias("low"), high.alias("high"), size.alias("own"), "node", "n", "root", "at"), "open-prefixes")
    left, right = (keyed.where(F.col("own") == F.col(side)).select("token", "low", "high", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "root", "at")]) for k, side in ((1, "low"), (2, "high")))
    most = F.least("at1", "at2") + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    once = (F.col("low") < F.col("high")) | (F.col("node1") < F.col("node2"))
    both = left.join(right, ["token", "low", "high"]).where(once & (F.col("root1") != F.col("root2")) & ((100 + PERCENT) * most >= PERCENT * (F.col("n1") + F.col("n2"))))
    return both.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def clustered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_shingles, component_id for every row."""
    sets, found = links(docs, key, text)
    roots = components(found)
    classes = sets.where((F.col("n") > 0) & F.col("key").isNotNull()).groupBy("s1", "s2").agg(F.min("key").alias("node"))
    placed = classes.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("_root"))
    empty = sets.where((F.col("n") == 0) | F.col("key").isNull()).select("key", "n", F.col("key").alias("_root"))
    full = sets.where((F.col("n") > 0) & F.col("key").isNotNull()).join(placed, ["s1", "s2"]).select("key", "n", "_root")
    return full.unionByName(empty).select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("_root").alias("component_id"))
