"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - s), with one score s = weights . features shared by all grades and ordered
thresholds. Features are hashed character 1- to 3-grams and hashed lower-cased words (each block at unit length), and
the share of words that repeat the word before them. The model gives a document's expected grade and the chance of
the top grade, by which documents are selected.

The fit uses a bounded sample: up to `SAMPLE_PER_GRADE` rated documents of each grade, those with the smallest hashes
of key and text. Every document is scored on its whole text.

Defined results: a null or empty text has no features and its score is 0, and it isn't selected; null ratings are not
used, of several ratings of a document the lowest counts; without two grades to learn from nothing is rejected but
documents without words; a chance equal to the least one is enough; repeated rows are scored alike; texts are taken
whole, however long; an empty table gives an empty result; other columns are not read, and their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import with_text
from tessera.llm.hashing import Rows, code_points, gram_buckets, sparse_counts, word_buckets

BITS, SIZES = 16, (1, 2, 3)
FEATURES = (2 << BITS) + 1
#: Bound of what training gathers on the driver: rated documents of each grade.
SAMPLE_PER_GRADE = 1500
#: AdaGrad: step size, L2 penalty, passes; scale of the feature blocks.
STEP, L2, PASSES, SCALE = 0.1, 1e-6, 4, 5.0
#: Documents are selected when the chance of the top grade is at least this.
SELECT = 0.5


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text."""
    grams, n = sparse_counts(gram_buckets(code_points(text), SIZES, BITS), 1 << BITS)
    words = word_buckets(code_points(text.lower()), BITS)
    same = np.count_nonzero(words[1:] == words[:-1]) if len(words) > 1 else 0
    words_at, m = sparse_counts(words, 1 << BITS)
    values = [unit(np.log1p(n)), unit(np.log1p(m)), np.array([math.sqrt(same / max(1, len(words)))])]
    return np.concatenate([grams, words_at + (1 << BITS), [FEATURES - 1]]), SCALE * np.concatenate(values)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (math.sqrt(float(x @ x)) or 1.0)


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights, and ascending thresholds: one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        if not text:
            return logistic(-self.thresholds)
        at, x = features(text)
        return logistic(float(x @ self.weights[at]) - self.thresholds)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int) -> Model:
    """Weights and thresholds by AdaGrad on the cumulative-link log loss, over rows in a fixed shuffled order."""
    weights, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-2)
    cuts, seen_cuts = np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(grades - 1), np.ones(grades - 1)
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            at, x, grade = rows[i]
            below = logistic(cuts - float(x @ weights[at]))
            low = below[grade - 1] if grade > 0 else 0.0
            high = below[grade] if grade < grades - 1 else 1.0
            chance = max(high - low, 1e-9)
            slope_low = low * (1 - low) if grade > 0 else 0.0
            slope_high = high * (1 - high) if grade < grades - 1 else 0.0
            g = (slope_high - slope_low) / chance * x + L2 * weights[at]
            seen[at] += g * g
            weights[at] -= STEP * g / np.sqrt(seen[at])
            g_cuts = np.zeros(grades - 1)
            if grade < grades - 1:
                g_cuts[grade] -= slope_high / chance
            if grade > 0:
                g_cuts[grade - 1] += slope_low / chance
            seen_cuts += g_cuts * g_cuts
            cuts = np.maximum.accumulate(cuts - 0.3 * g_cuts / np.sqrt(seen_cuts) + 1e-6 * np.arange(grades - 1))
    return Model(weights, cuts)


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ratings from the labels: 0 for bad quality, 1 for good but toxic, 2 for good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(F.min(grade).alias("grade"))


def learn(docs: DataFrame, ratings: DataFrame, grades: int = 3, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of rated documents. Only the sample's keys are sent to the documents."""
    mark = F.xxhash64(F.col(key).cast("string"))
    known = docs.select(key).join(ratings, key)
    sizes = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count("*").alias("n")).collect() if r["grade"] is not None and 0 <= r["grade"] < grades}
    if len(sizes) < 2:
        return Model(np.zeros(FEATURES), np.full(grades - 1, -50.0))
    share = F.lit(0.0)
    for grade, n in sizes.items():
        share = F.when(F.col("grade") == grade, min(1.0, 1.2 * SAMPLE_PER_GRADE / n)).otherwise(share)
    sample = known.where(F.pmod(mark, F.lit(1 << 20)) < share * (1 << 20)).groupBy(key).agg(F.min("grade").alias("grade"))
    # At most about 1.2 * SAMPLE_PER_GRADE * grades keys: the size of the broadcast side is bounded.
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), key).select(F.xxhash64(F.col(key).cast("string"), "_text").alias("mark"), "grade", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own_mark, grade, t in zip(batch.column("mark"), batch.column("grade"), batch.column("_text"), strict=True):
                at, x = features(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([own_mark.as_py()], pa.int64()), pa.array([grade.as_py()], pa.int32()), pa.array([at.astype("<i4").tobytes()]), pa.array([x.astype("<f4").tobytes()])], ["mark", "grade", "at", "x"])

    place = F.row_number().over(Window.partitionBy("grade").orderBy("mark"))
    first = source.mapInArrow(run, "mark long, grade int, at binary, x binary").withColumn("place", place).where(F.col("place") <= SAMPLE_PER_GRADE).orderBy("mark", "grade")
    picked = Rows("<i4", "<f4")
    for r in first.toLocalIterator():
        picked.add(r["at"], r["x"], r["grade"])
    return fit(picked.views(), grades)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", select: float = SELECT) -> DataFrame:
    """`key` (a column of any type, also a struct of columns, which may hold the text), expected_grade, top_tail,
    selected for every row."""
    source, text_of = with_text(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = shared.value.tails
        for batch in batches:
            texts = [t.as_py() for t in text_of(batch)]
            found = [tails(t) for t in texts]
            expected, top = pa.array([float(f.sum()) for f in found], pa.float64()), pa.array([float(f[-1]) for f in found], pa.float64())
            chosen = pa.array([bool(t and not t.isspace() and f[-1] >= select) for t, f in zip(texts, found, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), expected, top, chosen], [key, "expected_grade", "top_tail", "selected"])

    more = [T.StructField("expected_grade", T.DoubleType()), T.StructField("top_tail", T.DoubleType()), T.StructField("selected", T.BooleanType())]
    return source.mapInArrow(run, T.StructType([source.schema[0], *more]))


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rated documents, then score all: `key`, expected_grade, top_tail, selected."""
    return scored(docs, learn(docs, graded(labels, key), 3, key, text), key, text)
