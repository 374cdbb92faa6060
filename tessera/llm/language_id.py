"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, which leaves most weights zero,
then one temperature is fitted on documents that training did not see. Document frequencies cover all training
documents; the regression is fitted on a bounded sample of them: up to `SAMPLE_PER_LANGUAGE` documents of each
language, fewer where there are so many languages that it would exceed `SAMPLE_DOCUMENTS` in all (one of each at
least), those with the smallest hashes of key and text. Every language is learned; the model's size grows with their
number alone. Prediction reads whole texts, and nothing but the text.

Defined results: `und` with score 0 for a null text, a text without letters, or where nothing could be learned;
documents with a null language are predicted but not learned from; a null key counts as the empty one for the fold;
ties go to the language first by name; repeated rows are predicted alike; texts are taken whole, however long; an empty
table gives an empty result; other columns are not read, and their names don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import staged, with_text
from tessera.llm.hashing import Rows, code_points, gram_buckets, sparse_counts

BITS, SIZES = 15, (1, 2, 3)
FEATURES = 1 << BITS
#: Bounds of what training gathers on the driver: documents per language, and of all languages together.
SAMPLE_PER_LANGUAGE, SAMPLE_DOCUMENTS = 600, 120_000
#: FTRL-proximal: step size and its offset, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.1, 3
LETTER = re.compile(r"[^\W\d_]")


def held_out(key: Column) -> Column:
    """Every fifth document by the CRC-32 of its key as text."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's lower-cased 1- to 3-grams."""
    return sparse_counts(gram_buckets(code_points(text.lower()), SIZES, BITS), FEATURES)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, at unit length."""
    x = np.log1p(counts) * idf
    return x / (math.sqrt(float(x @ x)) or 1.0)


@dataclass
class Model:
    """Languages by name, idf per bucket, weights per bucket and language, offsets, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return vector(counts, self.idf[at]) @ self.weights[at] + self.offsets

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*grams(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets from (buckets, values, class) rows, in the order given."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for at, values, label in rows:
            at, x = np.append(at, FEATURES), np.append(values, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = softmax(x @ w)
            error[label] -= 1.0
            g = x[:, None] * error
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[at] = grown
    w = weights(z, n)
    return w[:FEATURES], w[FEATURES]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    The targets leave every class the chance of one more document, so documents told apart without a fault do not
    make the scores certain.
    """
    n, classes = logits.shape
    targets = np.full((n, classes), 1.0 / (n + classes))
    targets[np.arange(n), labels] += n / (n + classes)

    def loss(t: float) -> float:
        return float(-(targets * np.log(np.maximum(softmax(logits / math.exp(t)), 1e-300))).sum(1).mean())

    low, high, r = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on the documents outside the held-out fold whose language is known."""
    own = docs.where(~held_out(F.coalesce(F.col(key).cast("string"), F.lit(""))) & F.col(lang).isNotNull())
    by_key = F.xxhash64(F.col(key).cast("string"))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in own.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"), F.min(by_key).alias("least")).collect()}  # one row per language
    if not sizes:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    languages = sorted(sizes)
    wanted = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_DOCUMENTS // len(languages)))
    mark = F.xxhash64(F.col(key).cast("string"), F.col(text))
    bounds = F.create_map(*[x for name, (n, least) in sizes.items() for x in (F.lit(name), F.struct(F.lit(min(1.0, (1.2 * wanted + 10) / n)).alias("share"), F.lit(least).alias("least")))])[F.col(lang)]
    picked = (F.pmod(by_key, F.lit(1 << 20)) < bounds["share"] * (1 << 20)) | (by_key == bounds["least"])  # one key of each language at least
    source = own.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"), mark.alias("mark"), picked.alias("picked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents = np.zeros(FEATURES + 1, np.int64), 0
        names = ["lang", "mark", "at", "counts", "bucket", "n"]
        for batch in batches:
            for t, own_lang, own_mark, own_picked in zip(*(batch.column(c) for c in ("text", "lang", "mark", "picked")), strict=True):
                at, counts = grams(t.as_py())
                df[at] += 1
                documents += 1
                if own_picked.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([own_lang.as_py()]), pa.array([own_mark.as_py()], pa.int64()), pa.array([at.astype("<i4").tobytes()]), pa.array([counts.astype("<i4").tobytes()]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], names)
        df[FEATURES] = documents
        some = np.flatnonzero(df)  # the task's frequencies: rows without a language
        if len(some):
            none = pa.nulls(len(some), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64()), none, none, pa.array(some, pa.int32()), pa.array(df[some])], names)

    seen = staged(source.mapInArrow(run, "lang string, mark long, at binary, counts binary, bucket int, n long"), "language-features")
    parts = seen.where(F.col("lang").isNull()).select("bucket", "n")
    df = np.zeros(FEATURES + 1)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # one row per bucket
        df[row["bucket"]] = row["n"]
    idf = np.log((1.0 + df[FEATURES]) / (1.0 + df[:FEATURES])) + 1.0

    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    first = seen.where(F.col("lang").isNotNull()).withColumn("place", place).where(F.col("place") <= wanted).orderBy("mark", "lang")
    rows = Rows("<i4", "<f8")
    for row in first.toLocalIterator():
        at = np.frombuffer(row["at"], "<i4")
        rows.add(at, vector(np.frombuffer(row["counts"], "<i4"), idf[at]), languages.index(row["lang"]))
    rows = rows.views()
    calibration, training = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    weights, offsets = fit_ftrl(training or rows, len(languages))
    logits = np.array([x @ weights[at] + offsets for at, x, _ in calibration])
    temperature = fit_temperature(logits, np.array([r[2] for r in calibration])) if calibration else 1.0
    return Model(languages, idf, weights, offsets, temperature)


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` (a column of any type, also a struct of columns, which may hold the text), lang_pred, score for every row,
    from the text alone."""
    source, texts = with_text(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            found = [predict(t.as_py()) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [key, "lang_pred", "score"])

    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from `docs`, then predict all of it: `key`, held_out, lang_pred, score."""
    found = predicted(docs, learn(docs, key, text, lang), key, text)
    return found.select(key, held_out(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("held_out"), "lang_pred", "score")
