"""The corpus pipeline: stages of training-data operators, each on all that its predecessor kept.

1. language ID: documents without a language, or whose predicted language isn't certain enough, go;
2. quality classifier: documents that are probably not of the top grade go;
3. n-gram Jaccard join: of each group of linked documents the one with the smallest key stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece encoding and decoding: every document left with its token ids and digests.

All but the last stage return the columns of `documents`, with whatever further columns it has, also such as share a
name with a column that a stage works with. Nulls: documents with a null text go in stage 1, those with a null key are
no copies and hold no item, and pass stages 3 and 4. Of copies with one key all rows stay (they are one document); of
ties the smallest key stays. Texts are taken whole, however long. An empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, language_id, piece_codec, quality_classifier
from tessera.llm.common import forget, mark, packed, staged, table

#: Least calibrated probability of the predicted language.
SURE = 0.3
#: Least chance of the top grade.
GOOD = quality_classifier.SELECT


def named(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a certain language."""
    found = language_id.predicted(packed(docs), language_id.learn(docs), "row", "row.text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are probably of the top grade."""
    model = quality_classifier.learn(docs, quality_classifier.graded(table(spark, sf_dir, "labels")))
    return quality_classifier.scored(packed(docs), model, "row", "row.text", select=GOOD).where("selected").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of linked documents."""
    grouped = jaccard_join.clustered(docs)
    gone = grouped.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*named(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*named(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of what is left."""
    return piece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", by_language),
    ("quality classifier", by_quality),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

#: The model stages are no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` through all stages; each stage's result is written and read again, and what the stage wrote on its
    way, and its input, are deleted then."""
    docs, start = table(spark, sf_dir, "documents"), mark()
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, f"stage-{n + 1}")
            forget(spark, start, keep=1)
    return docs
