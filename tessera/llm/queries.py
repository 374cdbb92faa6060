"""The registered queries of this subpackage: thin calls of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, language_id, license_scan, quality_classifier, quality_rules
from tessera.llm.common import table
from tessera.llm.piece_codec import digests
from tessera.llm.token_counts import token_counts
from tessera.llm.token_output import token_output
from tessera.llm.url_filters import judged


#: The rules of the op1 contract, and further listed hosts (fixed values).
BLOCK_RULES = ["com/en/", "example.net/de/8", "org/es/"]
ALLOW_RULES = ["example.com/en/7", "net/de/"]
LISTED_NAMES = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_BLOCK = [f"{name}.example.{end}/" for name in LISTED_NAMES for end in ("com", "net", "org")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), BLOCK_RULES, ALLOW_RULES, LISTED_BLOCK)


OP1_SQL = f"""
WITH listed(h) AS (SELECT n || '.example.' || e FROM (VALUES {", ".join(f"('{n}')" for n in LISTED_NAMES)}) AS a(n), (VALUES ('com'), ('net'), ('org')) AS b(e)),
split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(r, h, p, v) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
best AS (
  SELECT page_id, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(verdict,
  CASE WHEN EXISTS (SELECT 1 FROM listed WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, '/')) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clustered(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_language_id": op2_language_id,
        "op3_quality_rules": op3_quality_rules,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_decontamination": op5_decontamination,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_token_output": op7_token_output,
        "op8_token_counts": op8_token_counts,
        "op9_license_scan": op9_license_scan,
        "op10_piece_codec": op10_piece_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL}
