"""Checks that fail a whole transfer if any row is bad; each is one aggregation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.contract import NAME
from tessera.errors import TesseraError

#: Functions that read files, reach into the JVM, run other text, or give another result each time.
REFUSED = frozenset("java_method reflect try_reflect read_files identifier rand randn random uuid uniform randstr shuffle monotonically_increasing_id spark_partition_id input_file_name input_file_block_start input_file_block_length".split())
#: File formats that could be read as tables.
FORMATS = ("parquet", "csv", "json", "orc", "text", "avro", "xml", "binaryfile", "delta", "jdbc")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: for each rule how many rows break it."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])


def require(df: DataFrame, rules: dict[str, Column], code: str = "INVALID_ARGUMENT") -> DataFrame:
    """`df`, if no row breaks a rule."""
    found = {n: v for n, v in violations(df, rules).first().asDict().items() if v}
    if found:
        raise TesseraError(code, f"rows that break a rule: {found}")
    return df


def not_null(columns: list[str]) -> dict[str, Column]:
    return {f"{c} is null": F.col(c).isNull() for c in columns}


def partition_names(columns: list[str]) -> dict[str, Column]:
    """Partition values must be names; null isn't one."""
    return {f"{c} is no name": ~F.coalesce(F.col(c).rlike(f"^{NAME.pattern}$"), F.lit(False)) for c in columns}


def partition_values(values: dict[str, str]) -> dict[str, Column]:
    """Every row's partition column must hold the partition's value."""
    return {f"_{k}_ differs": ~F.coalesce(F.col(f"_{k}_") == v, F.lit(False)) for k, v in values.items()}


def _parser():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.active()._jsparkSession.sessionState().sqlParser()


def refuse_functions(text: str) -> None:
    """Refuse calls of REFUSED functions, in whatever case and quotes. Text values and comments don't count."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).replace("`", "")
    called = {w.lower() for w in re.findall(r"(\w+)\s*\(", bare)} & REFUSED
    if called:
        raise TesseraError("INVALID_DECLARATION", f"functions that are not allowed: {sorted(called)}")


def row_predicate(df: DataFrame, text: str) -> DataFrame:
    """Rows for which one expression holds. It may use columns that aren't projected later, but no query, window,
    aggregate, parameter or clause, and no REFUSED function. Spark's own parser reads it."""
    try:
        shown = _parser().parseExpression(text).treeString()
    except Exception as e:
        raise TesseraError("INVALID_DECLARATION", f"no single expression of a row: {text}") from e
    if re.search(r"(?i)scalar-subquery|exists#|exists \[|list#|in \(list|insubquery|windowexpression|windowspec|unresolvedwindow|parameter", shown):
        raise TesseraError("INVALID_DECLARATION", "a row filter has no query, window or parameter")
    refuse_functions(text)
    try:
        return df.where(F.expr(text))
    except Exception as e:
        raise TesseraError("INVALID_DECLARATION", f"no row filter: {text}") from e


def relations(text: str) -> set[str]:
    """Names that a statement reads, without those it defines itself."""
    shown = _parser().parsePlan(text).toString()
    defined = {n.strip().strip("`") for names in re.findall(r"CTE \[([^\]]*)\]", shown) for n in names.split(",")}
    return {n.replace(", ", ".") for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", shown)} - defined


def one_select(text: str, allowed: set[str] | None = None) -> str:
    """`text`, if it is one SELECT statement, by Spark's own parser, that reads `allowed` names only (if given), no
    files, and calls no REFUSED function."""
    try:
        shown = _parser().parsePlan(text).toString()
    except Exception as e:
        raise TesseraError("INVALID_DECLARATION", f"no SELECT: {text}") from e
    if re.match(r"(?i)'?(Insert|Overwrite|Append|Drop|Create|Replace|Delete|Update|Merge|Truncate|Alter|Show|Set|Reset|Add|Cache|Uncache|Refresh|Describe|Use|Explain|Execute|Call|Declare|Compound|Comment|Analyze|Load|Repair)", shown) or "Command" in shown.split("\n")[0]:
        raise TesseraError("INVALID_DECLARATION", "only one SELECT is allowed")
    refuse_functions(text)
    read = relations(text)
    if any(n.split(".")[0].lower() in FORMATS and "." in n for n in read):
        raise TesseraError("INVALID_DECLARATION", "files are not read by SQL")
    if allowed is not None and (other := {n for n in read if n.lower() not in {a.lower() for a in allowed}}):
        raise TesseraError("INVALID_DECLARATION", f"only {sorted(allowed)} may be read, not {sorted(other)}")
    return text
