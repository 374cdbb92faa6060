"""Records of object interfaces: pages of JSON records, and bulk CSV files, decoded exactly.

Both are read with all values as text, so Spark's readers never guess or round; `decode` then applies the exact
decoders of `tessera.functions.decoders` and fails the whole read if any value is bad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import TesseraError
from tessera.functions import decoders
from tessera.operators.checks import require
from tessera.types import parse_type


def _schema(paths: list[str]) -> T.StructType:
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})
    build = lambda t: T.StructType([T.StructField(k, build(v) if v else T.StringType()) for k, v in t.items()])
    return build(tree)


def read_pages(spark: SparkSession, path: str, fields: list[str], expected: int | None = None) -> DataFrame:
    """Records of JSON-lines pages; a field may be a path through parents (a null parent gives null)."""
    raw = spark.read.schema(_schema(fields)).option("mode", "FAILFAST").option("primitivesAsString", "true").json(path)
    rows = raw.select(*[F.col(f).alias(f.replace(".", "__")) for f in fields])
    return _complete(rows, expected)


def read_bulk(spark: SparkSession, path: str, fields: list[str], expected: int | None = None) -> DataFrame:
    """Records of quoted CSV files with a header that must be the projection."""
    heads = spark.read.option("header", "true").csv(path).columns
    if sorted(heads) != sorted(fields):
        raise TesseraError("EXTRACTION_INCOMPLETE", f"the file's columns are {heads}, not {fields}")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in heads])
    rows = spark.read.schema(schema).options(header="true", mode="FAILFAST", multiLine="true", escape='"', nullValue="\u0000", emptyValue="").csv(path)
    return _complete(rows.select(*fields), expected)


def _complete(rows: DataFrame, expected: int | None) -> DataFrame:
    if expected is not None and (n := rows.count()) != expected:
        raise TesseraError("EXTRACTION_INCOMPLETE", f"{n} records were read, {expected} were announced")
    return rows


def decoder(column: Column, kind: str) -> tuple[Column, Column]:
    target = parse_type(kind)
    if isinstance(target.spark, T.DecimalType):
        return decoders.decimal_from_text(column, target.spark.precision, target.spark.scale)
    if target.unit in ("ms", "us"):
        return decoders.timestamp_from_text(column, target.unit, target.utc)
    simple = {"int64": decoders.int_from_text, "double": decoders.double_from_text, "bool": decoders.bool_from_text, "date32": decoders.date_from_text, "binary": decoders.binary_from_text, "utf8": lambda c: (c, F.lit(False))}
    if kind not in simple:
        raise TesseraError("UNSUPPORTED_CAPABILITY", f"no decoder of text into {kind}")
    return simple[kind](column)


def decode(rows: DataFrame, columns: list[dict], empty: dict[str, str] | None = None) -> DataFrame:
    """Typed columns `{name, source, type}` from text; every bad value counts, and any fails the whole read."""
    values, bad = [], {}
    for c in columns:
        source = c.get("source", c["name"]).replace(".", "__")
        text, refused = decoders.empty_cells(F.col(source), (empty or {}).get(c["name"], "string"))
        value, wrong = decoder(text, c["type"])
        values.append(value.alias(c["name"]))
        bad[c["name"]] = F.coalesce(refused | wrong, F.lit(False))
    require(rows, bad, "EXTRACTION_INCOMPLETE")
    return rows.select(*values)


def transport(fields: dict[str, str]) -> str:
    """`rest` if every field's kind passes through JSON pages without loss, else `bulk`, else refused."""
    lossy_rest, lossy_bulk = {"decimal_beyond_double"}, {"base64", "compound"}
    kinds = set(fields.values())
    if not kinds & lossy_rest:
        return "rest"
    if not kinds & lossy_bulk:
        return "bulk"
    raise TesseraError("UNSUPPORTED_CAPABILITY", "no transport carries all fields without loss")


def includes(column: Column, values: list[str]) -> Column:
    """Whether a multi-value field (values joined by `;`) holds one of the values; `a;b` asks for both."""
    held = F.split(column, ";")
    any_ = F.lit(False)
    for v in values:
        all_ = F.lit(True)
        for part in v.split(";"):
            all_ = all_ & F.array_contains(held, part)
        any_ = any_ | all_
    return any_


def excludes(column: Column, values: list[str]) -> Column:
    return ~includes(column, values)


def last_n_days(column: Column, n: int, today: Column) -> Column:
    """A date within the last n days, today included."""
    return (column >= F.date_sub(today, n)) & (column <= today)
