"""Types, widening, decoding, calendar values, canonical order, identity, declarations."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.contract import TableContract, assert_exact_schema, empty, evolve, padded
from tessera.errors import EXIT_STATUS, TesseraError
from tessera.functions import decoders as D
from tessera.functions.calendar import derive, derive_from_ns
from tessera.functions.order import canonical_order, content_digest
from tessera.functions.widening import project, widens
from tessera.operators import checks
from tessera.plans import declaration
from tessera.plans.identity import canonical, digest_of
from tessera.types import REFUSED, parse_type, type_of


def test_types_parse_and_refuse():
    assert parse_type("decimal128(38,6)").spark == T.DecimalType(38, 6)
    assert parse_type("timestamp(us,UTC)").utc
    assert parse_type("timestamp(ns)").spark == T.LongType()
    for bad in (*REFUSED, "decimal128(038,6)", "decimal128(39,1)", "decimal128(3,4)", "timestamp(s)", ""):
        with pytest.raises(TesseraError):
            parse_type(bad)
    assert type_of(T.ShortType()).spelling == "int64"


def test_widening_rules():
    d = lambda p, s: T.DecimalType(p, s)
    assert widens(d(28, 2), parse_type("decimal128(38,12)"))
    assert not widens(d(28, 2), parse_type("decimal128(28,3)"))
    assert not widens(d(28, 2), parse_type("decimal128(28,1)"))
    assert widens(T.IntegerType(), parse_type("int64")) and not widens(T.DoubleType(), parse_type("int64"))
    assert not widens(T.TimestampType(), parse_type("timestamp(us)"))


def test_project_renames_and_repeats(spark):
    df = spark.createDataFrame([(1, 1.5)], "a int, b float")
    out = project(df, [{"name": "x", "source": "a", "type": "int64"}, {"name": "y", "source": "a", "type": "int64"}, {"name": "b", "type": "double"}])
    assert out.first() == (1, 1, 1.5)
    with pytest.raises(TesseraError):
        project(df, [{"name": "z", "type": "int64"}])


@pytest.mark.parametrize(("text", "want"), [("1.50", "1.500000"), ("-0.0000010", "-0.000001"), ("1e3", "1000.000000"), ("12.5E-2", "0.125000"), ("0.0000001", None), ("1e40", None), ("abc", None), ("", None), ("0e999999", "0.000000"), ("+.5", "0.500000"), ("12345678901234567890123456789012.345678", "12345678901234567890123456789012.345678")])
def test_decimals_from_text(spark, text, want):
    value, bad = D.decimal_from_text(F.col("x"), 38, 6)
    row = spark.createDataFrame([(text,)], "x string").select(value.cast("string"), bad).first()
    assert row == (want if want != "-0.000001" else "-0.000001", want is None)


def test_other_decoders(spark):
    row = spark.createDataFrame([("9223372036854775807", "0.12500", "AAH/", "1969-12-31", "1970-01-01T01:00:00.123+0100", "1969-12-31T23:59:59.999", "true")], "i string, f string, b string, d string, u string, l string, t string")
    got = row.select(D.int_from_text(F.col("i"))[0], D.double_from_text(F.col("f"))[0], D.binary_from_text(F.col("b"))[0], D.date_from_text(F.col("d"))[0].cast("string"), D.timestamp_from_text(F.col("u"), "ms")[0].cast("string"), D.timestamp_from_text(F.col("l"), "ms", False)[0].cast("string"), D.bool_from_text(F.col("t"))[0]).first()
    assert got == (2**63 - 1, 0.125, bytearray(b"\x00\x01\xff"), "1969-12-31", "1970-01-01 00:00:00.123", "1969-12-31 23:59:59.999", True)
    bad = spark.createDataFrame([("9223372036854775808", "1.5", "1970-01-01T00:00:00", "1970-01-01T00:00:60Z", "1970-01-01T00:00:00.0001Z", "AA=", "1970-1-1")], "i string, h string, n string, s string, f string, b string, d string")
    flags = bad.select(D.int_from_text(F.col("i"))[1], D.int_from_text(F.col("h"))[1], D.timestamp_from_text(F.col("n"))[1], D.timestamp_from_text(F.col("s"))[1], D.timestamp_from_text(F.col("f"), "ms")[1], D.binary_from_text(F.col("b"))[1], D.date_from_text(F.col("d"))[1]).first()
    assert all(flags)
    none = spark.createDataFrame([(None,)], "x string").select(*[f(F.col("x"))[1] for f in (D.int_from_text, D.double_from_text, D.date_from_text, D.timestamp_from_text, D.binary_from_text)]).first()
    assert not any(none)


def test_calendar_before_the_epoch(spark):
    df = spark.sql("SELECT DATE'1969-12-31' AS d, CAST(-1 AS BIGINT) AS ns, DATE'0001-01-01' AS first")
    assert df.select(derive(F.col("d"), "day"), derive_from_ns(F.col("ns"), "day"), derive(F.col("first"), "year")).first() == ("1969-12-31", "1969-12-31", "0001")


def test_canonical_order_of_doubles(spark):
    nan = float("nan")
    values = [None, -nan, float("-inf"), -1.5, -0.0, 0.0, 2.0, float("inf"), nan]
    shuffled = values[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([(v,) for v in shuffled], "v double")
    got = [r[0] for r in df.orderBy(*canonical_order(df)).collect()]
    bits = lambda v: None if v is None else "nan" if v != v else struct.pack(">d", v)
    assert [bits(v) for v in got if v == v] == [bits(v) for v in values if v == v]


def test_digest_is_a_bag_of_rows(spark):
    a = spark.createDataFrame([("p", 1, 0.0), ("p", 2, None), ("p", 1, 0.0)], "k string, n int, v double")
    d = lambda df: df.transform(lambda x: content_digest(x, ["k"])).first()["digest"]
    assert d(a) == d(a.orderBy(F.desc("n")))
    assert d(a) != d(a.dropDuplicates())
    assert d(a) != d(a.withColumn("v", F.when(F.col("v").isNotNull(), F.lit(-0.0))))


def test_contract_checks(spark):
    c = TableContract((("id", "int64"), ("_year_", "utf8")), ("year",))
    with pytest.raises(TesseraError):
        TableContract((("id", "int64"),), ("year",))
    with pytest.raises(TesseraError):
        assert_exact_schema(spark.createDataFrame([], "id int, _year_ string"), c)
    assert evolve(c, TableContract((*c.columns, ("x", "utf8")), ("year",))).columns[-1] == ("x", "utf8")
    with pytest.raises(TesseraError):
        evolve(c, TableContract((("_year_", "utf8"), ("id", "int64")), ("year",)))
    assert padded(spark.createDataFrame([(1,)], "id long"), c).first() == (1, None)
    assert empty(spark, c).count() == 0


def test_checks(spark):
    df = spark.createDataFrame([("a/b",), ("ok",), ("UPPER",), ("",), (" x",), (None,)], "_k_ string")
    with pytest.raises(TesseraError) as e:
        checks.require(df, checks.partition_names(["_k_"]))
    assert "5" in str(e.value) and e.value.exit_status == 2
    for bad in ("x IN (SELECT 1)", "row_number() OVER (ORDER BY id) = 1", "id = 1; DROP TABLE t"):
        with pytest.raises(TesseraError):
            checks.row_predicate(spark.range(3), bad)
    with pytest.raises(Exception):  # noqa: B017
        checks.row_predicate(spark.range(3), "sum(id) > 1").collect()
    assert checks.row_predicate(spark.range(9), "id % 3 = 0 OR id = 4").count() == 4


@pytest.mark.parametrize("bad", ["DROP TABLE x", "INSERT INTO t SELECT 1", "SELECT * FROM parquet.`/tmp/x`", "SELECT 1; SELECT 2", "SELECT java_method('java.lang.System', 'exit', 1)", "SET a = 1"])
def test_one_select(spark, bad):
    with pytest.raises(Exception):  # noqa: B017
        checks.one_select(bad)


def test_identity():
    assert canonical({"b": 1.0, "a": [True, None, "é\n"], "c": 1e21, "d": 1e-7, "e": 0.000001, "f": -0.5}) == '{"a":[true,null,"é\\n"],"b":1,"c":1e+21,"d":1e-7,"e":0.000001,"f":-0.5}'
    assert digest_of({"x": 1, "y": 2}) == digest_of({"y": 2, "x": 1})


def test_declaration():
    good = """
declaration_version: 1
kind: push
dataset: notes
build: {inputs: [{table: raw.lines, as: lines}]}
tables:
  - name: totals
    source: {sql: "SELECT 1"}
    columns:
      - {name: day, type: date32}
      - {name: _month_, type: utf8, derive: {from: day, unit: month}}
    partition_keys: [month]
checks:
  - {table: totals, not_null: [day]}
"""
    d = declaration.load(good)
    assert d.tables[0].not_null == ["day"] and d.inputs == {"lines": "raw.lines"}
    for old, new in (("name: day", "name: other"), ("kind: push", "kind: other"), ("date32", "int64"), ("kind: push", "kind: push\nkind: push"), ("dataset: notes", "dataset: &x notes"), ("not_null: [day]", "not_null: [nope]"), ("dataset: notes", "dataset: notes\nx: .inf")):
        with pytest.raises(TesseraError):
            declaration.load(good.replace(old, new, 1))


def test_every_code_has_a_status():
    assert len(EXIT_STATUS) == 17 and set(EXIT_STATUS.values()) == {2, 3, 4, 5, 6}


def test_doubles_of_any_size(spark):
    cases = {"1e300": 1e300, "1e25": 1e25, "1e-20": 1e-20, "4.9E-324": 5e-324, "-0": 0.0, "0.1": 0.1, "00120.50": 120.5, "0.30000000000000001": None, "1e400": None, "x": None, "NaN": None, "123456789012345678": None}
    cases["123456789012345680"] = 123456789012345680.0
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    value, bad = D.double_from_text(F.col("t"))
    assert {r.t: r.v for r in df.select("t", value.alias("v"), bad.alias("b")).collect()} == cases
    assert {r.t for r in df.where(bad).collect()} == {k for k, v in cases.items() if v is None}


def test_row_predicates(spark):
    df = spark.createDataFrame([(1, "x y", "2020-02-03")], "id long, s string, d string")
    for good in ("extract(YEAR FROM CAST(d AS DATE)) = 2020", "trim(BOTH 'x' FROM s) = ' y'", "s LIKE '%;%' OR id = 1", "id IN (1, 2)", "s <> 'select over from'"):
        assert checks.row_predicate(df, good).count() == 1
    for bad in ("java_method('java.lang.System', 'nanoTime') > ''", "`reflect`('java.lang.System', 'nanoTime') > ''", "id = (SELECT 1)", "EXISTS (SELECT 1)", "id IN (SELECT 1)", "row_number() OVER (ORDER BY id) = 1", "count(*) > 0", "id = 1; DROP TABLE x", "id = ?", "rand() < 2"):
        with pytest.raises(TesseraError):
            checks.row_predicate(df, bad).count()


def test_core_scalars():
    from tessera.plans.declaration import parse

    got = parse("{a: yes, b: 010, c: 1:30, d: 0x1f, e: 0o17, f: true, g: ~, h: 1_000, i: 1e3, j: 2001-01-01, k: '1', l: -7}")
    assert got == {"a": "yes", "b": 10, "c": "1:30", "d": 31, "e": 15, "f": True, "g": None, "h": "1_000", "i": 1000.0, "j": "2001-01-01", "k": "1", "l": -7}
    for bad in ("{a: .inf}", "{a: .nan}"):
        with pytest.raises(TesseraError):
            parse(bad)
