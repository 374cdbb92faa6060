"""Every registered query of the engine against its SQL in DuckDB."""

import decimal
from pathlib import Path

import duckdb
import pytest
from conftest import DATA

from tessera.queries import ORACLE, QUERIES


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(tuple(map(plain, (r[c] for c in sorted(df.columns)))) for r in df.collect())
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert got == want


def test_entry_without_training_data():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_medians_whatever_the_bounds(spark):
    from pyspark.sql import functions as F

    from tessera.operators.quantiles import with_medians

    rows = [("odd", float(v)) for v in (5, 1, 3, 3, 9)] + [("even", float(v)) for v in (4, 1, 8, 2)] + [(None, 7.0), ("null", None), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0), ("odd", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = dict(df.groupBy("g").agg(F.median("v")).collect())
    for low, high in ((0.0, 10.0), (-2.0, -1.0), (3.0, 3.0), (20.0, 30.0), (2.5, 3.5)):
        rough = df.groupBy("g").agg(F.array(F.lit(low), F.lit(high)).alias("near"))
        assert {r["g"]: r["median"] for r in with_medians(df, ["g"], "v", rough, "near").collect()} == want


def test_approximate_aggregates_build_no_groups_values(spark):
    plan = QUERIES["agg_approximate"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan and "Expand" not in plan
