"""Projection, widening, filters, checks, calendar values, canonical order, decoding of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.contract import TableContract, padded
from tessera.functions.calendar import derive
from tessera.functions.decoders import date_from_text, decimal_from_text, double_from_text, empty_cells, int_from_text, timestamp_from_text
from tessera.functions.order import canonical_places, content_digest
from tessera.functions.widening import project
from tessera.operators import checks
from tessera.queries import fresh, query, t
from tessera.sources.objects import excludes, includes, last_n_days


@query("SELECT o_orderkey AS id, o_orderkey AS also_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    return project(t(spark, sf, "orders"), [{"name": "id", "source": "o_orderkey", "type": "int64"}, {"name": "also_id", "source": "o_orderkey", "type": "int64"}, {"name": "status", "source": "o_orderstatus", "type": "utf8"}, {"name": "priority", "source": "o_orderpriority", "type": "utf8"}])


@query("SELECT s.n_name AS name, s.r_name AS region FROM (SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2) s")
def project_path(spark: SparkSession, sf: str) -> DataFrame:
    parent = t(spark, sf, "region").where("r_regionkey <> 2").select("r_regionkey", F.struct("r_name").alias("region"))
    nested = t(spark, sf, "nation").join(parent, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return project(nested, [{"name": "name", "source": "n_name", "type": "utf8"}, {"name": "region", "source": "region.r_name", "type": "utf8"}])


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer")
def exact_widen(spark: SparkSession, sf: str) -> DataFrame:
    return project(t(spark, sf, "customer"), [{"name": "c_custkey", "type": "int64"}, {"name": "nation", "source": "c_nationkey", "type": "int64"}, {"name": "balance", "source": "c_acctbal", "type": "double"}])


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,6)) AS price FROM lineitem")
def decimal_widen(spark: SparkSession, sf: str) -> DataFrame:
    money = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return project(money, [{"name": "l_orderkey", "type": "int64"}, {"name": "l_linenumber", "type": "int64"}, {"name": "price", "type": "decimal128(38,6)"}])


@query("SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def timestamp_to_ns(spark: SparkSession, sf: str) -> DataFrame:
    return project(t(spark, sf, "events"), [{"name": "event_id", "type": "int64"}, {"name": "ns", "source": "ts", "type": "timestamp(ns)"}])


@query("SELECT count(*) FILTER (WHERE epoch_us(ts) % 1000 <> 0) AS finer_than_ms FROM events")
def millisecond_exactness(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").agg(F.count_if((F.extract(F.lit("SECOND"), F.col("ts")) * 1_000_000).cast("long") % 1000 != 0).alias("finer_than_ms"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 150000")
def row_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return checks.row_predicate(t(spark, sf, "orders"), "o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 150000").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderpriority LIKE '1%' OR o_orderpriority IN ('2-HIGH')) AND NOT o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) >= DATE '1995-01-01'")
def object_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return checks.row_predicate(t(spark, sf, "orders"), "(o_orderpriority LIKE '1%' OR o_orderpriority IN ('2-HIGH')) AND NOT o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) >= DATE '1995-01-01'").select("o_orderkey", "o_orderpriority")


@query("""SELECT p_partkey, list_contains(string_split(replace(p_type, ' ', ';'), ';'), string_split(p_type, ' ')[1]) AS has_first,
  NOT (list_contains(string_split(replace(p_type, ' ', ';'), ';'), 'BRASS') OR (list_contains(string_split(replace(p_type, ' ', ';'), ';'), 'SMALL') AND list_contains(string_split(replace(p_type, ' ', ';'), ';'), 'TIN'))) AS neither FROM part""")
def multi_value_predicate(spark: SparkSession, sf: str) -> DataFrame:
    held = F.replace(F.col("p_type"), F.lit(" "), F.lit(";"))
    first = F.split("p_type", " ")[0]
    return t(spark, sf, "part").select("p_partkey", F.array_contains(F.split(held, ";"), first).alias("has_first"), excludes(held, ["BRASS", "SMALL;TIN"]).alias("neither"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 3")
def relative_date_predicate(spark: SparkSession, sf: str) -> DataFrame:
    events = t(spark, sf, "events").withColumn("day", F.to_date("ts"))
    today = events.agg(F.max("day").alias("today"))
    return events.crossJoin(F.broadcast(today)).where(last_n_days(F.col("day"), 3, F.col("today"))).select("event_id")  # one row on the right


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def derive_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", *[derive(F.col("o_orderdate"), u).alias(u[0]) for u in ("year", "month", "day")])


@query("SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS \"o_orderkey is null\", count(*) FILTER (WHERE n IS NULL) AS \"n is null\" FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS n FROM orders)")
def not_null_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("n"))
    return checks.violations(rows, checks.not_null(["o_orderkey", "n"]))


@query("SELECT count(*) FILTER (WHERE strftime(o_orderdate, '%Y') <> '1995') AS \"_year_ differs\" FROM orders")
def partition_assert(spark: SparkSession, sf: str) -> DataFrame:
    return checks.violations(t(spark, sf, "orders").withColumn("_year_", derive(F.col("o_orderdate"), "year")), checks.partition_values({"year": "1995"}))


@query("SELECT count(*) FILTER (WHERE coalesce(NOT regexp_full_match(c_mktsegment, '[a-z0-9][a-z0-9_-]{0,63}'), true)) AS \"c_mktsegment is no name\" FROM customer")
def partition_name_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.violations(t(spark, sf, "customer"), checks.partition_names(["c_mktsegment"]))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_rows FROM orders GROUP BY 1")
def partition_split(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").groupBy(derive(F.col("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n_rows"))


@query("SELECT o_orderkey, CAST(NULL AS DECIMAL(38,6)) AS tax, CAST(NULL AS VARCHAR) AS extra FROM orders")
def evolve_null_pad(spark: SparkSession, sf: str) -> DataFrame:
    return padded(t(spark, sf, "orders").select("o_orderkey"), TableContract((("o_orderkey", "int64"), ("tax", "decimal128(38,6)"), ("extra", "utf8"))))


@query("SELECT n_nationkey AS id, n_name AS label, CAST(NULL AS VARCHAR) AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'x' FROM region")
def union_versions(spark: SparkSession, sf: str) -> DataFrame:
    contract = TableContract((("id", "int64"), ("label", "utf8"), ("extra", "utf8")))
    old = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    new = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("label"), F.lit("x").alias("extra"))
    return padded(old, contract).unionByName(padded(new, contract))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal ASC NULLS FIRST, c_custkey ASC NULLS FIRST) AS place FROM (SELECT c_mktsegment, c_acctbal, c_custkey FROM customer WHERE c_acctbal <> 0)")
def canonical_place(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "customer").where("c_acctbal <> 0").select("c_mktsegment", "c_acctbal", "c_custkey")
    return canonical_places(rows, fresh(spark, "places")).select("c_custkey", "place")


@query("SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,6)) AS value, false AS bad FROM supplier")
def decimal_from_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    value, bad = decimal_from_text(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), 38, 6)
    return t(spark, sf, "supplier").select("s_suppkey", value.alias("value"), bad.alias("bad"))


@query("SELECT o_orderkey, o_orderkey AS whole, false AS bad, CAST(o_orderdate AS DATE) AS day, o_orderdate AS at FROM orders")
def texts_decoded(spark: SparkSession, sf: str) -> DataFrame:
    whole, bad = int_from_text(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0e0")))
    day, _ = date_from_text(F.date_format("o_orderdate", "yyyy-MM-dd"))
    at, _ = timestamp_from_text(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"), "ms", utc=False)
    return t(spark, sf, "orders").select("o_orderkey", whole.alias("whole"), bad.alias("bad"), day.alias("day"), at.alias("at"))


@query("SELECT p_partkey, p_retailprice AS value, false AS bad FROM part")
def double_from_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    value, bad = double_from_text(F.col("p_retailprice").cast("string"))
    return t(spark, sf, "part").select("p_partkey", value.alias("value"), bad.alias("bad"))


@query("SELECT count(*) FILTER (WHERE cell = '') AS refused, count(*) FILTER (WHERE nullif(cell, '') IS NULL) AS nulls FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS cell FROM orders)")
def bulk_empty_policy(spark: SparkSession, sf: str) -> DataFrame:
    cell = t(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("cell"))
    _, refused = empty_cells(F.col("cell"), "reject")
    nulled, _ = empty_cells(F.col("cell"), "null")
    return cell.agg(F.count_if(refused).alias("refused"), F.count_if(nulled.isNull()).alias("nulls"))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'BRASS') OR list_contains(string_split(p_type, ' '), 'TIN')")
def includes_any(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").where(includes(F.replace(F.col("p_type"), F.lit(" "), F.lit(";")), ["BRASS", "TIN"])).select("p_partkey")
