"""Revision algebra over histories made from the driver's tables, and the verbs end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.contract import TableContract
from tessera.dataset import Dataset, Destination
from tessera.errors import TesseraError
from tessera.functions.calendar import derive
from tessera.operators import versions
from tessera.operators.joins import append_new, latest
from tessera.plans.selection import choose
from tessera.plans import run
from tessera.plans.declaration import load
from tessera.queries import fresh, query, t

#: The state after revision r: pairs (priority, year-month) and the number of orders in them up to year 1994 + r.
STATE_SQL = "SELECT o_orderpriority AS \"table\", strftime(o_orderdate, '%m') AS \"partition\", count(*) AS version FROM orders WHERE year(o_orderdate) <= {year} AND NOT ({year} = 1996 AND o_orderpriority LIKE '1%') GROUP BY 1, 2"


def state(spark: SparkSession, sf: str, year: int) -> DataFrame:
    rows = t(spark, sf, "orders").where((F.year("o_orderdate") <= year) & ~(F.lit(year == 1996) & F.col("o_orderpriority").startswith("1")))
    return rows.groupBy(F.col("o_orderpriority").alias("table"), F.date_format("o_orderdate", "MM").alias("partition")).agg(F.count("*").alias("version"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    found = None
    for n, year in enumerate((1995, 1996, 1997), 1):
        one = state(spark, sf, year).withColumn("revision", F.lit(n).cast("long"))
        found = one if found is None else found.unionByName(one)
    return found


OLD, NEW = f"({STATE_SQL.format(year=1995)})", f"({STATE_SQL.format(year=1996)})"
HISTORY_SQL = " UNION ALL ".join(f"SELECT *, {n} AS revision FROM ({STATE_SQL.format(year=y)})" for n, y in enumerate((1995, 1996, 1997), 1))
DIFF_SQL = f"""SELECT coalesce(a."table", b."table") AS "table", coalesce(a."partition", b."partition") AS "partition", a.version AS old, b.version AS new,
  CASE WHEN a.version IS NULL THEN 'added' WHEN b.version IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM {OLD} a FULL JOIN {NEW} b ON a."table" = b."table" AND a."partition" = b."partition" WHERE a.version IS DISTINCT FROM b.version"""


@query(DIFF_SQL)
def revision_diff(spark: SparkSession, sf: str) -> DataFrame:
    return versions.diff(state(spark, sf, 1995), state(spark, sf, 1996))


@query(f"SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed FROM ({DIFF_SQL})")
def change_summary(spark: SparkSession, sf: str) -> DataFrame:
    return versions.summary(revision_diff(spark, sf))


@query(f"""SELECT n."table", n."partition", coalesce(o.version % 5 = n.version % 5, false) AS reused, CASE WHEN o.version % 5 = n.version % 5 THEN o.version ELSE n.version END AS version
  FROM {NEW} n LEFT JOIN {OLD} o ON o."table" = n."table" AND o."partition" = n."partition" """)
def version_dedup(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2((F.col("version") % 5).cast("string"), 256)
    found = versions.reuse(state(spark, sf, 1995).withColumn("digest", digest), state(spark, sf, 1996).withColumn("digest", digest))
    return found.select("table", "partition", "reused", "version")


@query(f"""SELECT "table", "partition" FROM {OLD} o WHERE NOT EXISTS (SELECT 1 FROM {NEW} n WHERE n."table" = o."table" AND n."partition" = o."partition") AND "table" IN ('1-URGENT', '2-HIGH')""")
def omissions_anti(spark: SparkSession, sf: str) -> DataFrame:
    return versions.omissions(state(spark, sf, 1995), state(spark, sf, 1996), ["1-URGENT", "2-HIGH"])


@query(f"""SELECT DISTINCT "table" FROM {OLD} WHERE "table" NOT IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def membership_guard(spark: SparkSession, sf: str) -> DataFrame:
    return versions.undeclared(state(spark, sf, 1995), ["1-URGENT", "2-HIGH"], ["5-LOW"])


@query(f"""WITH w AS (SELECT "table", "partition", max(version) + 1000 AS version FROM {NEW} GROUP BY ALL),
  o AS (SELECT "table", "partition" FROM {OLD} WHERE "table" LIKE '1%'), s AS (SELECT "table", "partition", 7 AS version FROM {OLD} WHERE "partition" = '02')
  SELECT "table", "partition", version FROM s UNION ALL
  SELECT "table", "partition", version FROM (SELECT * FROM w UNION ALL SELECT * FROM {OLD} b WHERE NOT EXISTS (SELECT 1 FROM w WHERE w."table" = b."table" AND w."partition" = b."partition")) k
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o."table" = k."table" AND o."partition" = k."partition") AND NOT EXISTS (SELECT 1 FROM s WHERE s."table" = k."table" AND s."partition" = k."partition")""")
def change_set_apply(spark: SparkSession, sf: str) -> DataFrame:
    old, new = state(spark, sf, 1995), state(spark, sf, 1996)
    chosen = old.where("partition = '02'").withColumn("version", F.lit(7).cast("long"))
    return versions.apply_changes(old, new.withColumn("version", F.col("version") + 1000), old.where("table LIKE '1%'"), chosen)


TRANSITIONS_SQL = f"""WITH h AS ({HISTORY_SQL}) SELECT coalesce(b.revision, a.revision + 1) AS revision, coalesce(a."table", b."table") AS "table", coalesce(a."partition", b."partition") AS "partition", a.version AS "before", b.version AS "after"
  FROM (SELECT * FROM h WHERE revision < 3) a FULL JOIN (SELECT * FROM h WHERE revision > 1) b ON a."table" = b."table" AND a."partition" = b."partition" AND a.revision + 1 = b.revision WHERE a.version IS DISTINCT FROM b.version"""


@query(f"SELECT * FROM ({TRANSITIONS_SQL}) WHERE \"table\" LIKE '1%'")
def aba_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """Table 1-URGENT is there, gone and back again: every pair shows both changes."""
    return versions.conflicts(history(spark, sf), 1, state(spark, sf, 1995).where("table LIKE '1%'"))


@query(f"""SELECT r.revision, count(*) FILTER (WHERE x.revision IS NOT NULL AND x."before" IS NULL) AS added, count(*) FILTER (WHERE x.revision IS NOT NULL AND x."after" IS NULL) AS removed, count(*) FILTER (WHERE x."before" IS NOT NULL AND x."after" IS NOT NULL) AS changed
  FROM (SELECT DISTINCT revision FROM ({HISTORY_SQL})) r LEFT JOIN ({TRANSITIONS_SQL}) x ON x.revision = r.revision GROUP BY 1""")
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    return versions.change_log(history(spark, sf))


@query(f"SELECT count(*) = 0 AS same FROM ((SELECT * FROM {OLD} EXCEPT ALL SELECT * FROM {OLD}) UNION ALL (SELECT * FROM {OLD} EXCEPT ALL SELECT * FROM {OLD}))")
def noop_check(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(versions.same_state(state(spark, sf, 1995), state(spark, sf, 1995)),)], "same boolean")


@query(f"""SELECT "table", "partition", version + 1000 AS version FROM {NEW} WHERE "partition" <> '03' AND "table" <> '5-LOW'
  UNION ALL SELECT "table", "partition", version FROM {OLD} o WHERE "table" <> '5-LOW' AND ("partition" = '03' OR NOT EXISTS (SELECT 1 FROM {NEW} n WHERE n."table" = o."table" AND n."partition" = o."partition"))""")
def build_selection(spark: SparkSession, sf: str) -> DataFrame:
    old, new = state(spark, sf, 1995), state(spark, sf, 1996)
    named = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    months = [f"{m:02}" for m in range(1, 13)]
    return choose(old, new.withColumn("version", F.col("version") + 1000), hold=[(n, "03") for n in named], drop=[("5-LOW", m) for m in months])


@query("""SELECT revision FROM (SELECT r_regionkey AS revision, CASE WHEN r_regionkey = 4 THEN NULL ELSE TIMESTAMP '2026-01-01 00:00:00' + r_regionkey * INTERVAL 1 HOUR END AS superseded_at FROM region)
  WHERE superseded_at IS NULL OR superseded_at > TIMESTAMP '2026-01-01 03:30:00' - INTERVAL 1 HOUR OR revision IN (0)""")
def kept_revisions(spark: SparkSession, sf: str) -> DataFrame:
    base = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    rows = t(spark, sf, "region").select(F.col("r_regionkey").alias("revision"), F.when(F.col("r_regionkey") != 4, base + F.make_dt_interval(hours=F.col("r_regionkey"))).alias("superseded_at"))
    none = spark.createDataFrame([], "revision int")
    return versions.kept_revisions(rows, F.lit("2026-01-01 03:30:00").cast("timestamp_ntz"), 3600, spark.createDataFrame([(0,)], "revision int"), none)


@query(f"""WITH h AS ({HISTORY_SQL}), v AS (SELECT DISTINCT "table", "partition", version FROM h) SELECT v."table", v."partition", v.version,
  CASE WHEN v."partition" = '01' THEN 'AlreadyPruned' WHEN EXISTS (SELECT 1 FROM h WHERE revision = 3 AND h."table" = v."table" AND h."partition" = v."partition" AND h.version = v.version) THEN 'Protected' ELSE 'Eligible' END AS class FROM v""")
def gc_candidates(spark: SparkSession, sf: str) -> DataFrame:
    own = history(spark, sf)
    written = own.select("table", "partition", "version").distinct()
    return versions.gc_candidates(written, own, spark.createDataFrame([(3,)], "revision long"), written.where("partition = '01'"))


@query(f"""SELECT "table", count(*) AS partitions, sum(version) AS n_rows FROM {OLD} GROUP BY 1""")
def list_tables(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf, 1995).groupBy("table").agg(F.count("*").alias("partitions"), F.sum("version").alias("n_rows"))


# The verbs, end to end. Each works in a fresh folder below the session's shared one.

LINES = TableContract((("l_orderkey", "int64"), ("l_linenumber", "int64"), ("price", "decimal128(18,2)"), ("_month_", "utf8")), ("month",))
TOTALS = TableContract((("month", "utf8"), ("total", "decimal128(38,4)")))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), derive(F.col("l_shipdate"), "month").alias("_month_"))


MONTHS_SQL = "SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,4)) AS total FROM lineitem GROUP BY 1"


@query(MONTHS_SQL)
def build_month_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Push lineitem by month, build monthly totals over its revision, pull them into a destination."""
    root = fresh(spark)
    raw, totals = Dataset(spark, root, "raw"), Dataset(spark, root, "month_totals")
    raw.push({"lineitem": (lines(spark, sf), LINES)}, {"lineitem": ["l_orderkey", "price"]})
    totals.build({"lines": (raw, "lineitem", "latest")}, {"totals": ("SELECT _month_ AS month, CAST(sum(price) AS DECIMAL(38,4)) AS total FROM input_lines GROUP BY _month_", TOTALS)}, {"totals": ["month", "total"]})
    target = Destination(spark, f"{root}/app")
    target.pull(totals, {"totals": {"table": "totals", "contract": TOTALS}})
    return target.read("totals", TOTALS)


@query("SELECT strftime(l_shipdate, '%Y-%m') AS _month_, count(*) AS n FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') IN ('1995-03', '1996-07') GROUP BY 1")
def partition_select(spark: SparkSession, sf: str) -> DataFrame:
    raw = Dataset(spark, fresh(spark), "raw")
    raw.push({"lineitem": (lines(spark, sf), LINES)})
    return raw.read("lineitem", partitions=[{"month": "1995-03"}, {"month": "1996-07"}]).groupBy("_month_").agg(F.count("*").alias("n"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS \"partition\", CASE WHEN strftime(l_shipdate, '%Y-%m') = '1995-03' THEN 2 ELSE 1 END AS version, count(*) FILTER (WHERE NOT (strftime(l_shipdate, '%Y-%m') = '1995-03' AND l_linenumber = 1)) AS n_rows FROM lineitem GROUP BY 1")
def push_reuses_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """A second push changes one month: only that partition gets a new version."""
    raw = Dataset(spark, fresh(spark), "raw")
    rows = lines(spark, sf)
    raw.push({"lineitem": (rows, LINES)})
    raw.push({"lineitem": (rows.where("NOT (_month_ = '1995-03' AND l_linenumber = 1)"), LINES)})
    return raw.state().select(F.replace(F.col("partition"), F.lit("month="), F.lit("")).alias("partition"), "version", "n_rows")


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def pull_append_new(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends with an anti-join on the destination's rows before the write: nothing twice."""
    root, contract = fresh(spark), TableContract((("id", "int64"), ("segment", "utf8")))
    source, target = Dataset(spark, root, "crm"), Destination(spark, f"{root}/app")
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    sql = "SELECT s.id, s.segment FROM source_customers s WHERE NOT EXISTS (SELECT 1 FROM target_customers t WHERE t.id = s.id)"
    for part in (rows.where("id % 3 = 0"), rows):
        source.push({"customers": (part, contract)})
        target.pull(source, {"customers": {"table": "customers", "sql": sql, "contract": contract}}, write="append", not_null={"customers": ["id"]})
    return target.read("customers", contract)


@query("SELECT o_custkey, max(o_orderdate) AS last_date FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def build_self_input(spark: SparkSession, sf: str) -> DataFrame:
    """A build that reads its own previous revision and folds a further input into it."""
    root, contract = fresh(spark), TableContract((("o_custkey", "int64"), ("last_date", "timestamp(us)")))
    raw, out = Dataset(spark, root, "orders"), Dataset(spark, root, "last_orders")
    orders = t(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01'").select("o_custkey", F.col("o_orderdate").alias("last_date"))
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    out.push({"last": (orders.limit(0), contract)})
    for part in (orders.where(F.col("last_date") < cut), orders.where(F.col("last_date") >= cut)):
        raw.push({"orders": (part, contract)})
        out.build({"new": (raw, "orders", "latest")}, {"last": ("SELECT o_custkey, max(last_date) AS last_date FROM (SELECT * FROM self_last UNION ALL SELECT * FROM input_new) GROUP BY o_custkey", contract)})
    return out.read("last")


@query("SELECT o.* EXCLUDE (o_orderdate) FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) o WHERE r = 1")
def qualify_latest(spark: SparkSession, sf: str) -> DataFrame:
    found = latest(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return found.select("o_custkey", "o_orderkey", F.lit(1).alias("r"))


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def append_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return append_new(t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), t(spark, sf, "customer"), ["c_custkey"]).select("c_custkey", "c_name")


LOW_BALANCE = """
declaration_version: 1
kind: push
dataset: crm
tables:
  - name: clients
    source: {table: customer, where: "c_acctbal < 1000 AND extract(YEAR FROM DATE '1995-01-01') = 1995"}
    columns:
      - {name: client, source: c_custkey, type: int64}
      - {name: balance, source: c_acctbal, type: double}
  - name: bills
    source: {table: orders}
    partition_keys: [year]
    columns:
      - {name: client, source: o_custkey, type: int64}
      - {name: bill, source: o_orderkey, type: int64}
      - {name: billed_at, source: o_orderdate, type: "timestamp(us)"}
      - {name: _year_, type: utf8, derive: {from: billed_at, unit: year}}
checks:
  - {table: bills, not_null: [client, bill]}
"""
BILLS_BUILD = """
declaration_version: 1
kind: push
dataset: bills_by_client
build:
  inputs:
    - {as: clients, table: crm/clients}
    - {as: bills, table: crm/bills}
tables:
  - name: counts
    select: {sql: "SELECT b.client, count(*) AS bills FROM input_bills b JOIN input_clients c ON c.client = b.client WHERE b._year_ >= '1995' GROUP BY b.client"}
    columns: [{name: client, type: int64}, {name: bills, type: int64}]
checks:
  - {table: counts, not_null: [client]}
"""
BILLS_PULL = """
declaration_version: 1
kind: pull
dataset: bills_by_client
write: replace
tables:
  - name: counts
    target: {table: bill_counts}
checks: []
"""


@query("SELECT o_custkey AS client, count(*) AS bills FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 1000 AND year(o_orderdate) >= 1995 GROUP BY 1")
def declared_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Three declarations: push two tables, build over their revision, pull the result."""
    root = fresh(spark)
    target = Destination(spark, f"{root}/app")
    run.push(spark, load(LOW_BALANCE), root, {"customer": t(spark, sf, "customer"), "orders": t(spark, sf, "orders")})
    run.push(spark, load(BILLS_BUILD), root, {})
    contracts = run.pull(spark, load(BILLS_PULL), root, target)
    return target.read("bill_counts", contracts["bill_counts"])


REGION_COUNTS = TableContract((("region", "int64"), ("nations", "int64"), ("_kind_", "utf8")), ("kind",))


def nations(spark: SparkSession, sf: str, where: str) -> DataFrame:
    rows = t(spark, sf, "nation").where(where).groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.count("*").alias("nations"))
    return rows.withColumn("_kind_", F.when(F.col("region") < 2, "low").when(F.col("region") < 4, "mid").otherwise("high"))


@query("""SELECT region, nations, kind AS _kind_ FROM (SELECT n_regionkey AS region, CASE WHEN n_regionkey < 2 THEN 'low' WHEN n_regionkey < 4 THEN 'mid' ELSE 'high' END AS kind,
  CASE WHEN n_regionkey < 2 THEN count(*) FILTER (WHERE n_nationkey % 2 = 0) ELSE count(*) END AS nations FROM nation GROUP BY n_regionkey) WHERE kind <> 'high'""")
def selected_build(spark: SparkSession, sf: str) -> DataFrame:
    """A build whose selection lets in one partition, holds another and empties the third."""
    root = fresh(spark)
    raw, out = Dataset(spark, root, "raw"), Dataset(spark, root, "regions")
    out.push({"counts": (nations(spark, sf, "true"), REGION_COUNTS)})
    raw.push({"counts": (nations(spark, sf, "n_nationkey % 2 = 0").where("_kind_ <> 'high'"), REGION_COUNTS)})
    chosen = {"policy": "explicit", "include": [("counts", "kind=low")], "hold": [("counts", "kind=mid")], "empty": [("counts", "kind=high")]}
    out.build({"raw": (raw, "counts", "latest")}, {"counts": ("SELECT region, nations, _kind_ FROM input_raw", REGION_COUNTS)}, selection=chosen)
    return out.read("counts")


@query("""SELECT 'kind=' || kind AS "partition", CASE kind WHEN 'low' THEN 2 ELSE 1 END AS version, CASE kind WHEN 'low' THEN 'second' ELSE 'first' END AS reason, count(*) AS n_rows
  FROM (SELECT DISTINCT n_regionkey, CASE WHEN n_regionkey < 2 THEN 'low' WHEN n_regionkey < 4 THEN 'mid' ELSE 'high' END AS kind FROM nation) GROUP BY kind""")
def show_revision(spark: SparkSession, sf: str) -> DataFrame:
    """What a revision holds, and which run wrote each version."""
    d = Dataset(spark, fresh(spark), "regions")
    rows = nations(spark, sf, "true")
    d.push({"counts": (rows, REGION_COUNTS)}, reason="first")
    d.push({"counts": (rows.withColumn("nations", F.when(F.col("_kind_") == "low", F.col("nations") + 1).otherwise(F.col("nations"))), REGION_COUNTS)}, reason="second")
    return d.show().select("partition", "version", "reason", "n_rows")


@query("""SELECT 2 AS revision, 1 AS "tables", 3 AS partitions, count(DISTINCT n_regionkey) AS n_rows, 1 AS pins, 0 AS unpublished FROM nation""")
def status_of(spark: SparkSession, sf: str) -> DataFrame:
    d = Dataset(spark, fresh(spark), "regions")
    for reason in ("n_nationkey % 2 = 0", "true"):
        d.push({"counts": (nations(spark, sf, reason), REGION_COUNTS)}, reason=reason)
    d.pin(1, "keep")
    return d.status().select(F.col("revision").cast("long").alias("revision"), "tables", "partitions", "n_rows", F.col("pins").cast("long").alias("pins"), F.col("unpublished").cast("long").alias("unpublished"))


@query("""SELECT * FROM (VALUES ('kind=low', 1, 'AlreadyPruned', ''), ('kind=low', 2, 'NeedsHoldRelease', 'hold'), ('kind=low', 3, 'Protected', 'latest'), ('kind=mid', 1, 'Protected', 'hold,latest'), ('kind=high', 1, 'Protected', 'hold,latest')) AS v("partition", version, class, reasons)""")
def gc_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Three pushes that change one partition; its first version is pruned, its second held."""
    d = Dataset(spark, fresh(spark), "regions")
    rows = nations(spark, sf, "true")
    for n in range(3):
        d.push({"counts": (rows.withColumn("nations", F.when(F.col("_kind_") == "low", F.col("nations") + n).otherwise(F.col("nations"))), REGION_COUNTS)})
    held = spark.createDataFrame([(2,)], "revision long")
    d.prune(holds=held)
    return d.gc(holds=held).select("partition", F.col("version").cast("int").alias("version"), "class", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 12")
def pull_replaces_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A replacing pull clears the target that its plan no longer names; an append adds rows to what is there."""
    root, contract = fresh(spark), TableContract((("id", "int64"),))
    source, target = Dataset(spark, root, "suppliers"), Destination(spark, f"{root}/app")
    rows = t(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), "s_nationkey")
    source.push({"all": (rows.select("id"), contract), "low": (rows.where("s_nationkey < 6").select("id"), contract), "mid": (rows.where("s_nationkey BETWEEN 6 AND 11").select("id"), contract)})
    target.pull(source, {"a": {"table": "low", "contract": contract}, "b": {"table": "all", "contract": contract}})
    target.pull(source, {"a": {"table": "low", "contract": contract}})
    target.pull(source, {"a": {"table": "mid", "contract": contract}}, write="append")
    return target.read("a", contract).unionByName(target.read("b", contract))


@query("SELECT 'refused' AS outcome, count(*) AS n FROM region WHERE r_regionkey = 0")
def build_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """A build whose input goes back to its own output is refused."""
    root, contract = fresh(spark), TableContract((("id", "int64"),))
    a, b, c = (Dataset(spark, root, n) for n in ("a", "b", "c"))
    a.push({"t": (t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id")), contract)})
    b.build({"x": (a, "t", "latest")}, {"t": ("SELECT id FROM input_x", contract)})
    c.build({"x": (b, "t", "latest")}, {"t": ("SELECT id FROM input_x", contract)})
    try:
        a.build({"x": (c, "t", "latest")}, {"t": ("SELECT id FROM input_x", contract)})
    except TesseraError as e:
        return spark.createDataFrame([("refused" if "goes back" in str(e) else str(e), 1)], "outcome string, n long")
    return spark.createDataFrame([("published", 1)], "outcome string, n long")
