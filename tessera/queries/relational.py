"""The delegated SELECT surface: joins, aggregates, windows, sets, scalar families. Most are plain SQL in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import asof_join, range_join
from tessera.operators.quantiles import with_medians
from tessera.queries import query, same_sql, t

M = "CAST({c} AS DECIMAL(18,2))"
PRICE, BAL = "CAST(l_extendedprice AS DECIMAL(18,2))", "CAST(c_acctbal AS DECIMAL(18,2))"

# Joins
same_sql("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", ["customer", "orders"])
same_sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation} WHERE n_regionkey <> r_regionkey", ["region", "nation"])
same_sql("join_scalar_subquery", "SELECT s_suppkey, (SELECT count(*) FROM {nation}) AS nations FROM {supplier}", ["supplier", "nation"])
same_sql("join_inner", "SELECT o_orderkey, c_mktsegment FROM {orders} JOIN {customer} ON o_custkey = c_custkey", ["orders", "customer"])
same_sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'P'", ["customer", "orders"])
same_sql("join_right", "SELECT n_name, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey", ["supplier", "nation"])
same_sql("join_full", "SELECT r_name, s_suppkey FROM (SELECT * FROM {region} WHERE r_regionkey < 3) r FULL OUTER JOIN (SELECT s_suppkey, s_nationkey % 5 AS k FROM {supplier}) s ON r_regionkey = k", ["region", "supplier"])
same_sql("join_in_subquery", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)", ["part", "lineitem"])
same_sql("join_correlated", f"SELECT c_custkey, (SELECT max(o_orderkey) FROM {{orders}} WHERE o_custkey = c_custkey) AS last_key FROM {{customer}}", ["customer", "orders"])  # noqa: F541
same_sql("join_lateral", "SELECT n_name, top FROM {nation}, LATERAL (SELECT max(s_suppkey) AS top FROM {supplier} WHERE s_nationkey = n_nationkey) x", ["nation", "supplier"])


@query("SELECT event_id, (SELECT max(o_orderdate) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate <= e.ts) AS o_orderdate FROM events e")
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    events = t(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id", "ts")
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    return asof_join(events, orders, ["k"], "ts", "o_orderdate", ["o_orderdate"]).select("event_id", "o_orderdate")


@query("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, 900.0 + s_suppkey AS low, 905.0 + s_suppkey AS high FROM supplier) s ON p_retailprice >= low AND p_retailprice < high")
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    ranges = t(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") + 900.0).alias("low"), (F.col("s_suppkey") + 905.0).alias("high"))
    return range_join(t(spark, sf, "part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "low", "high", 5.0).select("p_partkey", "s_suppkey")


# Aggregates
same_sql("agg_sum_decimal", f"SELECT l_returnflag, CAST(sum({PRICE}) AS DECIMAL(38,4)) AS total FROM {{lineitem}} GROUP BY l_returnflag", ["lineitem"])
same_sql("agg_global", f"SELECT count(*) AS n, CAST(sum({PRICE}) AS DECIMAL(38,2)) AS total, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM {{lineitem}}", ["lineitem"])
same_sql("agg_text_length", "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars FROM {documents} GROUP BY lang", ["documents"])
same_sql("agg_distinct_filter_having", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_quantity > 25) AS large FROM {lineitem} GROUP BY l_returnflag HAVING count(*) > 10", ["lineitem"])
same_sql("agg_moments", "SELECT l_linenumber, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(skewness(l_quantity), 4) AS sk FROM {lineitem} GROUP BY l_linenumber", ["lineitem"], "SELECT l_linenumber, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(avg(pow((l_quantity - m) / s, 3)), 4) AS sk FROM (SELECT *, avg(l_quantity) OVER w AS m, stddev_pop(l_quantity) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_linenumber)) GROUP BY l_linenumber")
same_sql("agg_pairs", "SELECT o_orderstatus, round(corr(o_orderkey, o_custkey), 6) AS c, round(covar_pop(o_orderkey, o_custkey), 2) AS v, round(regr_slope(o_orderkey, o_custkey), 6) AS slope, CAST(regr_count(o_orderkey, o_custkey) AS BIGINT) AS n FROM {orders} GROUP BY o_orderstatus", ["orders"])
same_sql("agg_median_quantile", "SELECT p_brand, median(p_size) AS med, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_size) AS q FROM {part} GROUP BY p_brand", ["part"], "SELECT p_brand, median(p_size) AS med, quantile_cont(p_size, 0.25) AS q FROM part GROUP BY p_brand")
same_sql("agg_arg_extremes", "SELECT c_nationkey, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS richest, min_by(c_custkey, struct(c_acctbal, c_custkey)) AS poorest FROM {customer} GROUP BY c_nationkey", ["customer"], "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey")
same_sql("agg_bool_bits", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some, bit_and(o_custkey) AS ba, bit_or(o_custkey) AS bo, bit_xor(o_custkey) AS bx FROM {orders} GROUP BY o_orderstatus", ["orders"])
same_sql("agg_list_text", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey", ["nation"], "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
same_sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", ["lineitem"])
same_sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", ["orders"])
same_sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", ["orders"])
same_sql("agg_entropy", "SELECT round(-sum(n / total * log2(n / total)), 6) AS entropy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM {orders} GROUP BY o_orderpriority)", ["orders"], "SELECT round(entropy(o_orderpriority), 6) AS entropy FROM orders")
same_sql("agg_content_hash", "SELECT lang, sha2(concat_ws(':', count(text), sum(CAST(h AS DECIMAL(38,0))), bit_xor(h)), 256) AS digest FROM (SELECT lang, text, CAST(conv(substr(md5(text), 1, 15), 16, 10) AS BIGINT) AS h FROM {documents}) GROUP BY lang", ["documents"], "SELECT lang, sha256(concat_ws(':', count(text), sum(h), bit_xor(h))) AS digest FROM (SELECT lang, text, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h FROM documents) GROUP BY lang")
same_sql("agg_shape", "SELECT l_linenumber, round(kurtosis(l_quantity), 4) AS ku, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ri, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(any_value(l_linenumber) AS BIGINT) AS one FROM {lineitem} GROUP BY l_linenumber", ["lineitem"], "SELECT l_linenumber, round(kurtosis_pop(l_quantity), 4) AS ku, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ri, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(any_value(l_linenumber) AS BIGINT) AS one FROM lineitem GROUP BY l_linenumber")
same_sql("agg_mode_disc", "SELECT p_brand, CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size) AS BIGINT) AS q, mode(substr(p_brand, 1, 5)) AS m FROM {part} GROUP BY p_brand", ["part"], "SELECT p_brand, CAST(quantile_disc(p_size, 0.25) AS BIGINT) AS q, mode(substr(p_brand, 1, 5)) AS m FROM part GROUP BY p_brand")
same_sql("agg_histogram", "SELECT o_orderstatus, floor(o_totalprice / 100000) AS bin, count(*) AS n FROM {orders} GROUP BY 1, 2", ["orders"], "SELECT o_orderstatus, CAST(floor(o_totalprice / 100000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1, 2")
same_sql("agg_first_last", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order FROM {orders} GROUP BY o_custkey", ["orders"], "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY o_custkey")


@query("SELECT l_returnflag, true AS distinct_near, true AS median_near FROM lineitem GROUP BY l_returnflag")
def agg_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate aggregates against exact ones: distinct parts in two steps, the median from around its estimate."""
    items = t(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice")
    parts = items.groupBy("l_returnflag", "l_partkey").agg(F.lit(1)).groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts")).withColumnRenamed("l_returnflag", "flag")
    rough = items.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("near_parts"), F.percentile_approx("l_extendedprice", [0.495, 0.5, 0.505], 1000).alias("around"))
    rough = rough.select("l_returnflag", "near_parts", F.col("around")[1].alias("near_median"), F.array(F.col("around")[0], F.col("around")[2]).alias("bounds"))
    both = with_medians(items, ["l_returnflag"], "l_extendedprice", rough, "bounds").join(F.broadcast(parts), F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return both.select(
        "l_returnflag",
        (F.abs(F.col("near_parts") - F.col("parts")) <= 0.1 * F.col("parts")).alias("distinct_near"),
        (F.abs(F.col("near_median") - F.col("median")) <= 0.05 * F.col("median")).alias("median_near"),
    )


@query("SELECT n_regionkey, product(n_nationkey % 3 + 1) AS p FROM nation GROUP BY n_regionkey")
def agg_product(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "nation").groupBy("n_regionkey").agg(F.product(F.col("n_nationkey") % 3 + 1).alias("p"))



# Windows
W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
same_sql("win_ranks", f"SELECT o_orderkey, row_number() OVER ({W}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(3) OVER ({W}) AS nt FROM {{orders}}", ["orders"])
same_sql("win_distribution", f"SELECT o_orderkey, round(percent_rank() OVER ({W}), 6) AS pr, round(cume_dist() OVER ({W}), 6) AS cd FROM {{orders}}", ["orders"])
same_sql("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER ({W}) AS prev, lead(o_orderkey, 2, -1L) OVER ({W}) AS next2 FROM {{orders}}", ["orders"], f"SELECT o_orderkey, lag(o_orderkey) OVER ({W}) AS prev, lead(o_orderkey, 2, -1) OVER ({W}) AS next2 FROM orders")
same_sql("win_values", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({W}) AS f, last_value(o_orderkey) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM {{orders}}", ["orders"])
same_sql("win_rows_frame", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS s FROM {{orders}}", ["orders"])
same_sql("win_range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {lineitem}", ["lineitem"])

# Sort, limit, sets, recursion
same_sql("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", ["orders"])
same_sql("limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 10 OFFSET 25", ["customer"])
for _name, _op in (("set_union_all", "UNION ALL"), ("set_union", "UNION"), ("set_intersect", "INTERSECT"), ("set_except", "EXCEPT"), ("set_intersect_all", "INTERSECT ALL"), ("set_except_all", "EXCEPT ALL")):
    same_sql(_name, f"SELECT s_nationkey AS k FROM {{supplier}} {_op} SELECT n_nationkey % 10 AS k FROM {{nation}}", ["supplier", "nation"])
same_sql("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT c_custkey, n FROM {customer} JOIN big ON o_custkey = c_custkey WHERE n > 12", ["customer", "orders"])
same_sql("chain_walk", "WITH RECURSIVE chain(revision, previous) AS (SELECT n_nationkey, n_nationkey - 1 FROM {nation} WHERE n_nationkey = 24 UNION ALL SELECT n.n_nationkey, n.n_nationkey - 1 FROM {nation} n JOIN chain ON n.n_nationkey = previous) SELECT revision, previous FROM chain", ["nation"])
same_sql("values_rows", "SELECT a, b FROM VALUES (1, 'x'), (2, 'y') AS v(a, b)", [], "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)")
same_sql("range_series", "SELECT id FROM range(1, 50, 3)", [], "SELECT range AS id FROM range(1, 50, 3)")
same_sql("generate_series", "SELECT explode(sequence(2, 20, 2)) AS g", [], "SELECT generate_series AS g FROM generate_series(2, 20, 2)")
same_sql("typed_empty", "SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS STRING) AS label WHERE false", [], "SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS label WHERE false")

# Scalar families
same_sql("fn_nulls", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, greatest(o_custkey, 100) AS g, least(o_custkey, 100) AS l FROM {orders}", ["orders"])
same_sql("fn_strings", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_name, 2, 4) AS s, replace(p_name, 'a', '-') AS r, p_brand || '/' || p_type AS c, reverse(p_brand) AS v, repeat('ab', p_size % 4) AS rep, lpad(p_brand, 12, '*') AS lp, instr(p_type, 'A') AS pos, md5(p_name) AS h FROM {part}", ["part"])
same_sql("fn_patterns", "SELECT p_partkey, p_type LIKE '%BRASS' AS l, p_type RLIKE '^(SMALL|LARGE)' AS m, regexp_replace(p_type, '[AEIOU]', '') AS r, split(p_type, ' ')[0] AS w, levenshtein(p_brand, 'Brand#11') AS d FROM {part}", ["part"], "SELECT p_partkey, p_type LIKE '%BRASS' AS l, regexp_matches(p_type, '^(SMALL|LARGE)') AS m, regexp_replace(p_type, '[AEIOU]', '', 'g') AS r, string_split(p_type, ' ')[1] AS w, levenshtein(p_brand, 'Brand#11') AS d FROM part")
same_sql("fn_math", "SELECT l_orderkey, l_linenumber, abs(l_linenumber - 4) AS a, l_linenumber % 3 AS m, round(sqrt(l_quantity), 6) AS s, floor(l_quantity / 7) AS f, ceil(l_quantity / 7) AS c, sign(l_quantity - 25) AS g, CAST(l_orderkey div 4 AS BIGINT) AS d FROM {lineitem}", ["lineitem"], "SELECT l_orderkey, l_linenumber, abs(l_linenumber - 4) AS a, l_linenumber % 3 AS m, round(sqrt(l_quantity), 6) AS s, CAST(floor(l_quantity / 7) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, CAST(sign(l_quantity - 25) AS DOUBLE) AS g, l_orderkey // 4 AS d FROM lineitem")
same_sql("fn_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, date_trunc('MONTH', o_orderdate) AS m, date_add(CAST(o_orderdate AS DATE), 30) AS d, CAST(datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS n, last_day(CAST(o_orderdate AS DATE)) AS e FROM {orders}", ["orders"], "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS d, DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS n, last_day(o_orderdate) AS e FROM orders")
same_sql("fn_nested", "SELECT o_custkey, size(collect_list(o_orderkey)) AS n, array_max(collect_list(o_orderkey)) AS hi, aggregate(transform(collect_list(o_orderkey), x -> x % 10), 0L, (s, x) -> s + x) AS digits, size(filter(collect_list(o_orderkey), x -> x % 2 = 0)) AS even FROM {orders} GROUP BY o_custkey", ["orders"], "SELECT o_custkey, len(list(o_orderkey)) AS n, list_max(list(o_orderkey)) AS hi, CAST(list_sum(list_transform(list(o_orderkey), lambda x: x % 10)) AS BIGINT) AS digits, len(list_filter(list(o_orderkey), lambda x: x % 2 = 0)) AS even FROM orders GROUP BY o_custkey")
same_sql("fn_blobs", "SELECT p_partkey, hex(encode(p_brand, 'UTF-8')) AS h, base64(encode(p_brand, 'UTF-8')) AS b, octet_length(p_name) AS n FROM {part}", ["part"], "SELECT p_partkey, hex(encode(p_brand)) AS h, base64(encode(p_brand)) AS b, octet_length(encode(p_name)) AS n FROM part")
same_sql("fn_time_bucket", "SELECT window(ts, '1 hour').start AS start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2", ["events"], "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
same_sql("fn_error_guard", "SELECT CASE WHEN count(*) = 0 THEN 0 ELSE raise_error('negative quantity') END AS bad FROM {lineitem} WHERE l_quantity < 0", ["lineitem"], "SELECT CASE WHEN count(*) = 0 THEN 0 ELSE error('negative quantity') END AS bad FROM lineitem WHERE l_quantity < 0")
same_sql("fn_typeof", "SELECT typeof(o_orderkey) AS a, count(*) AS n FROM {orders} GROUP BY 1", ["orders"], "SELECT lower(typeof(o_orderkey)) AS a, count(*) AS n FROM orders GROUP BY 1")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DECIMAL(20,2)) AS twice FROM orders")
def macro_scalar(spark: SparkSession, sf: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_twice(x DECIMAL(18,2)) RETURNS DECIMAL(20,2) RETURN x * 2")
    return spark.sql("SELECT o_orderkey, tessera_twice(CAST(o_totalprice AS DECIMAL(18,2))) AS twice FROM {orders}", orders=t(spark, sf, "orders"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 = 3 AND o_orderstatus = 'F'")
def macro_table(spark: SparkSession, sf: str) -> DataFrame:
    t(spark, sf, "orders").createOrReplaceTempView("tessera_orders")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_orders_of(s STRING, k BIGINT) RETURNS TABLE(o_orderkey BIGINT, o_custkey BIGINT) RETURN SELECT o_orderkey, o_custkey FROM tessera_orders WHERE o_orderstatus = s AND o_custkey % 7 = k")
    return spark.sql("SELECT * FROM tessera_orders_of('F', 3)")
