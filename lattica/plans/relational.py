"""Queries of the relational core: scans, predicates, joins, grouping, windows, ordering, set operations.

Each entry is name -> (query, SQL for DuckDB). Where both engines take the same text it is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import dml, joins, predicates, recursion, rows
from lattica.session import Query, sql, table

QUERIES: dict[str, tuple[Query, str | None]] = {}


def both(name: str, text: str) -> None:
    QUERIES[name] = (sql(text), text)


def two(name: str, spark_text: str, duck_text: str) -> None:
    QUERIES[name] = (sql(spark_text), duck_text)


def query(duck_text: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, duck_text)
        return f

    return add


# --- scans and projections ----------------------------------------------------------------------------------------

both("scan_filter_sum", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.07 AS DOUBLE) AND l_quantity < 24")
both("scan_column_aliases", "SELECT k, n FROM (SELECT * FROM nation) AS t(k, n, r) WHERE r < 3")
both("scan_subquery", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 10")
both("scan_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
two("scan_whole_table", "TABLE region", "SELECT * FROM region")
two("scan_numbers", "SELECT id AS n, id * id AS sq FROM range(100)", "SELECT range AS n, range * range AS sq FROM range(100)")
two("scan_series", "SELECT explode(sequence(1, 50, 7)) AS n", "SELECT CAST(unnest(generate_series(1, 50, 7)) AS INTEGER) AS n")
two("scan_zipped_functions", "SELECT z.xs AS a, z.ys AS b FROM (SELECT explode(arrays_zip(xs, ys)) AS z FROM (SELECT array(1, 2, 3) AS xs, array(10, 20) AS ys))", "SELECT unnest([1, 2, 3]) AS a, unnest([10, 20]) AS b")
two("scan_with_ordinality", "SELECT pos + 1 AS ord, v FROM (SELECT posexplode(array('p', 'q', 'r')) AS (pos, v))", "SELECT CAST(generate_subscripts(['p', 'q', 'r'], 1) AS INTEGER) AS ord, unnest(['p', 'q', 'r']) AS v")
two("scan_json_records", "SELECT event_id, from_json(props, 'k INT').k AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
both("project_where_having", "SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority HAVING count(*) > 5")
both("project_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
two("project_star_except", "SELECT * EXCEPT (c_acctbal, c_name) FROM customer", "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")
two("project_star_replace", "SELECT c_custkey, upper(c_name) AS c_name FROM customer", "SELECT * REPLACE (upper(c_name) AS c_name) FROM (SELECT c_custkey, c_name FROM customer)")
both("cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT avg(t) AS m FROM a) SELECT o_custkey, round(t, 2) AS t FROM a, b WHERE t > 1.5 * m")
two("scalar_alias_cte", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45", "WITH x AS (SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45) SELECT l_orderkey, net FROM x")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0")
def query_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = :nation AND c_acctbal > :least", args={"nation": 7, "least": 0})


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def dynamic_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    named = [c for c in orders.columns if "order" in c and c != "o_orderdate"]
    return orders.select(*named)


# --- predicates ---------------------------------------------------------------------------------------------------

both("predicate_in_list", "SELECT count(*) AS n FROM part WHERE p_size IN (1, 5, 9, 49) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
both("predicate_in_subquery", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
both("predicate_not_in_null_aware", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 1) FROM customer WHERE c_acctbal < 0 OR c_custkey = 1)")
both("predicate_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_' OR p_type LIKE 'S%'")
both("predicate_ilike", "SELECT count(*) AS n FROM customer WHERE c_name ILIKE 'CUSTOMER%1'")
both("predicate_null_tests", "SELECT count(*) FILTER (WHERE x IS NULL) AS nulls, count(*) FILTER (WHERE x IS NOT NULL) AS others, count(*) FILTER (WHERE (x > 3) IS TRUE) AS yes FROM (SELECT nullif(p_size, 1) AS x FROM part) t")
both("predicate_distinct_from", "SELECT count(*) AS n FROM (SELECT nullif(p_size, 1) AS x, nullif(p_size, 2) AS y FROM part) t WHERE x IS DISTINCT FROM y")
both("predicate_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
both("predicate_not_exists", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
both("predicate_row_comparison", "SELECT count(*) AS n FROM lineitem WHERE (l_linenumber, l_quantity) IN (SELECT 1, CAST(5 AS DOUBLE) UNION ALL SELECT 2, CAST(7 AS DOUBLE))")
both("predicate_case", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM orders GROUP BY 1")
both("predicate_casts", "SELECT CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR(20)) AS k, TRY_CAST(o_orderpriority AS INTEGER) AS bad FROM orders WHERE CAST(o_totalprice AS DECIMAL(18, 2)) % 1 < CAST(0.4 AS DECIMAL(3, 2))".replace("CAST(o_totalprice AS BIGINT) AS whole", "CAST(floor(o_totalprice) AS BIGINT) AS whole"))
both("predicate_coalesce_family", "SELECT p_partkey, coalesce(nullif(p_size, 1), -1) AS c, greatest(p_size, 10) AS g, least(p_size, 10) AS l FROM part")
both("scalar_subquery_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
two("predicate_is_json", "SELECT count(*) AS n FROM events WHERE try_parse_json(props) IS NOT NULL", "SELECT count(*) AS n FROM events WHERE json_valid(props)")
two("predicate_choose", "SELECT o_orderkey, element_at(array('a', 'b', 'c'), CAST(o_orderkey % 3 AS INT) + 1) AS pick FROM orders", "SELECT o_orderkey, ['a', 'b', 'c'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS pick FROM orders")
two("predicate_collate", "SELECT count(*) AS n FROM region WHERE r_name COLLATE UNICODE_CI = 'asia'", "SELECT count(*) AS n FROM region WHERE lower(r_name) = 'asia'")


@query("SELECT count(*) AS n FROM part WHERE p_size BETWEEN least(30, 10) AND greatest(30, 10)")
def predicate_between_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(predicates.between_symmetric(F.col("p_size"), F.lit(30), F.lit(10))).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_type SIMILAR TO '(S|P).*' OR p_brand SIMILAR TO 'Brand#[12].'")
def predicate_similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(predicates.similar_to(F.col("p_type"), "(S|P)%") | predicates.similar_to(F.col("p_brand"), "Brand#[12]_")).select("p_partkey")


@query("SELECT count(*) AS n FROM orders o, (VALUES (TIMESTAMP '1996-03-01', TIMESTAMP '1996-02-01')) v(a, b) WHERE o_orderdate < greatest(a, b) AND least(a, b) < o_orderdate + INTERVAL 10 DAY")
def predicate_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d = lambda x: F.lit(x).cast("timestamp_ntz").cast(o.schema["o_orderdate"].dataType)
    return o.filter(predicates.overlaps(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 10 DAY"), d("1996-03-01"), d("1996-02-01"))).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)")
def predicate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return predicates.compared_to_all(s, "s_acctbal", ">=", s.filter("s_nationkey = 3"), "s_acctbal").select("s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)")
def predicate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return predicates.compared_to_all(s, "s_acctbal", "<", s.filter("s_nationkey = 3"), "s_acctbal", "ANY").select("s_suppkey")


@query(r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'license') AND list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'apache')")
def predicate_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(predicates.text_match(F.col("text"), ["license", "apache"])).select("doc_id")


# --- joins --------------------------------------------------------------------------------------------------------

both("join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
both("join_left", "SELECT o_orderkey, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
both("join_right", "SELECT n_nationkey, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey")
both("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k")
both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < n_nationkey % 5")
both("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y USING (k)")
both("join_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y")
both("join_multiway", "SELECT r_name, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
both("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
two("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
two("join_anti", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON l_orderkey = o_orderkey", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
both("join_constant", "SELECT count(*) AS n FROM region LEFT JOIN nation ON false")
two("join_null_safe", "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k <=> b.k", "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
two("join_hints", "SELECT /*+ BROADCAST(n) */ n_name, count(*) AS k FROM supplier s JOIN nation n ON s_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS k FROM supplier s JOIN nation n ON s_nationkey = n_nationkey GROUP BY n_name")
for _hint in ("MERGE", "SHUFFLE_HASH", "SHUFFLE_REPLICATE_NL"):
    two(f"join_hint_{_hint.lower()}", f"SELECT /*+ {_hint}(n) */ n_name, count(*) AS k FROM supplier s JOIN nation n ON s_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS k FROM supplier s JOIN nation n ON s_nationkey = n_nationkey GROUP BY n_name")
two("join_parenthesised", "SELECT r_name, j.n_name, j.s_suppkey FROM region LEFT JOIN (nation JOIN supplier ON s_nationkey = n_nationkey) AS j ON j.n_regionkey = r_regionkey", "SELECT r_name, n_name, s_suppkey FROM region LEFT JOIN (nation JOIN supplier ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey")
two("join_array_left", "SELECT c_custkey, x FROM customer LATERAL VIEW OUTER explode(CASE WHEN c_acctbal > 0 THEN array(1, 2) ELSE CAST(array() AS ARRAY<INT>) END) t AS x", "SELECT c_custkey, unnest([1, 2]) AS x FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE NOT c_acctbal > 0 OR c_acctbal IS NULL")
two("join_pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority AS p, o_orderkey FROM orders) PIVOT (count(o_orderkey) AS n FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p_))", "SELECT o_orderpriority AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p_ FROM orders GROUP BY 1")
two("join_unpivot", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR what IN (l_discount, l_tax))", "SELECT l_orderkey, l_linenumber, what, v FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR what IN (l_discount, l_tax))")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def join_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.any_join(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], [F.col("o_orderkey")])


@query("SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]  # nulls as in DuckDB
    return joins.lateral_top(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", order, 2).select("c_custkey", "o_orderkey")


@query("SELECT e.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return joins.asof_join(left, right, ["user_id"], "ts", "ts", ["view_id"]).select("event_id", "view_id")


@query("SELECT a.n_name AS a, b.r_name AS b FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) b ON a.i = b.i")
def join_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a")), table(spark, sf_dir, "region").select(F.col("r_name").alias("b"))
    return joins.paste_join(a, b, ["a"], ["b"])


@query("SELECT s_suppkey, band FROM supplier JOIN (VALUES (-1000, 0, 'red'), (0, 5000, 'low'), (5000, 10000, 'high'), (2000, 6000, 'mid')) b(lo, hi, band) ON s_acctbal >= lo AND s_acctbal < hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(-1000, 0, "red"), (0, 5000, "low"), (5000, 10000, "high"), (2000, 6000, "mid")], "lo int, hi int, band string")
    return joins.range_join(table(spark, sf_dir, "supplier"), bands, "s_acctbal", "lo", "hi", 1000.0).select("s_suppkey", "band")


@query("SELECT c_custkey, unnest([1, 2, 3]) AS x, unnest(['a', 'b', NULL]) AS y FROM customer")
def join_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("xs"), F.array(F.lit("a"), F.lit("b")).alias("ys"))
    return joins.array_join(c, {"xs": "x", "ys": "y"}).select("c_custkey", "x", "y")


# --- grouping -----------------------------------------------------------------------------------------------------

both("group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
both("group_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("group_cube", "SELECT c_mktsegment, c_nationkey % 3 AS g, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey % 3)")
both("group_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
both("group_sets_nested", "SELECT p_brand, p_size % 4 AS s, count(*) AS n FROM part GROUP BY GROUPING SETS (ROLLUP (p_brand, p_size % 4), CUBE (p_brand))")
both("grouping_marks", "SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INTEGER) AS gs, CAST(GROUPING(o_orderpriority) AS INTEGER) AS gp, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("group_with_totals", "SELECT coalesce(o_orderpriority, 'TOTAL') AS p, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
both("group_empty_set", "SELECT count(*) AS n, round(sum(l_tax), 2) AS t, max(l_linenumber) AS m FROM lineitem WHERE l_orderkey < 0")
both("aggregate_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS x FROM lineitem GROUP BY l_returnflag")
both("aggregate_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_orderpriority")
two("aggregate_ordered_list", "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_name, n_nationkey))), x -> x.n_name), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
two("aggregate_string", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
two("aggregate_within_group", "SELECT c_mktsegment, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) AS med, percentile_disc(0.25) WITHIN GROUP (ORDER BY c_acctbal) AS q FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) AS med, percentile_disc(0.25) WITHIN GROUP (ORDER BY c_acctbal) AS q FROM customer GROUP BY c_mktsegment")
both("aggregate_spread", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag")
both("aggregate_bool", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every_, bool_or(o_totalprice > 400000) AS some_ FROM orders GROUP BY o_orderpriority")
two("aggregate_arg", "SELECT o_orderstatus, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_orderstatus")
two("aggregate_set", "SELECT c_nationkey, array_join(array_sort(collect_set(c_mktsegment)), ',') AS segs FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segs FROM customer GROUP BY c_nationkey")
both("aggregate_single_value", "SELECT s_nationkey, CASE WHEN count(*) = 1 THEN max(s_name) END AS only_one FROM supplier GROUP BY s_nationkey")
both("aggregate_weighted", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS w FROM lineitem GROUP BY l_returnflag")
both("aggregate_two_level", "SELECT p, CAST(sum(n) AS BIGINT) AS n, round(sum(t), 2) AS t FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2) x GROUP BY p")
two("aggregate_quantiles", "SELECT o_orderstatus, round(percentile(o_totalprice, 0.1), 4) AS a, round(percentile(o_totalprice, 0.9), 4) AS b FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.1), 4) AS a, round(quantile_cont(o_totalprice, 0.9), 4) AS b FROM orders GROUP BY o_orderstatus")
both("aggregate_top_k", "SELECT p_type, n FROM (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_type) t WHERE r <= 5")
two("aggregate_json", "SELECT r_regionkey, to_json(collect_list(r_name)) AS j FROM region GROUP BY r_regionkey", "SELECT r_regionkey, CAST(to_json(list(r_name)) AS VARCHAR) AS j FROM region GROUP BY r_regionkey")
two("aggregate_map", "SELECT k, CAST(sum(v) AS BIGINT) AS total FROM (SELECT explode(map('a', p_size, 'b', p_size * 2)) AS (k, v) FROM part) GROUP BY k", "SELECT k, CAST(sum(v) AS BIGINT) AS total FROM (SELECT unnest(['a', 'b']) AS k, unnest([p_size, p_size * 2]) AS v FROM part) GROUP BY k")
two("aggregate_for_each", "SELECT label, i, round(avg(x), 4) AS m FROM (SELECT label, posexplode(embedding) AS (i, x) FROM embeddings) WHERE i < 4 GROUP BY label, i", "SELECT label, i, round(avg(x), 4) AS m FROM (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings) WHERE i < 4 GROUP BY label, i")
two("aggregate_bitmap", "SELECT s_nationkey, CAST(count(DISTINCT s_suppkey % 64) AS BIGINT) AS c, bit_or(shiftleft(1L, CAST(s_suppkey % 60 AS INT))) AS m FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey, count(DISTINCT s_suppkey % 64) AS c, bit_or(CAST(1 AS BIGINT) << CAST(s_suppkey % 60 AS INTEGER)) AS m FROM supplier GROUP BY s_nationkey")
both("aggregate_decay", "SELECT user_id, round(sum(value * exp((event_id - 10000) / 5000.0)), 4) AS d FROM events GROUP BY user_id")
both("aggregate_count_if", "SELECT user_id, CAST(count_if(event_type = 'view') AS BIGINT) AS v, CAST(count_if(value > 50) AS BIGINT) AS big FROM events GROUP BY user_id")
two("aggregate_bit_xor", "SELECT o_orderstatus, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderstatus")
both("aggregate_regression", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 4) AS v, round(regr_slope(l_extendedprice, l_quantity), 4) AS s FROM lineitem GROUP BY l_returnflag")
two("aggregate_delta_sum", "SELECT user_id, round(sum(greatest(value - prev, 0)), 4) AS d FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY user_id", "SELECT user_id, round(sum(greatest(value - prev, 0)), 4) AS d FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY user_id")


# --- windows ------------------------------------------------------------------------------------------------------

both("window_ranks", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("window_distribution", "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 8) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 8) AS cd, CAST(ntile(3) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS nt FROM supplier")
both("window_lag_lead", "SELECT event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS prev, lead(value, 2, -1) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events")
both("window_values", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
both("window_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s FROM events")
both("window_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
both("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
both("window_aggregate", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
both("window_filter", "SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS f FROM orders")
two("window_ignore_nulls", "SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN event_id END AS v FROM events) t", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN event_id END AS v FROM events) t")
two("window_ordered_set", "SELECT c_custkey, c_acctbal - percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) OVER (PARTITION BY c_nationkey) AS d FROM customer", "SELECT c_custkey, c_acctbal - m AS d FROM customer JOIN (SELECT c_nationkey AS k, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) AS m FROM customer GROUP BY c_nationkey) t ON k = c_nationkey")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS s FROM events")
def window_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.groups_frame(table(spark, sf_dir, "events"), F.sum("value"), ["user_id"], [F.col("event_type")], 1, 0, "s")
    return out.select("event_id", F.round("s", 4).alias("s"))


@query("SELECT p_partkey, CAST(coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP), 0) AS BIGINT) AS s FROM part")
def window_exclude_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("_r", F.dense_rank().over(_brand().orderBy("p_type")))
    return rows.sum_excluding(part, "p_size", ["p_brand"], [F.col("_r")], "GROUP", "s").select("p_partkey", "s")


@query("SELECT p_partkey, CAST(coalesce(sum(p_size) OVER (PARTITION BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0) AS BIGINT) AS s FROM part")
def window_exclude_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sum_excluding(table(spark, sf_dir, "part").withColumn("_r", F.lit(1)), "p_size", ["p_brand"], [F.col("_r")], "CURRENT ROW", "s").select("p_partkey", "s")


def _brand():
    from pyspark.sql import Window

    return Window.partitionBy("p_brand")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rows.qualify(table(spark, sf_dir, "orders"), F.row_number().over(w), lambda r: r <= 2).select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# --- ordering and limits ------------------------------------------------------------------------------------------

both("order_nulls", "SELECT x FROM (SELECT nullif(p_size, 1) AS x, p_partkey FROM part) t ORDER BY x DESC NULLS LAST, p_partkey LIMIT 20")
both("order_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def limit_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.with_ties(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 10, ["p_size DESC"])


@query("SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER () AS c FROM supplier) WHERE r <= ceil(15 * c / 100.0)")
def limit_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.top_percent(table(spark, sf_dir, "supplier").select("s_acctbal", "s_suppkey"), 15, ["s_acctbal", "s_suppkey"]).select("s_suppkey")


@query("SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) BETWEEN 2 AND 4")
def limit_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.limit_by(table(spark, sf_dir, "customer"), 3, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], offset=1).select("c_custkey", "c_mktsegment")


@query("SELECT g.s AS p_size, coalesce(n, 0) AS n FROM generate_series(0, 59) AS g(s) LEFT JOIN (SELECT p_size, count(*) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY p_size) ON p_size = g.s".replace("g.s AS p_size", "CAST(g.s AS INTEGER) AS p_size"))
def order_with_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").filter("p_size % 3 <> 0").groupBy("p_size").agg(F.count("*").alias("n"))
    return rows.with_fill(counts, "p_size", F.lit(0), F.lit(59), F.lit(1)).select("p_size", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT CAST(g.s AS INTEGER) AS p_size, last_value(n IGNORE NULLS) OVER (ORDER BY g.s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM generate_series(1, 55) AS g(s) LEFT JOIN (SELECT p_size, count(*) AS n FROM part WHERE p_size % 3 = 1 GROUP BY p_size) ON p_size = g.s")
def order_fill_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").filter("p_size % 3 = 1").groupBy("p_size").agg(F.count("*").alias("n"))
    return rows.with_fill(counts, "p_size", F.lit(1), F.lit(55), F.lit(1), interpolate=["n"]).select("p_size", "n")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def final_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.final_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) AS b FROM orders) WHERE b >= 2147483648 AND b < 2576980377")
def sample_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample_ratio(table(spark, sf_dir, "orders"), ["o_orderkey"], 0.1, 0.5).select("o_orderkey")


@query(None)
def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").sample(0.05, seed=7).select("o_orderkey")


two("group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
both("clock_functions", "SELECT count(*) AS n, count(CASE WHEN o_orderdate < current_date THEN 1 END) AS past, current_date = CAST(current_timestamp AS DATE) AS same FROM orders")
both("session_functions", "SELECT length(current_user) > 0 AS named, count(*) AS n FROM region")
both("predicate_any_all_lists", "SELECT count(CASE WHEN p_size IN (1, 5, 9) THEN 1 END) AS in_list, count(CASE WHEN p_size <> 1 AND p_size <> 5 THEN 1 END) AS not_in FROM part")


@query("SELECT round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem")
def project_star_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.star_apply(table(spark, sf_dir, "lineitem"), "price|discount|tax", lambda c: F.round(F.sum(c), 2))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")
def format_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.formatted(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "JSONEachRow")


@query("SELECT n_nationkey || ',\"' || n_name || '\",' || coalesce(CAST(nullif(n_regionkey, 1) AS VARCHAR), '\\N') AS line FROM nation")
def format_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.formatted(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.expr("nullif(n_regionkey, 1)").alias("r")), "CSV")


@query("SELECT 'c_mktsegment' AS name, count(*) AS rows, count(*) - count(c_mktsegment) AS nulls, count(DISTINCT c_mktsegment) AS distinct_values, min(c_mktsegment) AS least, max(c_mktsegment) AS most FROM customer UNION ALL SELECT 'k', count(*), count(*) - count(k), count(DISTINCT k), CAST(min(k) AS VARCHAR), CAST(max(k) AS VARCHAR) FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer)")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.column_statistics(table(spark, sf_dir, "customer").select("c_mktsegment", F.expr("nullif(c_nationkey, 3)").alias("k")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def select_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.session import written

    return written(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice"), "into")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS n FROM part")
def window_exclude_ties_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("_r", F.dense_rank().over(_brand().orderBy("p_type")))
    return rows.count_excluding(part, ["p_brand"], [F.col("_r")], "TIES", "n").select("p_partkey", "n")


@query("SELECT p_partkey, round(avg(p_size) OVER (PARTITION BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 8) AS a FROM part")
def window_exclude_row_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = rows.avg_excluding(table(spark, sf_dir, "part").withColumn("_r", F.lit(1)), "p_size", ["p_brand"], [F.col("_r")], "CURRENT ROW", "a")
    return part.select("p_partkey", F.round("a", 8).alias("a"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey // 3 AS p FROM part WHERE p_partkey > 1), t AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth, [CAST(1 AS BIGINT)] AS path UNION ALL SELECT c, depth + 1, list_append(path, c) FROM t JOIN e ON p = node) SELECT node, depth, row_number() OVER (ORDER BY depth, path) AS breadth, row_number() OVER (ORDER BY path) AS deep FROM t")
def search_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = recursion.reverse(_hops(spark, sf_dir)).select(F.col("src").cast("long").alias("src"), "dst")
    tree = recursion.kept(recursion.tree_paths(down, spark.createDataFrame([(1,)], "src long")).select("node", "depth", "path"))
    return joins.numbered(joins.numbered(tree, ["depth", "path"], "breadth"), ["path"], "deep").select("node", "depth", "breadth", "deep")


# --- set operations -----------------------------------------------------------------------------------------------

both("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 9")
both("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("set_nested", "(SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region) UNION ALL (SELECT r_regionkey FROM region INTERSECT SELECT 3) ORDER BY k LIMIT 12")


# --- recursion ----------------------------------------------------------------------------------------------------

both("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 1), t AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT t.src, e.dst, depth + 1 FROM t JOIN e ON t.dst = e.src) SELECT src, dst, min(depth) AS depth FROM t GROUP BY src, dst")
def recursive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursion.closure(_hops(spark, sf_dir))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 1), t AS (SELECT src, dst, 1 AS hops FROM e WHERE src = 100 UNION SELECT t.src, e.dst, hops + 1 FROM t JOIN e ON t.dst = e.src) SELECT src, dst, min(hops) AS hops FROM t GROUP BY src, dst")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursion.shortest_paths(_hops(spark, sf_dir), spark.createDataFrame([(100,)], "src long"))


# --- table changes ------------------------------------------------------------------------------------------------


def _target_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The customers with a balance, and every customer number that orders or suppliers have: some are in both, some in one."""
    c = table(spark, sf_dir, "customer")
    target = c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("v"))
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"))).distinct()
    return target, known.select("k", (F.col("k") * 1.5).cast("double").alias("v"))


_TS = "WITH t AS (SELECT c_custkey AS k, round(c_acctbal, 2) AS v FROM customer WHERE c_acctbal >= 0), s AS (SELECT k, CAST(k * 1.5 AS DOUBLE) AS v FROM (SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey * 3 FROM supplier)) "


@query(_TS + "SELECT k, v FROM t UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM t)")
def insert_on_conflict_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert_ignore(*_target_source(spark, sf_dir), ["k"])


@query(_TS + "SELECT coalesce(s.k, t.k) AS k, coalesce(s.v, t.v) AS v FROM t FULL JOIN s ON t.k = s.k")
def insert_on_conflict_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.upsert(*_target_source(spark, sf_dir), ["k"])


@query(_TS + "SELECT t.k, CASE WHEN s.k IS NOT NULL THEN t.v + s.v ELSE t.v END AS v FROM t LEFT JOIN s ON t.k = s.k")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update_from(*_target_source(spark, sf_dir), ["k"], {"v": F.col("t.v") + F.col("s.v")})


@query(_TS + "SELECT k, v FROM t WHERE k NOT IN (SELECT k FROM s)")
def delete_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete_using(*_target_source(spark, sf_dir), ["k"])



def _merge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t, s = _target_source(spark, sf_dir)
    return dml.merge(t, s, ["k"], matched={"v": F.col("s.v")}, matched_delete=F.col("s.k") % 2 == 0, not_matched={"k": F.col("s.k"), "v": F.col("s.v")}, by_source_delete=F.col("t.k") % 7 == 0)


@query(_TS + "SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.v ELSE t.v END AS v FROM t FULL JOIN s ON t.k = s.k WHERE NOT (t.k IS NOT NULL AND s.k IS NOT NULL AND s.k % 2 = 0) AND NOT (s.k IS NULL AND t.k % 7 = 0)")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir)[0]


@query(_TS + "SELECT CASE WHEN t.k IS NULL THEN 'INSERT' WHEN s.k IS NULL THEN 'DELETE' WHEN s.k % 2 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS action, count(*) AS n FROM t FULL JOIN s ON t.k = s.k WHERE t.k IS NULL OR s.k IS NOT NULL OR t.k % 7 = 0 GROUP BY 1")
def merge_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir)[1].groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2")
def optimize_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))


@query(_TS + "SELECT k, v FROM t WHERE k % 10 NOT IN (SELECT k % 10 FROM s WHERE k % 10 < 3) UNION ALL SELECT k, v FROM s WHERE k % 10 < 3")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = (x.withColumn("p", F.col("k") % 10) for x in _target_source(spark, sf_dir))
    return dml.replace_partitions(t, s.filter("p < 3"), ["p"]).drop("p")
