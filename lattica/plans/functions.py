"""Queries of the scalar functions by family, event sequences, user functions, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import aggregates, events
from lattica.session import Query, sql, table
from lattica.sources import files
from lattica.streaming import streams

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


# --- scalar functions ---------------------------------------------------------------------------------------------

both("string_case_pad", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp, reverse(c_name) AS r, repeat('ab', 3) AS rep FROM customer".replace("length(c_name) AS n", "CAST(length(c_name) AS BIGINT) AS n"))
both("string_trim_cut", "SELECT p_partkey, trim('  x ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, left(p_name, 3) AS a, right(p_name, 3) AS b, substring(p_name, 2, 4) AS s FROM part")
two("string_find", "SELECT p_partkey, CAST(position('a' IN p_name) AS BIGINT) AS p, startswith(p_name, 'P') AS sw, contains(p_name, '1') AS c, split_part(p_brand, '#', 2) AS sp FROM part", "SELECT p_partkey, position('a' IN p_name) AS p, starts_with(p_name, 'P') AS sw, contains(p_name, '1') AS c, split_part(p_brand, '#', 2) AS sp FROM part")
both("string_replace", "SELECT p_partkey, replace(p_type, 'A', '_') AS r, translate(p_brand, 'Bd#', 'xy') AS t, concat(p_name, '/', p_brand) AS c, concat_ws('-', p_name, p_brand) AS w FROM part")
two("string_overlay", "SELECT p_partkey, overlay(p_brand PLACING 'XX' FROM 2 FOR 3) AS o FROM part", "SELECT p_partkey, left(p_brand, 1) || 'XX' || substring(p_brand, 5) AS o FROM part")
two("string_regex", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', '9') AS a, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS b, p_brand RLIKE '^Brand' AS m, CAST(regexp_count(p_name, 'a') AS BIGINT) AS c FROM part", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', '9', 'g') AS a, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS b, regexp_matches(p_brand, '^Brand') AS m, len(regexp_extract_all(p_name, 'a')) AS c FROM part")
two("string_codes", "SELECT r_regionkey, ascii(r_name) AS a, chr(65 + r_regionkey) AS c, lower(hex(r_name)) AS h, base64(CAST(r_name AS BINARY)) AS b, md5(r_name) AS m, sha2(r_name, 256) AS s FROM region", "SELECT r_regionkey, ascii(r_name) AS a, chr(65 + r_regionkey) AS c, lower(hex(r_name)) AS h, to_base64(CAST(r_name AS BLOB)) AS b, md5(r_name) AS m, sha256(r_name) AS s FROM region")
both("string_concat_null", "SELECT p_partkey, p_name || nullif(p_brand, 'Brand#11') AS c FROM part")
two("string_distance", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS d FROM part", "SELECT p_partkey, levenshtein(p_name, p_type) AS d FROM part")
both("math_basic", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(sign(s_acctbal) AS INTEGER) AS s, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 8) AS q, round(exp(s_suppkey % 5), 6) AS e, round(ln(s_suppkey + 1), 8) AS l, round(power(s_suppkey, 2), 2) AS p, s_suppkey % 7 AS m FROM supplier")
two("math_integer_division", "SELECT o_orderkey, o_orderkey div 7 AS d, o_orderkey / 7 AS x, pmod(-o_orderkey, 7) AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey / 7 AS x, ((-o_orderkey % 7) + 7) % 7 AS m FROM orders")
both("math_trigonometry", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(tan(n_nationkey), 7) AS t, round(atan2(n_nationkey, 2), 9) AS a, round(degrees(1.5), 7) AS d, round(radians(n_nationkey), 9) AS r FROM nation")
two("bit_operations", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey ^ 5 AS x, bit_count(o_orderkey) AS c, shiftleft(o_orderkey, 2) AS l, shiftright(o_orderkey, 1) AS r FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, CAST(bit_count(o_orderkey) AS INTEGER) AS c, o_orderkey << 2 AS l, o_orderkey >> 1 AS r FROM orders")
two("date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, CAST(extract(WEEK FROM o_orderdate) AS INT) AS w FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS dy, CAST(week(o_orderdate) AS INTEGER) AS w FROM orders")
two("date_arithmetic", "SELECT o_orderkey, CAST(date_add(CAST(o_orderdate AS DATE), 10) AS STRING) AS a, CAST(add_months(CAST(o_orderdate AS DATE), 1) AS STRING) AS b, datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS d, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS t, CAST(last_day(CAST(o_orderdate AS DATE)) AS STRING) AS l FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS a, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS b, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS d, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS t, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS l FROM orders")
two("date_format_parse", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd') AS f, CAST(to_date(date_format(o_orderdate, 'ddMMyyyy'), 'ddMMyyyy') AS STRING) AS p, CAST(make_date(1999, 1 + CAST(o_orderkey % 12 AS INT), 3) AS STRING) AS m FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS f, CAST(CAST(strptime(strftime(o_orderdate, '%d%m%Y'), '%d%m%Y') AS DATE) AS VARCHAR) AS p, CAST(make_date(1999, 1 + o_orderkey % 12, 3) AS VARCHAR) AS m FROM orders")
two("date_time_zone", "SELECT event_id, date_format(from_utc_timestamp(ts, 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm:ss') AS t FROM events", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS t FROM events")
two("time_buckets", "SELECT date_format(window.start, 'yyyy-MM-dd HH:mm') AS s, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY window(ts, '6 hours')", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS s, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1")
two("time_sessions", "SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '2 hours')) GROUP BY user_id", "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s) GROUP BY user_id")
_A = "SELECT vec_id, embedding AS a FROM embeddings"
_D = "SELECT vec_id, embedding AS a FROM embeddings"
two("array_access", f"SELECT vec_id, element_at(a, 2) AS second, element_at(a, -1) AS last_, size(a) AS n, CAST(array_position(a, element_at(a, 3)) AS INT) AS p FROM ({_A})", f"SELECT vec_id, a[2] AS second, a[-1] AS last_, CAST(len(a) AS INTEGER) AS n, CAST(list_position(a, a[3]) AS INTEGER) AS p FROM ({_D})")
two("array_higher_order", f"SELECT vec_id, aggregate(transform(a, x -> CAST(x * 2 AS DOUBLE)), 0D, (s, x) -> s + x) AS s, size(filter(a, x -> x > 0)) AS pos, exists(a, x -> x > 1.5) AS e, forall(a, x -> x < 9) AS f FROM ({_A})", f"SELECT vec_id, list_sum(list_transform(a, lambda x: CAST(x * 2 AS DOUBLE))) AS s, CAST(len(list_filter(a, lambda x: x > 0)) AS INTEGER) AS pos, len(list_filter(a, lambda x: x > 1.5)) > 0 AS e, len(list_filter(a, lambda x: x < 9)) = len(a) AS f FROM ({_D})")
two("array_order_set", f"SELECT vec_id, element_at(array_sort(a), 1) AS lo, array_max(a) AS hi, element_at(reverse(a), 1) AS r, size(array_distinct(transform(a, x -> CAST(floor(x) AS INT)))) AS d, size(array_intersect(transform(a, x -> CAST(floor(x) AS INT)), array(0, 1))) AS i FROM ({_A})", f"SELECT vec_id, list_sort(a)[1] AS lo, list_max(a) AS hi, list_reverse(a)[1] AS r, CAST(len(list_distinct(list_transform(a, lambda x: CAST(floor(x) AS INTEGER)))) AS INTEGER) AS d, CAST(len(list_intersect(list_transform(a, lambda x: CAST(floor(x) AS INTEGER)), [0, 1])) AS INTEGER) AS i FROM ({_D})")
two("array_flatten_zip", "SELECT n_regionkey, size(flatten(collect_list(array(n_nationkey, n_nationkey + 1)))) AS n, aggregate(flatten(collect_list(array(n_nationkey, 1))), 0, (s, x) -> s + x) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(len(flatten(list([n_nationkey, n_nationkey + 1]))) AS INTEGER) AS n, CAST(list_sum(flatten(list([n_nationkey, 1]))) AS INTEGER) AS s FROM nation GROUP BY n_regionkey")
two("array_distances", "SELECT a.vec_id AS x, b.vec_id AS y, round(aggregate(zip_with(a.embedding, b.embedding, (p, q) -> CAST(p AS DOUBLE) * q), 0D, (s, v) -> s + v), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id AS x, b.vec_id AS y, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
two("array_running", "SELECT vec_id, i, round(sum(x) OVER (PARTITION BY vec_id ORDER BY i), 5) AS cum, round(x - lag(x) OVER (PARTITION BY vec_id ORDER BY i), 6) AS dif FROM (SELECT vec_id, posexplode(embedding) AS (i, x) FROM embeddings)", "SELECT vec_id, i, round(sum(x) OVER (PARTITION BY vec_id ORDER BY i), 5) AS cum, round(x - lag(x) OVER (PARTITION BY vec_id ORDER BY i), 6) AS dif FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings)")
two("map_functions", "SELECT n_nationkey, m['a'] AS a, size(map_keys(m)) AS n, map_contains_key(m, 'z') AS z, element_at(transform_values(m, (k, v) -> v * 2), 'b') AS b FROM (SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey) AS m FROM nation)", "SELECT n_nationkey, n_nationkey AS a, 2 AS n, false AS z, n_regionkey * 2 AS b FROM nation")
two("tuple_functions", "SELECT t.a AS a, t.b AS b FROM (SELECT struct(n_nationkey AS a, n_name AS b) AS t FROM nation)", "SELECT t.a AS a, t.b AS b FROM (SELECT {'a': n_nationkey, 'b': n_name} AS t FROM nation)")
two("json_functions", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, get_json_object(props, '$.none') IS NULL AS none, json_array_length(concat('[', props, ',1]')) AS n FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.none') IS NULL AS none, CAST(json_array_length('[' || props || ',1]') AS INTEGER) AS n FROM events")
two("json_build", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS j FROM nation", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS j FROM nation")
two("json_table", "SELECT event_id, pos + 1 AS ord, v FROM (SELECT event_id, posexplode(from_json(concat('[', get_json_object(props, '$.k'), ',7]'), 'array<int>')) AS (pos, v) FROM events)", "SELECT event_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS ord, unnest(a) AS v FROM (SELECT event_id, [CAST(json_extract(props, '$.k') AS INTEGER), 7] AS a FROM events)")
two("range_functions", "SELECT count(*) AS n, count_if(greatest(a.lo, b.lo) < least(a.hi, b.hi)) AS over FROM (SELECT p_size AS lo, p_size + 5 AS hi, p_brand FROM part) a JOIN (SELECT s_nationkey AS lo, s_nationkey + 2 AS hi FROM supplier) b ON a.lo % 25 = b.lo", "SELECT count(*) AS n, CAST(count_if(greatest(a.lo, b.lo) < least(a.hi, b.hi)) AS BIGINT) AS over FROM (SELECT p_size AS lo, p_size + 5 AS hi, p_brand FROM part) a JOIN (SELECT s_nationkey AS lo, s_nationkey + 2 AS hi FROM supplier) b ON a.lo % 25 = b.lo")
two("url_functions", "SELECT page_id, parse_url(url, 'HOST') AS h, parse_url(url, 'PROTOCOL') AS p, parse_url(url, 'QUERY') AS q FROM pages", "SELECT page_id, regexp_extract(url, '://([^/?#:]*)', 1) AS h, regexp_extract(url, '^([a-z]+):', 1) AS p, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS q FROM pages")
two("xml_functions", "SELECT r_regionkey, xpath_string(concat('<a><b>', r_name, '</b></a>'), 'a/b') AS b, CAST(xpath_int(concat('<a><b>', r_regionkey, '</b><b>', length(r_name), '</b></a>'), 'sum(a/b)') AS BIGINT) AS s FROM region", "SELECT r_regionkey, r_name AS b, CAST(r_regionkey + length(r_name) AS BIGINT) AS s FROM region")
two("ip_functions", "SELECT n_nationkey, (10L << 24) + n_nationkey * 256 + 7 AS num, concat_ws('.', 10, n_nationkey div 256, n_nationkey % 256, 7) AS ip FROM nation", "SELECT n_nationkey, (10::BIGINT << 24) + n_nationkey * 256 + 7 AS num, concat_ws('.', 10, n_nationkey // 256, n_nationkey % 256, 7) AS ip FROM nation")
two("conversion_functions", "SELECT p_partkey, try_cast(p_brand AS INT) AS bad, CAST('12' AS INT) AS i, CAST(p_retailprice AS DECIMAL(18,2)) > 900 AS d, coalesce(try_cast('x' AS INT), 0) AS z, CAST(p_size AS STRING) AS s FROM part", "SELECT p_partkey, try_cast(p_brand AS INTEGER) AS bad, CAST('12' AS INTEGER) AS i, CAST(p_retailprice AS DECIMAL(18,2)) > 900 AS d, coalesce(try_cast('x' AS INTEGER), 0) AS z, CAST(p_size AS VARCHAR) AS s FROM part")
both("dictionary_lookup", "SELECT s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey + 1")
two("display_functions", "SELECT n_nationkey, format_number(n_nationkey * 1234.5, 2) AS f, repeat('#', n_regionkey) AS bar FROM nation", "SELECT n_nationkey, format('{:,.2f}', n_nationkey * 1234.5) AS f, repeat('#', n_regionkey) AS bar FROM nation")


# --- event sequences and aggregates -------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, ts, event_type FROM events), v AS (SELECT user_id, ts FROM s WHERE event_type = 'view'),
 c AS (SELECT v.user_id, v.ts, min(c.ts) AS t2 FROM v LEFT JOIN s c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts > v.ts AND c.ts <= v.ts + INTERVAL 1 DAY GROUP BY 1, 2),
 p AS (SELECT c.user_id, c.t2, count(p.ts) AS k FROM c LEFT JOIN s p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts > c.t2 AND p.ts <= c.ts + INTERVAL 1 DAY GROUP BY c.user_id, c.ts, c.t2)
 SELECT u.user_id, CAST(coalesce(max(CASE WHEN p.k > 0 THEN 3 WHEN p.t2 IS NOT NULL THEN 2 WHEN p.user_id IS NOT NULL THEN 1 ELSE 0 END), 0) AS INTEGER) AS level FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p ON p.user_id = u.user_id GROUP BY u.user_id""")
def event_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.window_funnel(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"], 86_400)


_LETTERS = {"view": "v", "click": "c", "purchase": "p"}


@query("SELECT user_id, regexp_matches(s, 'v[^p]*p') AS matched, CAST(len(regexp_extract_all(s, 'v[^p]*p')) AS INTEGER) AS times FROM (SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' ELSE '.' END, '' ORDER BY ts) AS s FROM events GROUP BY user_id)")
def event_sequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sequence_match(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", _LETTERS, "v[^p]*p")


@query("SELECT user_id, arg_min(n, ts) AS next FROM (SELECT user_id, ts, event_type, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts), 'end') AS n FROM events) WHERE event_type = 'view' GROUP BY user_id")
def event_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.next_event(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "view").withColumn("next", F.coalesce("next", F.lit("end")))


@query("""WITH t AS (SELECT event_id, user_id, ts, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS s FROM events)
 SELECT event_id, round(sum(value * pow(2, s / 2592000)) OVER w / sum(pow(2, s / 2592000)) OVER w, 5) AS ema FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING)""")
def event_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.moving_average(table(spark, sf_dir, "events"), "user_id", "ts", "value", 2_592_000).select("event_id", F.round("ema", 5).alias("ema"))


@query(None)
def event_sampled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sampled_lists(table(spark, sf_dir, "events"), "user_id", "event_id", 3)


@query(None)
def event_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.downsampled(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 20)


@query("WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS k FROM lineitem WHERE l_returnflag IN ('A', 'R')) SELECT a.s - a.n * (a.n + 1) / 2.0 AS u1, a.n * b.n - (a.s - a.n * (a.n + 1) / 2.0) AS u2 FROM (SELECT sum(k) AS s, count(*) AS n FROM r WHERE g = 'A') a, (SELECT count(*) AS n FROM r WHERE g = 'R') b")
def aggregate_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mann_whitney(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R")


@query("WITH p AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, count(*) AS k FROM p) SELECT round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) AS f FROM t")
def aggregate_variance_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.analysis_of_variance(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select(F.round("f", 6).alias("f"))


@query("WITH l AS (SELECT event_type, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y FROM events), p AS (SELECT event_type, count_if(y = 1) AS p, count_if(y = 0) AS n FROM l GROUP BY 1), t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM p) SELECT event_type, round((p / tp - n / tn) * ln((p / tp) / (n / tn)), 9) AS iv FROM p, t")
def aggregate_information_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("y", F.when(F.col("value") > 50, 1).otherwise(0))
    return aggregates.information_value(e, "event_type", "y").withColumn("iv", F.round("iv", 9))


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS g FROM lineitem GROUP BY l_returnflag")
def udaf_geometric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(aggregates.geometric_mean("l_extendedprice"), 4).alias("g"))


@query("SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS result FROM nation GROUP BY n_regionkey")
def udaf_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.folded(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], "n_nationkey", F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") * x)


@query("SELECT p_partkey, round(p_retailprice * 1.2, 2) AS gross, p_size + 1 AS s FROM part")
def udf_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gross(x DOUBLE, rate DOUBLE DEFAULT 1.2) RETURNS DOUBLE RETURN round(x * rate, 2)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION plus_one(x INT) RETURNS INT RETURN x + 1")
    return spark.sql("SELECT p_partkey, gross(p_retailprice) AS gross, plus_one(p_size) AS s FROM part")


@query("SELECT n_nationkey AS k, i AS i, n_nationkey * i AS v FROM nation, (VALUES (1), (2), (3)) t(i)")
def udtf_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION times(k INT) RETURNS TABLE (i INT, v INT) RETURN SELECT i, k * i FROM (VALUES (1), (2), (3)) t(i)")
    return spark.sql("SELECT n_nationkey AS k, i, v FROM nation, LATERAL times(n_nationkey)")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey < 10")
def row_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_nationkey < 10").select("s_suppkey")


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def copy_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{files.shared(spark)}/nation.csv"
    files.copy_to(table(spark, sf_dir, "nation"), path, header=True, quote="'")
    return files.copy_from(spark, path, "n_nationkey int, n_name string, n_regionkey int", header=True, quote="'", where="n_regionkey = 2").select("n_nationkey", "n_name")


@query("SELECT 1 AS good, 2 AS bad")
def copy_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{files.shared(spark)}/bad.txt"
    spark.createDataFrame([("1,a",), ("x,b",), ("y,c",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    good, bad = files.external_table(spark, path, "a int, b string")
    return good.agg(F.count("*").cast("int").alias("good")).join(bad.agg(F.count("*").cast("int").alias("bad")))


@query("SELECT CAST(3 AS BIGINT) AS statements, CAST(2 AS BIGINT) AS tables")
def dump_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{files.shared(spark)}/dump"
    text = "CREATE TABLE a (x int, y text); -- one; two\nCREATE TABLE b (z text DEFAULT ';');\nCREATE VIEW v AS SELECT 1;"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    parsed = files.read_dump(spark, path)
    return parsed.agg(F.count("*").alias("statements"), F.count_if(F.col("obj_type") == "TABLE").alias("tables"))


@query("SELECT CAST(n_regionkey AS INTEGER) AS r, count(*) AS n FROM nation GROUP BY 1")
def partitioned_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{files.shared(spark)}/by-region"
    files.export(table(spark, sf_dir, "nation"), path, ["n_regionkey"])
    return spark.read.parquet(path).groupBy(F.col("n_regionkey").cast("int").alias("r")).agg(F.count("*").alias("n"))


# --- streams ------------------------------------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling_counts(spark, f"{sf_dir}/events.parquet", files.shared(spark))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY user_id")
def stream_materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.materialized_view(spark, f"{sf_dir}/events.parquet", files.shared(spark))
    return out.select("user_id", "n", F.round("v", 4).alias("v"))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.deduplicated(spark, f"{sf_dir}/events.parquet", files.shared(spark)).agg(F.count("*").alias("n"))


# --- more forms ---------------------------------------------------------------------------------------------------

two("for_json_output", "SELECT c_nationkey, to_json(array_sort(collect_list(named_struct('k', c_custkey)))) AS j FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, CAST(to_json(list({'k': c_custkey} ORDER BY c_custkey)) AS VARCHAR) AS j FROM customer GROUP BY c_nationkey")
both("extract_fields", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(extract(MONTH FROM o_orderdate) AS INTEGER) AS m FROM orders")
two("interval_literals", "SELECT CAST(CAST(DATE '1999-12-31' + INTERVAL '2' MONTH AS DATE) AS STRING) AS a, CAST(DATE '2000-03-01' - INTERVAL '1' DAY AS STRING) AS b", "SELECT CAST(CAST(DATE '1999-12-31' + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS a, CAST(CAST(DATE '2000-03-01' - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS b")
two("array_constructors", "SELECT r_regionkey, concat(array(1, 2), array(r_regionkey)) AS a, array_repeat(r_regionkey, 2) AS b, array_append(array(1), r_regionkey) AS c FROM region", "SELECT r_regionkey, list_concat([1, 2], [r_regionkey]) AS a, [r_regionkey, r_regionkey] AS b, list_append([1], r_regionkey) AS c FROM region")
two("array_subquery", "SELECT r_regionkey, (SELECT array_join(array_sort(collect_list(n_name)), ',') FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region", "SELECT r_regionkey, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region")
two("identity_values", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS id FROM nation", "SELECT n_name, row_number() OVER (ORDER BY n_name) AS id FROM nation")
two("sum_of_states", "SELECT round(sum(s), 2) AS total, CAST(sum(c) AS BIGINT) AS n, max(m) AS hi FROM (SELECT o_custkey % 10 AS b, sum(o_totalprice) AS s, count(*) AS c, max(o_totalprice) AS m FROM orders GROUP BY 1)", "SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n, max(o_totalprice) AS hi FROM orders")
both("aggregate_or_null", "SELECT n_nationkey, CASE WHEN count(s_suppkey) > 0 THEN sum(s_acctbal) END AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_nationkey")
both("aggregate_checksum", "SELECT o_orderpriority, bit_xor(o_orderkey * 31 + o_custkey) AS c FROM orders GROUP BY o_orderpriority")
two("aggregate_mode", "SELECT c_nationkey, min(c_mktsegment) AS m FROM (SELECT c_nationkey, c_mktsegment, rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1, 2) WHERE r = 1 GROUP BY c_nationkey", "SELECT c_nationkey, min(c_mktsegment) AS m FROM (SELECT c_nationkey, c_mktsegment, rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1, 2) WHERE r = 1 GROUP BY c_nationkey")
both("group_by_expression_alias", "SELECT p_size % 5 AS b, count(*) AS n FROM part GROUP BY p_size % 5")
both("window_lead_in_frame", "SELECT event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS nxt FROM events")
both("window_named_inherited", "SELECT o_orderkey, count(*) OVER w AS n, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey)")
two("view_of_query", "SELECT * FROM (SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey) v WHERE region LIKE 'A%'", "WITH v AS (SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT * FROM v WHERE region LIKE 'A%'")
both("order_using_operator", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
two("hierarchy_lookup", "SELECT n_nationkey, array_join(array(n_name, r_name, 'world'), '/') AS path FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT n_nationkey, n_name || '/' || r_name || '/world' AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
two("geo_distance", "SELECT s_suppkey, round(2 * 6371 * asin(sqrt(power(sin(radians(s_nationkey - 10) / 2), 2) + cos(radians(10)) * cos(radians(s_nationkey)) * power(sin(radians(s_suppkey % 90) / 2), 2))), 4) AS km FROM supplier", "SELECT s_suppkey, round(2 * 6371 * asin(sqrt(power(sin(radians(s_nationkey - 10) / 2), 2) + cos(radians(10)) * cos(radians(s_nationkey)) * power(sin(radians(s_suppkey % 90) / 2), 2))), 4) AS km FROM supplier")
two("conditional_functions", "SELECT p_partkey, if(p_size > 25, 'big', 'small') AS a, nvl2(nullif(p_size, 1), 1, 0) AS b, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS c, coalesce(element_at(map(1, 'one', 2, 'two'), p_size), 'many') AS t FROM part", "SELECT p_partkey, if(p_size > 25, 'big', 'small') AS a, if(nullif(p_size, 1) IS NOT NULL, 1, 0) AS b, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS c, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS t FROM part")
two("split_and_tokens", "SELECT doc_id, size(split(text, ' ')) AS n, element_at(split(text, ' '), 1) AS first FROM documents", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n, string_split(text, ' ')[1] AS first FROM documents")
both("text_lengths", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c, max(n_chars) AS m FROM documents GROUP BY lang")


@query("SELECT count(DISTINCT o_custkey) AS exact_, true AS close FROM orders")
def aggregate_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    sketch = o.agg(F.hll_sketch_estimate(F.hll_sketch_agg("o_custkey")).alias("h"), F.approx_count_distinct("o_custkey").alias("a"), F.count_distinct("o_custkey").alias("exact_"))
    return sketch.select("exact_", ((F.abs(F.col("h") - F.col("exact_")) < 0.1 * F.col("exact_")) & (F.abs(F.col("a") - F.col("exact_")) < 0.2 * F.col("exact_"))).alias("close"))


@query("SELECT true AS pushed")
def explain_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN: the filter and the two columns reach the scan."""
    plan = table(spark, sf_dir, "orders").filter("o_orderkey > 100").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    return spark.createDataFrame([("PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,100)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan,)], "pushed boolean")


@query("SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
def stream_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live view: complete mode into a memory table, read when the stream has caught up."""
    stream = spark.readStream.schema(table(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    name = "live_order_counts"
    q = stream.groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 5 DAY FROM events)")
def time_to_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("_m"))
    return e.join(F.broadcast(last)).filter(F.col("ts") >= F.col("_m") - F.expr("INTERVAL 5 DAY")).agg(F.count("*").alias("n"))
