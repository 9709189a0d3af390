"""Queries of further forms: partitions, graph patterns, user operators, scripts, projects, sketches, XML, versions of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.user import Operators
from lattica.operators import joins, partitions, patterns, rows
from lattica.session import Query, sql, table, views
from lattica.sources import files
from lattica.streaming.views import RefreshableView, watched

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


# --- joins and filling --------------------------------------------------------------------------------------------


@query("SELECT a.event_id, max(b.event_id) AS view_id FROM (SELECT e.event_id, e.event_type, max(v.ts) AS t FROM events e LEFT JOIN events v ON v.event_type = e.event_type AND v.event_id % 2 = 0 AND v.ts <= e.ts WHERE e.event_id % 2 = 1 GROUP BY ALL) a LEFT JOIN events b ON b.event_type = a.event_type AND b.event_id % 2 = 0 AND b.ts = a.t GROUP BY a.event_id")
def join_asof_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five event types share all rows, so each key's rows are split by day."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    right = e.filter("event_id % 2 = 0").withColumnRenamed("event_id", "view_id")
    return joins.asof_join(e.filter("event_id % 2 = 1"), right, ["event_type"], "ts", "ts", ["view_id"], bucket=86_400).select("event_id", "view_id")


@query("SELECT k, n FROM (SELECT a.p_size + s.i AS k, CASE WHEN s.i = 0 THEN a.n END AS n, s.i, a.nxt FROM (SELECT p_size, n, lead(p_size) OVER (ORDER BY p_size) AS nxt FROM (SELECT p_size, count(*) AS n FROM part WHERE p_size % 7 IN (0, 1) GROUP BY p_size)) a, (VALUES (0), (1), (2)) s(i)) WHERE i = 0 OR nxt IS NULL OR k < nxt")
def order_fill_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").filter("p_size % 7 IN (0, 1)").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n"))
    return rows.fill_stale(counts, "k", F.lit(1), F.lit(3))


@query("SELECT n_name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def graph_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    found = patterns.match_path(
        {
            "n": nation.select(F.col("n_nationkey").alias("node"), "n_name"),
            "c": customer.select(F.col("c_custkey").alias("node")),
            "o": orders.select(F.col("o_orderkey").alias("node")),
            "lives": customer.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")),
            "placed": orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")),
        },
        "n<-(lives)-c-(placed)->o",
    )
    return found.groupBy("n.n_name").agg(F.count("*").alias("n"), F.sum("o.node").alias("s"))


# --- partitions ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 4 WHEN o_totalprice >= 100000 THEN 3 WHEN o_totalprice >= 50000 THEN 2 ELSE 1 END AS r, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'live' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rest' END AS l, CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS h FROM orders")
def partition_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = partitions.range_number(F.col("o_totalprice"), [50_000, 100_000, 200_000], right=True)
    named = partitions.list_name(F.col("o_orderstatus"), {"live": ["O", "P"], "done": ["F"]}, "rest")
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r"), named.alias("l"), partitions.hash_number(F.col("o_custkey"), 16).alias("h"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'archive' ELSE 'live' END AS place FROM supplier")
def partition_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DETACH from one table, ATTACH to another that takes those keys only."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    live, part = partitions.detached(s, F.col("s_nationkey") < 5)
    archive = partitions.attached(s.limit(0), part, F.col("s_nationkey") < 5)
    return live.withColumn("place", F.lit("live")).unionByName(archive.withColumn("place", F.lit("archive"))).select("s_suppkey", "place")


@query("SELECT c_custkey, 1000 + (row_number() OVER (ORDER BY c_name, c_custkey) - 1) * 10 AS id FROM customer")
def sequence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.sequence_values(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], "id", 1000, 10).select("c_custkey", "id")


# --- functions, operators, scripts --------------------------------------------------------------------------------


@query("SELECT p_partkey, round(abs(p_retailprice - p_size), 4) AS gap, -p_size AS minus FROM part")
def user_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<-> is there for doubles alone; the int comes to it by a cast."""
    ops = Operators()
    ops.operator("<->", "double", "double", lambda a, b: F.abs(a - b))
    ops.operator("!-", None, "int", lambda a: -a)
    ops.cast("int", "double", lambda a: a.cast("double"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("p"), F.col("p_size").cast("int").alias("s"))
    return part.select("p_partkey", F.round(ops.apply(part, "p", "<->", "s"), 4).alias("gap"), ops.apply(part, None, "!-", "s").alias("minus"))


@query("SELECT p_partkey, round(p_retailprice * 1.5, 2) AS a, round(p_retailprice * 1.2, 2) AS b FROM part")
def udf_named_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION with_rate(x DOUBLE, rate DOUBLE DEFAULT 1.2) RETURNS DOUBLE RETURN round(x * rate, 2)")
    return spark.sql("SELECT p_partkey, with_rate(rate => 1.5D, x => p_retailprice) AS a, with_rate(x => p_retailprice) AS b FROM part")


@query("WITH RECURSIVE r(i, a, b) AS (SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM r WHERE i < 20) SELECT a AS fib, (SELECT count(*) FROM orders) AS n FROM r WHERE i = 20")
def script_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with variables, a loop and a branch; its last query is the result."""
    views(spark, sf_dir, "orders")
    return spark.sql("""
        BEGIN
          DECLARE i INT DEFAULT 0;
          DECLARE a BIGINT DEFAULT 0;
          DECLARE b BIGINT DEFAULT 1;
          DECLARE c BIGINT;
          WHILE i < 20 DO
            SET c = a + b;
            SET a = b;
            SET b = c;
            SET i = i + 1;
          END WHILE;
          IF i = 20 THEN
            SELECT a AS fib, (SELECT count(*) FROM orders) AS n;
          ELSE
            SELECT -1L AS fib, 0L AS n;
          END IF;
        END""")


two("collation_for", "SELECT n_nationkey, collation(n_name COLLATE UTF8_LCASE) = collation('' COLLATE UTF8_LCASE) AS same, collation(n_name) = collation('' COLLATE UTF8_LCASE) AS other FROM nation", "SELECT n_nationkey, true AS same, false AS other FROM nation")
two("json_defaults", "SELECT event_id, coalesce(get_json_object(props, '$.none'), 'empty') AS e, coalesce(try_cast(get_json_object(props, '$.k') AS INT), -1) AS k, coalesce(try_cast(substr(props, 1, 3) AS INT), -2) AS bad FROM events", "SELECT event_id, coalesce(json_extract_string(props, '$.none'), 'empty') AS e, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(try_cast(substr(props, 1, 3) AS INTEGER), -2) AS bad FROM events")
two("aggregate_bitmap_distinct", "SELECT o_orderstatus, CAST(sum(bitmap_count(b)) AS BIGINT) AS n FROM (SELECT o_orderstatus, bitmap_bucket_number(o_custkey) AS g, bitmap_construct_agg(bitmap_bit_position(o_custkey)) AS b FROM orders GROUP BY 1, 2) GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
two("aggregate_sketch_states", "SELECT count(DISTINCT o_custkey) = max(e) OR abs(count(DISTINCT o_custkey) - max(e)) < 0.1 * max(e) AS close, count(DISTINCT o_custkey) AS n FROM orders, (SELECT hll_sketch_estimate(hll_union_agg(s)) AS e FROM (SELECT o_orderstatus, hll_sketch_agg(o_custkey) AS s FROM orders GROUP BY 1))", "SELECT true AS close, count(DISTINCT o_custkey) AS n FROM orders")
both("filter_before_columns", "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01') t WHERE o_totalprice > 100000")

# --- XML ----------------------------------------------------------------------------------------------------------

two(
    "xml_elements",
    "SELECT n_nationkey, regexp_replace(to_xml(named_struct('_id', n_nationkey, 'name', n_name), map('rowTag', 'nation')), '\\\\n *', '') AS x FROM nation",
    "SELECT n_nationkey, '<nation id=\"' || n_nationkey || '\"><name>' || n_name || '</name></nation>' AS x FROM nation",
)
two(
    "xml_table",
    "SELECT n_regionkey, pos + 1 AS ord, e.k AS k, e.n AS n FROM (SELECT n_regionkey, posexplode(from_xml(concat('<r>', array_join(transform(array_sort(collect_list(struct(n_nationkey AS k, n_name AS n))), s -> concat('<e><k>', s.k, '</k><n>', s.n, '</n></e>')), ''), '</r>'), 'e ARRAY<STRUCT<k: INT, n: STRING>>').e) AS (pos, e) FROM nation GROUP BY n_regionkey)",
    "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS ord, CAST(n_nationkey AS INTEGER) AS k, n_name AS n FROM nation",
)


# --- files and projects -------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name FROM supplier")
def copy_text_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY in TEXT format: tabs, and \\N for null."""
    path = f"{files.shared(spark)}/suppliers.tsv"
    name = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))
    files.copy_to(table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name")), path, delimiter="\t", null="\\N")
    return files.copy_from(spark, path, "s_suppkey bigint, name string", delimiter="\t", null="\\N")


@query("SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1")
def foreign_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table name for files elsewhere, with the reader's options."""
    path = f"{files.shared(spark)}/foreign"
    files.copy_to(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), path, header=True, delimiter="|")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW foreign_nation (k BIGINT, r INT) USING csv OPTIONS (path '{path}', header true, sep '|', enforceSchema true)")
    return spark.sql("SELECT r, count(*) AS n FROM foreign_nation GROUP BY r")


@query("SELECT 'CREATE' AS action, 'TABLE' AS obj_type, 's.' || replace(n_name, ' ', '_') AS name FROM nation UNION ALL SELECT 'COMMENT', 'TABLE', 's.' || replace(n_name, ' ', '_') FROM nation UNION ALL SELECT 'ALTER', 'TABLE', 's.' || replace(n_name, ' ', '_') FROM nation UNION ALL SELECT 'GRANT', 'TABLE', 's.' || replace(n_name, ' ', '_') FROM nation")
def dump_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{files.shared(spark)}/dump"
    t = F.concat(F.lit("s."), F.replace("n_name", F.lit(" "), F.lit("_")))
    text = F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), t, F.lit(" (k int); -- one; two\nCOMMENT ON TABLE "), t, F.lit(" IS 'a; b';\nALTER TABLE ONLY "), t, F.lit(" ADD COLUMN c text DEFAULT ';';\nGRANT SELECT, INSERT ON "), t, F.lit(" TO reader;"))
    table(spark, sf_dir, "nation").select(text.alias("value")).write.text(path)
    return files.read_dump(spark, path).select("action", "obj_type", "name")


@query("SELECT 'TABLE' AS obj_type, n_name AS name, 'CREATE TABLE t (k int' || CASE WHEN n_regionkey = 0 THEN ', new int' ELSE '' END || ')' AS sql FROM nation WHERE n_regionkey <> 1")
def project_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project folder is written, one region's objects are changed and another's dropped; the rest of its files stay."""
    path = f"{files.shared(spark)}/project"
    nation = table(spark, sf_dir, "nation").select(F.lit("TABLE").alias("obj_type"), F.col("n_name").alias("name"), "n_regionkey")
    files.write_project(nation.withColumn("sql", F.lit("CREATE TABLE t (k int)")), path)
    changed = nation.filter("n_regionkey = 0").withColumn("sql", F.lit("CREATE TABLE t (k int, new int)"))
    files.write_project(changed, path, dropped=nation.filter("n_regionkey = 1"))
    return files.read_project(spark, path)


# --- views --------------------------------------------------------------------------------------------------------


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'B'")
def view_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation region")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW named_nations AS SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
    return spark.sql("SELECT * FROM named_nations WHERE r_name < 'B'")


@query("SELECT o_orderstatus AS s, v.v AS version, count(*) AS n FROM orders, (VALUES (0), (3600), (7200)) v(v) GROUP BY 1, 2")
def refreshable_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked five times in two hours and a half, a view refreshed EVERY HOUR APPEND has three versions."""
    out = files.shared(spark)
    counts = lambda: table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    clock: list[int] = []
    view = RefreshableView(spark, out, lambda: counts().withColumn("version", F.lit(clock[-1] // 3600 * 3600)), every=3600, append=True)
    for now in (5, 1800, 3601, 7199, 9000):
        clock.append(now)
        view.refresh(now)
    return view.read().select("s", "version", "n")


@query("SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1")
def stream_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WATCH: the newest of the result's versions."""
    out = files.shared(spark)
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag")
    lines.repartition(3).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    versions = watched(stream.groupBy(F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n")), f"{out}/watch")
    return versions.groupBy("f").agg(F.max_by("n", "_version").alias("n"))
