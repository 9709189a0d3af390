"""Queries over catalog snapshots of the data folder: the old one as it is, the new one changed (see catalog.model.changed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalog import diff, graph, model, plan, types
from lattica.operators.recursion import closure, kept, reverse
from lattica.session import TABLES, Query, table

QUERIES: dict[str, tuple[Query, str | None]] = {}

_LIST = ", ".join(f"('{t}')" for t in TABLES)
# the same catalogs in SQL for DuckDB, from its own view of the Parquet schemas; types are compared between snapshots only
_OLD = f"""old AS (SELECT table_name AS tbl, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS name, data_type AS type FROM information_schema.columns WHERE table_name IN (SELECT * FROM (VALUES {_LIST}) v(t)))"""
_NEW = """new AS (
  SELECT tbl, CASE WHEN tbl = 'supplier' AND ordinal < 2 THEN 1 - ordinal ELSE ordinal END AS ordinal, name,
         CASE WHEN tbl = 'orders' AND name = 'o_totalprice' THEN 'decimal' WHEN tbl = 'nation' AND name = 'n_regionkey' THEN 'big' ELSE type END AS type
  FROM old WHERE tbl <> 'benchmark' AND NOT (tbl = 'part' AND name = 'p_size')
  UNION ALL SELECT * FROM (VALUES ('customer', 5, 'c_phone', 'text'), ('returns', 0, 'ret_id', 'big'), ('returns', 1, 'ret_orderkey', 'big')) n(tbl, ordinal, name, type))"""
_VIEWS = ", ".join(f"('main.{v}', 'main.{r}')" for v, reads in model.VIEWS.items() for r in reads)
_FKS = ", ".join(f"('main.{t}.{c}', 'main.{r}.{model.KEYS[r]}')" for t, c, r in model.REFERENCES)
_EDGES = f"""n AS (SELECT 'main.' || tbl || '.' || name AS node, 'main.' || tbl AS parent FROM old UNION SELECT DISTINCT 'main.' || tbl, 'main' FROM old
   UNION SELECT DISTINCT v, 'main' FROM (VALUES {_VIEWS}) x(v, r)),
 e AS (SELECT node AS src, parent AS dst FROM n UNION SELECT * FROM (VALUES {_VIEWS}) x(v, r) UNION SELECT * FROM (VALUES {_FKS}) x(a, b))"""
_CLOSURE = "WITH RECURSIVE " + _OLD + ", " + _EDGES + ", t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src) "
_W = "WITH " + _OLD + ", " + _NEW + " "


def query(duck_text: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, duck_text)
        return f

    return add


_TREE = """, d AS (SELECT coalesce(a.tbl, b.tbl) AS tbl, coalesce(a.name, b.name) AS name, a.name IS NOT NULL AS l, b.name IS NOT NULL AS r,
   a.type IS NOT DISTINCT FROM b.type AND a.ordinal IS NOT DISTINCT FROM b.ordinal AS same FROM old a FULL JOIN new b ON a.tbl = b.tbl AND a.name = b.name),
 c AS (SELECT 'main.' || tbl || '.' || name AS node, 'main.' || tbl AS parent, 'COLUMN' AS obj_type, CASE WHEN l AND r THEN 'BOTH' WHEN l THEN 'LEFT' ELSE 'RIGHT' END AS side FROM d WHERE NOT (l AND r AND same)),
 t AS (SELECT 'main.' || coalesce(a.tbl, b.tbl) AS node, 'main' AS parent, 'TABLE' AS obj_type, CASE WHEN b.tbl IS NULL THEN 'LEFT' WHEN a.tbl IS NULL THEN 'RIGHT' ELSE 'BOTH' END AS side
   FROM (SELECT DISTINCT tbl FROM old) a FULL JOIN (SELECT DISTINCT tbl FROM new) b ON a.tbl = b.tbl),
 tree AS (SELECT * FROM c UNION ALL SELECT * FROM t WHERE side <> 'BOTH' OR node IN (SELECT parent FROM c)
 UNION ALL SELECT 'main.part_supply', 'main', 'VIEW', 'LEFT' UNION ALL SELECT 'main', NULL, 'SCHEMA', 'BOTH')"""
# edges of both snapshots, the actions, and their order: by phase, level (the most edges to something that needs nothing), kind, name
_PLAN = "WITH RECURSIVE " + _OLD + ", " + _NEW + ", " + _EDGES + _TREE + f""", en AS (SELECT * FROM e UNION SELECT 'main.' || tbl || '.' || name, 'main.' || tbl FROM new UNION SELECT 'main.' || tbl, 'main' FROM new),
 lv AS (SELECT dst AS node, 0 AS level FROM en WHERE dst NOT IN (SELECT src FROM en) UNION SELECT en.src, lv.level + 1 FROM lv JOIN en ON en.dst = lv.node),
 top AS (SELECT node, max(level) AS level FROM lv GROUP BY node),
 st AS (SELECT node, obj_type, CASE WHEN side = 'LEFT' THEN 'DROP' WHEN side = 'RIGHT' THEN 'CREATE' WHEN node = 'main.orders.o_totalprice' THEN 'ALTER_WITH_DEP' WHEN obj_type = 'VIEW' THEN 'RECREATE' ELSE 'ALTER' END AS state FROM tree WHERE obj_type <> 'SCHEMA'),
 up AS (SELECT DISTINCT node, CASE WHEN parent <> 'main' THEN parent ELSE node END AS top FROM (SELECT node, parent FROM n UNION SELECT 'main.' || tbl || '.' || name, 'main.' || tbl FROM new)),
 al AS (SELECT * FROM en UNION SELECT coalesce(a.top, src), coalesce(b.top, dst) FROM en LEFT JOIN up a ON a.node = src LEFT JOIN up b ON b.node = dst WHERE coalesce(a.top, src) <> coalesce(b.top, dst)),
 hit AS (SELECT al.src AS node FROM al JOIN st ON st.node = al.dst WHERE state IN ('DROP', 'RECREATE', 'ALTER_WITH_DEP') UNION SELECT al.src FROM hit JOIN al ON al.dst = hit.node),
 forced AS (SELECT node, 'VIEW' AS obj_type, 'RECREATE' AS state FROM hit WHERE node IN (SELECT v FROM (VALUES {_VIEWS}) x(v, r)) AND node NOT IN (SELECT node FROM st WHERE state IN ('DROP', 'CREATE'))),
 pl AS (SELECT * FROM st WHERE node NOT IN (SELECT node FROM forced) UNION ALL SELECT * FROM forced),
 ac AS (SELECT node, obj_type, state AS action FROM pl WHERE state <> 'RECREATE' UNION ALL SELECT node, obj_type, 'DROP' FROM pl WHERE state = 'RECREATE' UNION ALL SELECT node, obj_type, 'CREATE' FROM pl WHERE state = 'RECREATE'),
 ky AS (SELECT ac.*, CASE WHEN action = 'DROP' THEN 0 ELSE 1 END AS phase, CASE WHEN action = 'DROP' THEN -1 ELSE 1 END AS way, coalesce(level, 0) AS level, CASE obj_type WHEN 'TABLE' THEN {model.KINDS.index("TABLE")} WHEN 'COLUMN' THEN {model.KINDS.index("COLUMN")} ELSE {model.KINDS.index("VIEW")} END AS rank FROM ac LEFT JOIN top ON top.node = ac.node),
 pn AS (SELECT row_number() OVER (ORDER BY phase, way * level, way * rank, node, action) AS seq, phase, node, obj_type, action FROM ky) """


def _snapshots(spark: SparkSession, sf_dir: str):
    old = model.columns(spark, sf_dir)
    new = model.changed(old)
    return old, new, model.nodes(old), model.nodes(new, [v for v in model.VIEWS if v != "part_supply"])


@query("WITH " + _OLD + " SELECT tbl, ordinal, name FROM old")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.columns(spark, sf_dir).select("tbl", "ordinal", "name")


@query(_W + _TREE + " SELECT * FROM tree")
def catalog_tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, old, new = _snapshots(spark, sf_dir)
    return diff.tree_diff(old, new)


@query("SELECT 0 AS differences")
def catalog_self_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, old, _ = _snapshots(spark, sf_dir)
    return diff.tree_diff(old, old).agg(F.count("*").cast("int").alias("differences"))


_COLDIFF = """ SELECT coalesce(a.tbl, b.tbl) AS tbl, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'LEFT' WHEN a.name IS NULL THEN 'RIGHT' ELSE 'BOTH' END AS side
 FROM old a FULL JOIN new b ON a.tbl = b.tbl AND a.name = b.name WHERE a.type IS DISTINCT FROM b.type AND coalesce(a.tbl, b.tbl) IN (SELECT tbl FROM old) AND coalesce(a.tbl, b.tbl) IN (SELECT tbl FROM new)"""


@query(_W + _COLDIFF)
def catalog_column_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _, _ = _snapshots(spark, sf_dir)
    return diff.column_diff(old, new).select("tbl", "name", "side")


@query(_W + "SELECT a.tbl, a.name, t.attribute FROM old a JOIN new b ON a.tbl = b.tbl AND a.name = b.name JOIN (VALUES ('type'), ('ordinal')) t(attribute) ON CASE attribute WHEN 'type' THEN a.type <> b.type ELSE a.ordinal <> b.ordinal END")
def catalog_attribute_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _, _ = _snapshots(spark, sf_dir)
    return diff.attribute_diff(old, new).select("tbl", "name", "attribute")


@query("WITH " + _OLD + ", " + _EDGES + "SELECT node FROM n UNION SELECT 'main'")
def catalog_white_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = model.nodes(model.columns(spark, sf_dir))
    other = spark.createDataFrame([("audit", None, "SCHEMA", "audit", ""), ("audit.log", "audit", "TABLE", "log", "")], nodes.schema)
    return diff.white_listed(nodes.unionByName(other), [], ["ma.n"]).select("node")


@query(_W + "SELECT DISTINCT 'main.' || tbl AS node FROM (" + _COLDIFF + ")")
def catalog_changed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, a, b = _snapshots(spark, sf_dir)
    return diff.changed_tables(diff.tree_diff(a, b), diff.column_diff(old, new)).select("node")


@query(_W + "SELECT o.tbl, o.c <> n.c AS ordered_differs, o.s <> n.s AS set_differs FROM (SELECT tbl, string_agg(name || type, ',' ORDER BY ordinal) AS c, string_agg(name || type, ',' ORDER BY name) AS s FROM old GROUP BY tbl) o JOIN (SELECT tbl, string_agg(name || type, ',' ORDER BY ordinal) AS c, string_agg(name || type, ',' ORDER BY name) AS s FROM new GROUP BY tbl) n ON o.tbl = n.tbl")
def catalog_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _, _ = _snapshots(spark, sf_dir)
    f = lambda c, i: diff.ordered_fingerprint(c, i)
    a = f(old, False).withColumnRenamed("fp", "a").join(f(old, True).withColumnRenamed("fp", "b"), "tbl")
    b = f(new, False).withColumnRenamed("fp", "c").join(f(new, True).withColumnRenamed("fp", "d"), "tbl")
    return a.join(b, "tbl").select("tbl", (F.col("a") != F.col("c")).alias("ordered_differs"), (F.col("b") != F.col("d")).alias("set_differs"))


@query(_CLOSURE + "SELECT src, dst FROM t")
def catalog_forward_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(model.edges(model.nodes(model.columns(spark, sf_dir)))).select("src", "dst")


@query(_CLOSURE + "SELECT dst AS src, src AS dst FROM t WHERE dst = 'main.region.r_regionkey'")
def catalog_reverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reverse(model.edges(model.nodes(model.columns(spark, sf_dir))))
    return closure(e, spark.createDataFrame([("main.region.r_regionkey",)], "src string")).select("src", "dst")


@query("WITH " + _OLD + ", " + _EDGES + """, k AS (SELECT node, CASE WHEN parent <> 'main' AND node <> 'main' THEN parent ELSE node END AS up FROM n)
 SELECT DISTINCT coalesce(a.up, src) AS src, coalesce(b.up, dst) AS dst FROM e LEFT JOIN k a ON src = a.node LEFT JOIN k b ON dst = b.node WHERE coalesce(a.up, src) <> coalesce(b.up, dst)""")
def catalog_reduced_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = model.nodes(model.columns(spark, sf_dir))
    return graph.reduced(model.edges(nodes), nodes)


@query(_CLOSURE + "SELECT dst AS node, count(*) AS n FROM (WITH RECURSIVE u AS (SELECT node AS src, parent AS dst FROM n WHERE parent IS NOT NULL UNION SELECT u.src, n.parent FROM u JOIN n ON u.dst = n.node WHERE n.parent IS NOT NULL) SELECT * FROM u) GROUP BY dst")
def catalog_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.descendant_counts(model.nodes(model.columns(spark, sf_dir)))


@query(_CLOSURE + ", p AS (SELECT 'main.top_customers' AS node, 0 AS depth, 'main.top_customers' AS path UNION ALL SELECT e.dst, depth + 1, path || ' > ' || e.dst FROM p JOIN e ON e.src = p.node WHERE depth < 3) SELECT 'main.top_customers' AS root, node, depth, path FROM p")
def catalog_dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = model.nodes(model.columns(spark, sf_dir))
    return graph.report(model.edges(nodes), nodes, "TOP_cust.*", depth=3).select("root", "node", "depth", "path")


@query(_CLOSURE + "SELECT DISTINCT CASE WHEN p.parent <> 'main' THEN p.parent ELSE t.src END AS node FROM t LEFT JOIN n p ON p.node = t.src WHERE (t.dst = 'main.lineitem' OR t.dst LIKE 'main.lineitem.%') AND t.src <> 'main.lineitem' AND t.src NOT LIKE 'main.lineitem.%'")
def catalog_drop_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = model.nodes(model.columns(spark, sf_dir))
    return graph.neighbourhood(model.edges(nodes), nodes, "main.lineitem", dropped=True)


_RULE_TEXT = """SHOW ALL
HIDE CONTENT orders type=TABLE
SHOW o_orderkey
HIDE REGEX ".*_acctbal"
HIDE REGEX,QUALIFIED main\\.part\\..* type=COLUMN
SHOW p_name
HIDE 'p_name' type=COLUMN
HIDE region db=other.* type=TABLE
"""


@query("WITH " + _OLD + ", " + _EDGES + """SELECT node, CASE WHEN node = 'main.orders' OR parent = 'main.orders' OR node LIKE '%\\_acctbal' ESCAPE '\\' OR node LIKE 'main.part.%' THEN 'SKIP' ELSE 'ADD' END AS status FROM n UNION ALL SELECT 'main', 'ADD'""")
def catalog_rule_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    show_all, rules = diff.parse_rules(_RULE_TEXT)
    return diff.rule_statuses(model.nodes(model.columns(spark, sf_dir)), diff.merged_rules(spark.createDataFrame(rules, diff.RULES)), show_all)


@query(_PLAN + """, need AS (SELECT 'main.returns.ret_id' AS node UNION SELECT en.dst FROM need JOIN en ON en.src = need.node), users AS (SELECT 'main.part.p_size' AS node UNION SELECT e.src FROM users JOIN e ON e.dst = users.node)
 SELECT node FROM (SELECT node FROM need UNION SELECT node FROM users) WHERE node IN (SELECT node FROM tree)""")
def catalog_extended_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, a, b = _snapshots(spark, sf_dir)
    picked = spark.createDataFrame([("main.returns.ret_id",), ("main.part.p_size",)], "node string")
    return diff.extended_selection(diff.tree_diff(a, b), picked, model.edges(a), model.edges(b))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, a, b = _snapshots(spark, sf_dir)
    a, b = kept(a), kept(b)
    tree, cols = diff.tree_diff(a, b), diff.column_diff(old, new)
    both = kept(a.unionByName(b).dropDuplicates(["node"]))
    edges = kept(model.edges(a).unionByName(model.edges(b)).distinct())
    states = kept(plan.states(tree.filter("obj_type <> 'SCHEMA'"), cols))
    every = kept(graph.reduced(edges, both).unionByName(edges.select("src", "dst")).distinct())
    return plan.ordered(kept(plan.recreated(states, every, both)), edges)


@query(_PLAN + "SELECT * FROM pn")
def catalog_migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(_PLAN + ", sc AS (SELECT phase, min(seq) AS seq, sql FROM (SELECT phase, seq, CASE WHEN action LIKE 'ALTER%' THEN 'ALTER' ELSE action END || ' ' || obj_type || ' ' || node AS sql FROM pn) GROUP BY phase, sql) SELECT phase, CAST(row_number() OVER (PARTITION BY phase ORDER BY seq) AS INTEGER) AS place, sql FROM sc")
def catalog_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.script(plan.statements(_plan(spark, sf_dir)))


@query("SELECT * FROM (VALUES (1, 2, 'a', 'ALTER', 2), (3, 3, 'b', 'ALTER', 1), (4, 4, 'a', 'ALTER', 1), (5, 5, 'a', 'DROP', 1)) v(\"first\", \"last\", tbl, action, n)")
def catalog_merged_alters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "a", "ALTER"), (2, "a", "ALTER"), (3, "b", "ALTER"), (4, "a", "ALTER"), (5, "a", "DROP")]
    return plan.merged_alters(spark.createDataFrame(rows, "seq int, tbl string, action string")).withColumn("n", F.col("n").cast("int"))


@query("SELECT * FROM (VALUES ('ALTER TABLE t DROP COLUMN c', 'DROP_COLUMN'), ('update t set a = 1', 'UPDATE'), ('ALTER SEQUENCE s RESTART WITH 5', 'RESTART_WITH')) v(sql, danger)")
def catalog_dangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["ALTER TABLE t DROP COLUMN c", "update t set a = 1", "DROP TABLE x", "CREATE TABLE y (a int)", "ALTER SEQUENCE s RESTART WITH 5"]
    return plan.dangers(spark.createDataFrame([(t,) for t in texts], "sql string"), ["DROP_TABLE"])


@query(_W + "SELECT tbl AS node, 'old' AS kept FROM (SELECT DISTINCT tbl FROM old) UNION ALL SELECT 'returns', 'library'")
def catalog_library_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, a, b = _snapshots(spark, sf_dir)
    out, _ = diff.library_merge(a.filter("obj_type = 'TABLE'"), b.filter("obj_type = 'TABLE'"))
    return out.select(F.col("name").alias("node"), F.when(F.col("name") == "returns", "library").otherwise("old").alias("kept"))


@query("SELECT * FROM (VALUES ('c1', 'f(bigint)', 'bigint'), ('c2', 'f(double)', 'double'), ('c3', 'g(text,int)', 'text'), ('c4', 'eq(any,any)', 'boolean')) v(call, signature, returns)")
def catalog_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark.createDataFrame([("c1", "f", ["int"]), ("c2", "f", ["double"]), ("c3", "g", ["text"]), ("c4", "eq", ["date", "date"]), ("c5", "f", ["date"])], "call string, name string, args array<string>")
    known = [("f", "f(bigint)", ["bigint"], 0, "bigint"), ("f", "f(double)", ["double"], 0, "double"), ("g", "g(text,int)", ["text", "int"], 1, "text"), ("eq", "eq(any,any)", ["any", "any"], 0, "boolean")]
    casts = spark.createDataFrame([("int", "bigint"), ("int", "double"), ("bigint", "double")], "source string, target string")
    return types.resolve_calls(calls, spark.createDataFrame(known, "name string, signature string, params array<string>, defaults int, returns string"), casts)


@query("SELECT * FROM (VALUES (0, 'x'), (1, 'c_name'), (2, 'case'), (3, 'exists'), (4, 'count'), (5, '?column?'), (6, 'o_orderdate'), (7, 'date_part')) v(pos, name)")
def catalog_item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ["a + 1 AS x", "c.c_name", "CASE WHEN a THEN b END", "EXISTS (SELECT 1)", "count(*)", "1 + 2", "CAST(o_orderdate AS date)", "extract(year FROM d)"]
    return spark.createDataFrame([(i, types.item_name(t)) for i, t in enumerate(items)], "pos int, name string")


@query("SELECT * FROM (VALUES ('nation', 'n_name'), ('nation', 'n_nationkey'), ('customer', 'c_acctbal'), ('customer', 'c_nationkey')) v(tbl, name)")
def catalog_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("nation", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    found = types.lineage(spark, "SELECT n_name, sum(c_acctbal) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
    return spark.createDataFrame(found, "tbl string, name string")


@query("SELECT * FROM (VALUES (0, 'k', 'bigint'), (1, 'd', 'double'), (2, 'n', 'bigint')) v(pos, name, type)")
def catalog_result_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    found = types.result_columns(spark.sql("SELECT o_custkey AS k, avg(o_totalprice) AS d, count(*) AS n FROM orders GROUP BY o_custkey"))
    return spark.createDataFrame([(i, *x) for i, x in enumerate(found)], "pos int, name string, type string")


@query("SELECT 'fk1' AS fk, 'pk' AS key")
def catalog_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    fks = spark.createDataFrame([("fk1", "t", ["a", "b"]), ("fk2", "t", ["b", "a"])], "fk string, ref_table string, ref_columns array<string>")
    keys = spark.createDataFrame([("pk", "t", ["a", "b"]), ("uq", "u", ["a", "b"])], "key string, tbl string, cols array<string>")
    return graph.key_edges(fks, keys)


@query("SELECT * FROM (VALUES ('c.x', 'b.x'), ('c.x', 'a.x'), ('b.x', 'a.x'), ('b.y', 'a.y')) v(src, dst)")
def catalog_inherited_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x")], "tbl string, name string")
    return graph.inherited_column_edges(cols, spark.createDataFrame([("c", "b"), ("b", "a")], "child string, parent string"))


@query("SELECT * FROM (VALUES ('f', 'g'), ('g', 'f'), ('h', 't')) v(src, dst)")
def catalog_cycles_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.createDataFrame([("f", "FUNCTION"), ("g", "FUNCTION"), ("h", "FUNCTION"), ("t", "TABLE")], "node string, obj_type string")
    edges = spark.createDataFrame([("f", "g"), ("g", "f"), ("f", "t"), ("h", "t")], "src string, dst string")
    return graph.cycles_broken(edges, nodes)


@query(_W + ", d AS (" + _COLDIFF.strip() + ") SELECT tbl, name, CASE side WHEN 'LEFT' THEN 'RIGHT' WHEN 'RIGHT' THEN 'LEFT' ELSE side END AS side FROM d")
def catalog_reverted_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _, _ = _snapshots(spark, sf_dir)
    return diff.reverted(diff.column_diff(old, new)).select("tbl", "name", "side")


@query("WITH " + _OLD + " SELECT DISTINCT 'main.' || tbl AS node, CASE WHEN tbl = 'orders' THEN 'sales' ELSE 'admin' END AS owner FROM old")
def catalog_owner_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = model.nodes(model.columns(spark, sf_dir)).filter("obj_type = 'TABLE'").select("node", F.lit("admin").alias("owner"))
    return diff.overridden(tables, spark.createDataFrame([("main.orders", "sales"), ("main.none", "x")], "node string, owner string"))


@query("SELECT * FROM (VALUES ('q1', 'nation', 'n_name'), ('q1', 'nation', 'n_nationkey'), ('q2', 'orders', 'o_custkey'), ('q2', 'customer', 'c_custkey')) v(query, tbl, name)")
def catalog_reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"q1": "SELECT n_name FROM nation WHERE n_nationkey = 3", "q2": "SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey"}
    return types.references(spark, texts, model.columns(spark, sf_dir))


@query("SELECT 'q1' AS query, 'pk' AS key")
def catalog_group_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = spark.createDataFrame([("q1", "t", ["a", "b", "c"]), ("q2", "t", ["a"])], "query string, tbl string, cols array<string>")
    return graph.group_by_key_edges(grouped, spark.createDataFrame([("pk", "t", ["a", "b"])], "key string, tbl string, cols array<string>"))


@query(_W + "SELECT 'main.' || tbl || '.' || name AS node, side FROM (" + _COLDIFF + ") WHERE tbl <> 'nation'")
def catalog_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, a, b = _snapshots(spark, sf_dir)
    both = kept(a.unionByName(b).dropDuplicates(["node"]))
    show_all, rules = diff.parse_rules("SHOW ALL\nHIDE CONTENT nation")
    statuses = diff.rule_statuses(both, spark.createDataFrame(rules, diff.RULES), show_all)
    named = diff.column_diff(old, new).select(F.concat(F.lit("main."), "tbl", F.lit("."), "name").alias("node"))
    tree = diff.tree_diff(a, b).join(named, "node", "left_semi")
    return diff.flattened(tree, statuses, ["COLUMN"]).select("node", "side")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def catalog_moved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.moved_rows(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_phone"], generated=["c_acctbal"])


@query("SELECT * FROM (VALUES ('a', 'b'), ('b', 'c')) v(src, dst)")
def catalog_custom_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    return graph.with_custom(spark.createDataFrame([("a", "b")], "src string, dst string"), nodes, spark.createDataFrame([("b", "c"), ("c", "z")], "src string, dst string"))


@query("WITH RECURSIVE " + _OLD + ", " + _EDGES + """, k AS (SELECT node, CASE WHEN parent <> 'main' THEN parent ELSE node END AS up FROM n),
 f AS (SELECT DISTINCT coalesce(a.up, src) AS src, coalesce(b.up, dst) AS dst FROM e LEFT JOIN k a ON src = a.node LEFT JOIN k b ON dst = b.node WHERE coalesce(a.up, src) <> coalesce(b.up, dst)),
 t AS (SELECT dst FROM f WHERE src = 'main.top_customers' UNION SELECT f.dst FROM t JOIN f ON t.dst = f.src) SELECT dst AS node FROM t""")
def catalog_create_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = model.nodes(model.columns(spark, sf_dir))
    return graph.neighbourhood(model.edges(nodes), nodes, "main.top_customers")


@query("SELECT * FROM (VALUES ('part', 'A', 'x', 'CHANGED'), ('part', 'B', 'c2', 'DELETED'), ('part', 'D', 'c4', 'INSERTED')) v(tbl, k, v, change)")
def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([("A", "c1"), ("B", "c2"), ("C", "c3")], "k string, v string")
    new = spark.createDataFrame([("A", "x"), ("C", "c3"), ("D", "c4")], "k string, v2 string")
    both = old.join(new, "k", "full_outer").filter(~F.col("v").eqNullSafe(F.col("v2")))
    change = F.when(F.col("v").isNull(), "INSERTED").when(F.col("v2").isNull(), "DELETED").otherwise("CHANGED")
    return both.select(F.lit("part").alias("tbl"), "k", F.coalesce("v2", "v").alias("v"), change.alias("change"))


# --- the same on as many rows as the tables have ------------------------------------------------------------------


@query("SELECT l_orderkey || '-' || l_linenumber AS fk, 'k' || p_partkey AS key FROM lineitem JOIN part ON l_partkey = p_partkey AND l_suppkey % 2 = p_size % 2 AND l_linenumber % 3 = p_size % 3")
def catalog_key_edges_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    fks = lines.selectExpr("concat(l_orderkey, '-', l_linenumber) AS fk", "concat('t', l_partkey) AS ref_table", "array(concat('a', l_suppkey % 2), concat('b', l_linenumber % 3)) AS ref_columns")
    keys = parts.selectExpr("concat('k', p_partkey) AS key", "concat('t', p_partkey) AS tbl", "array(concat('a', p_size % 2), concat('b', p_size % 3)) AS cols")
    return graph.key_edges(fks, keys)


@query("SELECT 'q' || o_orderkey AS query, 'k' || c_custkey AS key FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 <> 0 OR o_orderkey % 2 = 1")
def catalog_group_by_key_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").selectExpr("concat('q', o_orderkey) AS query", "concat('t', o_custkey) AS tbl", "IF(o_orderkey % 2 = 1, array('b', 'a', 'c'), array('b', 'a')) AS cols")
    keys = table(spark, sf_dir, "customer").selectExpr("concat('k', c_custkey) AS key", "concat('t', c_custkey) AS tbl", "IF(c_custkey % 3 = 0, array('a', 'c'), array('a', 'b')) AS cols")
    return graph.group_by_key_edges(grouped, keys)


@query("SELECT min(seq) AS \"first\", max(seq) AS \"last\", tbl, min(action) AS action, count(*) AS n FROM (SELECT *, sum(new) OVER (ORDER BY seq) AS i FROM (SELECT *, CASE WHEN action = 'ALTER' AND lag(action) OVER o = 'ALTER' AND lag(tbl) OVER o = tbl AND lag(seq) OVER o = seq - 1 THEN 0 ELSE 1 END AS new FROM (SELECT event_id AS seq, event_type AS tbl, CASE WHEN user_id % 4 = 0 THEN 'DROP' ELSE 'ALTER' END AS action FROM events) WINDOW o AS (ORDER BY seq))) GROUP BY tbl, i")
def catalog_merged_alters_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.merged_alters(table(spark, sf_dir, "events").selectExpr("event_id AS seq", "event_type AS tbl", "IF(user_id % 4 = 0, 'DROP', 'ALTER') AS action"))


@query(
    "SELECT o_orderkey AS call, v.signature, v.returns FROM (SELECT o_orderkey, 'f' || o_custkey % 3 AS name, ['int', 'bigint', 'double', 'date'][o_orderkey % 4 + 1] AS arg FROM orders) c "
    "JOIN (VALUES ('f0', 'int', 'f0(bigint)', 'bigint'), ('f0', 'bigint', 'f0(bigint)', 'bigint'), ('f0', 'double', 'f0(double)', 'double'), ('f1', 'int', 'f1(any)', 'text'), ('f1', 'bigint', 'f1(any)', 'text'), ('f1', 'double', 'f1(any)', 'text'), ('f1', 'date', 'f1(any)', 'text'), ('f2', 'date', 'f2(date,int)', 'date')) v(name, arg, signature, returns) ON c.name = v.name AND c.arg = v.arg"
)
def catalog_overloads_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS call", "concat('f', o_custkey % 3) AS name", "array(element_at(array('int', 'bigint', 'double', 'date'), CAST(o_orderkey % 4 + 1 AS INT))) AS args")
    known = [("f0", "f0(bigint)", ["bigint"], 0, "bigint"), ("f0", "f0(double)", ["double"], 0, "double"), ("f1", "f1(any)", ["any"], 0, "text"), ("f2", "f2(date,int)", ["date", "int"], 1, "date")]
    casts = spark.createDataFrame([("int", "bigint"), ("int", "double"), ("bigint", "double")], "source string, target string")
    return types.resolve_calls(calls, spark.createDataFrame(known, "name string, signature string, params array<string>, defaults int, returns string"), casts)
