"""Operators on small tables: nulls, ties, empty tables, cycles."""

from pyspark.sql import functions as F

from lattica.catalog import diff, types
from lattica.operators import dml, joins, predicates, recursion, rows
from lattica.sources import files


def test_asof_takes_the_last_before_and_keeps_rows_without_a_match(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 4, "y"), (1, 4, "z"), (2, 10, "w")], "k int, t int, v string")
    assert sorted((r.k or 0, r.t, r.v) for r in joins.asof_join(a, b, ["k"], "t", "t", ["v"]).collect()) == [(0, 3, None), (1, 1, None), (1, 5, "z"), (2, 9, None)]
    assert joins.asof_join(a, b, ["k"], "t", "t", ["v"], how="inner").count() == 1


def test_numbered_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v")
    assert [(r.v, r.n) for r in joins.numbered(df, ["v"], "n").orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]
    many = spark.range(0, 300_000, 1, 16).selectExpr("(id * 7919) % 300007 AS v")
    got = joins.numbered(many, ["v"], "n").agg(F.min("n"), F.max("n"), F.count_distinct("n"), F.max(F.abs(F.col("n") - 1 - F.col("v")))).first()
    assert tuple(got)[:3] == (1, 300_000, 300_000) and got[3] <= 7
    assert joins.numbered(df.limit(0), ["v"], "n").count() == 0


def test_paste_is_as_long_as_the_shorter_side(spark):
    assert joins.paste_join(spark.range(5).toDF("a"), spark.range(3).toDF("b"), ["a"], ["b"]).count() == 3


def test_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "x int")
    assert sorted(r.x for r in rows.with_ties(df, 2, ["x DESC"]).collect()) == [2, 2, 3]


def test_quantifiers_over_nulls_and_nothing(spark):
    df, none = spark.createDataFrame([(1,), (5,)], "x int"), spark.createDataFrame([], "y int")
    assert predicates.compared_to_all(df, "x", ">", none, "y").count() == 2
    assert predicates.compared_to_all(df, "x", ">", none, "y", "ANY").count() == 0
    some = spark.createDataFrame([(0,), (None,)], "y int")
    assert predicates.compared_to_all(df, "x", ">", some, "y").count() == 0
    assert predicates.compared_to_all(df, "x", ">", some, "y", "ANY").count() == 2


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert sorted((r.src, r.dst, r.depth) for r in recursion.closure(e).collect()) == [("a", "a", 2), ("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "b", 2), ("b", "c", 1)]
    marked = recursion.tree_paths(e, spark.createDataFrame([("a",)], "src string")).filter("cycle").collect()
    assert [r.node for r in marked] == ["a"]


def test_merge_branches(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (4, "D")], "k int, v string")
    new, changes = dml.merge(t, s, ["k"], matched={"v": F.col("s.v")}, matched_delete=F.col("s.k") == 3, not_matched={"k": F.col("s.k"), "v": F.col("s.v")}, by_source_delete=F.col("t.k") == 1)
    assert sorted(tuple(r) for r in new.collect()) == [(2, "B"), (4, "D")]
    assert sorted((r.k, r._action) for r in changes.collect()) == [(1, "DELETE"), (2, "UPDATE"), (3, "DELETE"), (4, "INSERT")]


def test_rules():
    show, found = diff.parse_rules('HIDE ALL\nSHOW CONTENT,REGEX "a b.*" type=TABLE,VIEW\n')
    assert not show and found == [(0, "a b.*", True, False, ["TABLE", "VIEW"], True, True, None)]
    assert diff.parse_rules("HIDE 'it''s x' db=\"t .*\" type=VIEW")[1] == [(0, "it's x", False, False, ["VIEW"], False, False, "t .*")]


def test_statements_keep_quoted_semicolons():
    assert files.statements("a ';' b; /* ; */ c $x$ ; $x$;-- ; \n") == ["a ';' b", "c $x$ ; $x$"]


def test_item_names():
    assert [types.item_name(x) for x in ("a.b", "x::int", "'q'", "now()")] == ["b", "x", "?column?", "now"]


def test_similar_to(spark):
    df = spark.createDataFrame([("abc",), ("xbz",), ("a.c",)], "s string")
    assert sorted(r.s for r in df.filter(predicates.similar_to(F.col("s"), "(a|x)b_")).collect()) == ["abc", "xbz"]
    assert [r.s for r in df.filter(predicates.similar_to(F.col("s"), "a.c")).collect()] == ["a.c"]


def test_mann_whitney_over_many_ranges(spark):
    from lattica.functions import aggregates

    df = spark.range(0, 20_000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g", "(id * 7919) % 5003 AS v")
    rows_ = df.collect()
    a, b = sorted(r.v for r in rows_ if r.g == "a"), sorted(r.v for r in rows_ if r.g == "b")
    from bisect import bisect_left, bisect_right

    u = sum(bisect_left(b, x) + (bisect_right(b, x) - bisect_left(b, x)) / 2 for x in a)
    got = aggregates.mann_whitney(df, "g", "v", "a", "b").first()
    assert (got.u1, got.u2) == (u, len(a) * len(b) - u)


def test_lateral_top_keeps_its_order_whatever_order_rows_arrive_in(spark):
    from lattica.plans import relational

    conf, name = spark.sparkContext._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    d = _written(spark, {"customer": spark.range(20).selectExpr("id AS c_custkey").union(spark.range(3)), "orders": spark.range(0, 20_000, 1, 8).selectExpr("id AS o_orderkey", "nullif(id % 20, 7) AS o_custkey", "double((id * 7919) % 5003) AS o_totalprice")})
    best = {k: sorted((-((i * 7919) % 5003), i) for i in range(k, 20_000, 20))[:2] for k in range(20) if k != 7}
    want = sorted((k, i) for k, two in best.items() for _, i in two * (2 if k < 3 else 1))
    conf.set(name, "100")  # sorts spill, so rows that are equal for a sort come in any order, as they do from other machines
    try:
        assert sorted((r.c_custkey, r.o_orderkey) for r in relational.QUERIES["join_lateral"][0](spark, d).collect()) == want
    finally:
        conf.remove(name)
    nulls = spark.createDataFrame([(1, None, 5.0), (1, 3, 5.0), (1, 2, 5.0), (1, 9, None), (2, 4, None)], "o_custkey long, o_orderkey long, o_totalprice double")
    d = _written(spark, {"customer": spark.range(4).toDF("c_custkey"), "orders": nulls})
    assert sorted((r.c_custkey, r.o_orderkey) for r in relational.QUERIES["join_lateral"][0](spark, d).collect()) == [(1, 2), (1, 3), (2, 4)]


def _written(spark, tables):
    import tempfile

    d = tempfile.mkdtemp()
    for t, df in tables.items():
        df.write.parquet(f"{d}/{t}.parquet")
    return d
