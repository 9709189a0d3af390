"""Further forms on small tables, against plain Python: hot keys, gaps, patterns, partitions, user operators, projects, refreshes."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.functions import events
from lattica.functions.user import Operators
from lattica.operators import joins, partitions, patterns, rows
from lattica.sources import files
from lattica.streaming.views import RefreshableView


@pytest.mark.parametrize("bucket", [None, 1, 7, 1000])
def test_asof_in_buckets(spark, bucket):
    r = random.Random(7)
    some = lambda n: [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(-40, 90)])) for _ in range(n)]
    a, b = [(i, *x) for i, x in enumerate(some(150))], [(*x, i) for i, x in enumerate(some(60))]
    left, right = spark.createDataFrame(a, "i int, k string, t int"), spark.createDataFrame(b, "k string, t int, v int")
    got = {x.i: x.v for x in joins.asof_join(left, right, ["k"], "t", "t", ["v"], bucket=bucket).collect()}
    best = lambda k, t: max(((u, v) for m, u, v in b if None not in (k, t, u) and m == k and u <= t), default=(0, None))[1]
    assert got == {i: best(k, t) for i, k, t in a}


def test_values_are_carried_over_ranges(spark):
    df = spark.range(0, 5000, 1, 8).selectExpr("id AS k", "IF(id % 997 = 5, id, NULL) AS v", "IF(id = 4000, 'x', NULL) AS w")
    got = joins.carried_forward(df, ["k"], ["v", "w"]).collect()
    assert {(x.k, x.v, x.w) for x in got} == {(k, max((v for v in range(5, k + 1, 997)), default=None), "x" if k >= 4000 else None) for k in range(5000)}
    assert joins.carried_forward(df.limit(0), ["k"], ["v"]).count() == 0


def test_stale_fills_end_at_the_next_row(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 2, 2), ("a", 9, 3), ("b", 1, 4)], "g string, k int, n int")
    want = [("a", 0, 1), ("a", 1, None), ("a", 2, 2), ("a", 3, None), ("a", 4, None), ("a", 9, 3), ("a", 10, None), ("a", 11, None), ("b", 1, 4), ("b", 2, None), ("b", 3, None)]
    assert sorted(map(tuple, rows.fill_stale(df, "k", F.lit(1), F.lit(3), ["g"]).collect())) == want
    alone = df.filter("g = 'a'").drop("g")
    assert sorted(map(tuple, rows.fill_stale(alone, "k", F.lit(1), F.lit(3)).collect())) == [w[1:] for w in want if w[0] == "a"]


def test_ties_by_expressions_and_nulls(spark):
    df = spark.createDataFrame([(1, "a DESC"), (2, "z"), (2, "y"), (None, None), (None, "n")], "x int, s string")
    assert sorted(r.x for r in rows.with_ties(df.filter("x > 0"), 1, ["CASE WHEN s = 'a DESC' THEN 1 ELSE 0 END"]).collect()) == [2, 2]
    assert [r.x for r in rows.with_ties(df, 1, ["x"]).collect()] == [None, None]
    assert sorted(r.x or 0 for r in rows.with_ties(df, 4, ["x desc"]).collect()) == [0, 0, 1, 2, 2]


def test_funnel_against_a_fold(spark):
    r = random.Random(3)
    seen = [(r.randrange(6), r.randrange(200), r.choice("abcx")) for _ in range(400)] + [(9, 1, "x")]
    df = spark.createDataFrame(seen, "k int, s int, e string").select("k", F.timestamp_seconds("s").alias("t"), "e")
    got = {x.k: x.level for x in events.window_funnel(df, "k", "t", "e", ["a", "b", "b", "c"], 9).collect()}
    want = {}
    for k in {x[0] for x in seen}:
        at = [None] * 4
        for s, e in sorted((s, e) for m, s, e in seen if m == k):
            for i in (3, 2, 1):
                if e == "abbc"[i] and at[i - 1] is not None and s - at[i - 1] <= 9:
                    at[i] = at[i - 1]
            at[0] = s if e == "a" else at[0]
        want[k] = max((i + 1 for i in range(4) if at[i] is not None), default=0)
    assert got == want


def test_paths_close_circles(spark):
    node = spark.createDataFrame([(1,), (2,), (3,)], "node int")
    edge = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, None)], "src int, dst int")
    tables = {"a": node, "b": node, "e": edge, "f": edge}
    assert sorted(map(tuple, patterns.match_path(tables, "a-(e)->b-(f)->a").select("a.node", "b.node").collect())) == [(1, 2), (2, 1)]
    assert patterns.match_path(tables, "a-(e)->b").count() == 3
    with pytest.raises(ValueError):
        patterns.match_path(tables, "a-(e)-b")


def test_partitions(spark):
    df = spark.createDataFrame([(None,), (0,), (10,), (11,)], "x int")
    assert [r[0] for r in df.select(partitions.range_number(F.col("x"), [0, 10])).collect()] == [1, 1, 2, 3]
    assert [r[0] for r in df.select(partitions.range_number(F.col("x"), [0, 10], right=True)).collect()] == [1, 2, 3, 3]
    rest, part = partitions.detached(df, F.col("x") > 5)
    assert (rest.count(), part.count()) == (2, 2)
    with pytest.raises(PySparkException, match="outside"):
        partitions.attached(rest, part, F.col("x") > 10).collect()


def test_user_operators_take_the_fewest_casts(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "i int, d double, s string")
    ops = Operators()
    ops.operator("+", "double", "double", lambda a, b: a + b)
    ops.operator("+", "int", "int", lambda a, b: a - b)
    ops.cast("int", "double", lambda a: a.cast("double"))
    assert df.select(ops.apply(df, "i", "+", "d"), ops.apply(df, "i", "+", "i")).first()[:] == (3.0, 0)
    with pytest.raises(ValueError, match="0 operators"):
        ops.apply(df, "s", "+", "i")
    ops.operator("?", "double", "int", lambda a, b: a)
    ops.operator("?", "int", "double", lambda a, b: b)
    with pytest.raises(ValueError, match="2 operators"):
        ops.apply(df, "i", "?", "i")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('CREATE OR REPLACE VIEW "a b" . v AS SELECT 1', ("CREATE", "VIEW", '"a b".v')),
        ("create unique index concurrently if not exists i on t (a)", ("CREATE", "INDEX", "i")),
        ("DROP MATERIALIZED VIEW IF EXISTS s.m", ("DROP", "MATERIALIZED VIEW", "s.m")),
        ("REVOKE ALL ON SCHEMA s FROM x", ("REVOKE", "SCHEMA", "s")),
        ("INSERT INTO s.t VALUES (1)", ("INSERT", "TABLE", "s.t")),
        ("SET search_path = x", (None, None, None)),
    ],
)
def test_heads_of_statements(text, want):
    assert files.head(text) == want


def test_views_wait_for_those_they_depend_on(spark):
    made = lambda name, **more: RefreshableView(spark, f"{files.shared(spark)}/{name}", lambda: spark.range(2), **more)
    base = made("base", every=100)
    top = made("top", every=100, depends=[base])
    with pytest.raises(ValueError):
        top.read()
    assert not top.refresh(150) and base.refresh(150) and top.refresh(150) and not top.refresh(199)
    assert not top.refresh(200) and base.refresh(201) and top.refresh(260)
    assert (top.versions, top.read().count()) == ([100, 200], 2)
