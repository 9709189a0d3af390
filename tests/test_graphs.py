"""Closures, levels, plans and fingerprints on deep and random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.catalog import diff, plan
from lattica.operators import recursion


def graph(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def walked(edges):
    at: dict = {}
    for a, b in edges:
        at.setdefault(a, set()).add(b)
    out = {}
    for s in at:
        front, depth = {s}, 0
        while front:
            depth += 1
            front = {d for n in front for d in at.get(n, ()) if (s, d) not in out}
            out |= {(s, d): depth for d in front}
    return out


@pytest.mark.parametrize("small", [0, recursion.SMALL])
def test_closure_both_ways(spark, small):
    r = random.Random(2)
    edges = [(str(r.randrange(12)), str(r.randrange(12))) for _ in range(18)]
    got = {(x.src, x.dst): x.depth for x in recursion.closure(graph(spark, edges), small=small).collect()}
    assert got == walked(edges)
    near = {(x.src, x.dst): x.depth for x in recursion.closure(graph(spark, edges), graph(spark, edges[:1]), most=2, small=small).collect()}
    assert near == {k: d for k, d in got.items() if k[0] == edges[0][0] and d <= 2}


def test_closure_is_as_deep_as_the_graph(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(100)]
    got = recursion.closure(graph(spark, chain))
    assert got.count() == 5050 and got.agg(F.max("depth")).first()[0] == 100
    short = [(f"{i:03}", f"{i + 1:03}") for i in range(11)]
    assert recursion.closure(graph(spark, short), small=0).count() == 66


@pytest.mark.parametrize("small", [0, recursion.SMALL])
def test_levels_are_longest_paths(spark, small):
    edges = [("x", "y"), ("x", "z"), ("x", "w"), ("y", "z"), ("z", "w")]
    assert {r.node: r.level for r in recursion.levels(graph(spark, edges), small=small).collect()} == {"w": 0, "z": 1, "y": 2, "x": 3}
    cyclic = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "d")]
    got = {r.node: r.level for r in recursion.levels(graph(spark, cyclic), small=small).collect()}
    assert got["a"] < got["c"] and set(got) == {"a", "b", "c"}


@pytest.mark.parametrize("seed", range(3))
def test_plans_create_what_is_needed_first_and_drop_it_last(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    r.shuffle(names)
    edges = [(names[b], names[a]) for a in range(14) for b in range(a + 1, 14) if r.random() < 0.2]
    states = {n: r.choice(["CREATE", "DROP", "RECREATE"]) for n in names}
    steps = spark.createDataFrame([(n, r.choice(["TABLE", "VIEW"]), s) for n, s in states.items()], "node string, obj_type string, state string")
    rows = plan.ordered(steps, graph(spark, edges or [("q", "p")])).collect()
    at = {(x.node, x.action): x.seq for x in rows}
    assert max(s for (n, a), s in at.items() if a == "DROP") < min(s for (n, a), s in at.items() if a == "CREATE")
    for src, dst in edges:
        if (src, "CREATE") in at and (dst, "CREATE") in at:
            assert at[dst, "CREATE"] < at[src, "CREATE"]
        if (src, "DROP") in at and (dst, "DROP") in at:
            assert at[src, "DROP"] < at[dst, "DROP"]


def test_fingerprints_reach_every_ancestor(spark):
    def tree(leaf, twins=2):
        rows = [("r", None, "DATABASE", "r", "")] + [(f"r{'.x' * d}", f"r{'.x' * (d - 1)}", "SCHEMA", "x", "") for d in range(1, 7)]
        rows += [(f"{rows[-1][0]}.{k}", rows[-1][0], "COLUMN", leaf, "") for k in range(twins)]
        return spark.createDataFrame(rows, "node string, parent string, obj_type string, name string, def string")

    assert diff.tree_diff(tree("a"), tree("a")).count() == 0
    assert {r.node for r in diff.tree_diff(tree("a", 1), tree("b", 1)).collect()} == {f"r{'.x' * d}" for d in range(7)} | {f"r{'.x' * 6}.0"}
    assert diff.tree_diff(tree("a", 2), tree("a", 4)).count() == 9  # equal children don't cancel
    circle = spark.createDataFrame([("a", "b", "SCHEMA", "a", ""), ("b", "a", "SCHEMA", "b", "")], "node string, parent string, obj_type string, name string, def string")
    with pytest.raises(ValueError, match="circle"):
        diff.fingerprints(circle)
