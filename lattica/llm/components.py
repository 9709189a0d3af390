"""Connected components by repeated contraction, and a small union-find for tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import dropped, written


class UnionFind(dict):
    """Vertices join by their least member; absent ones are their own root."""

    def find(self, x):
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while x != root:
            x, self[x] = self.get(x, x), root
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, component): for each vertex of an edge (a, b: long) that isn't the least of its component, that least vertex. Written.

    Each round hooks every vertex to its least smaller neighbour, shortens the chains thrice, and
    contracts the edges; every table it joins is written, so a vertex with very many edges is split by the skewed join.
    """

    def ordered(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    left = written(spark, ordered(edges), "edges")
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        hook = written(spark, left.groupBy("a").agg(F.min("b").alias("p")), "hooks")
        for _ in range(3):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            new = written(spark, hook.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "hooks")
            dropped(spark, hook)
            hook = new
        hooks.append(hook)
        at_a, at_b = hook.select("a", F.col("p").alias("pa")), hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = left.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        new = written(spark, ordered(moved), "edges")
        dropped(spark, left)
        left = new
    dropped(spark, left)
    if not hooks:
        return spark.createDataFrame([], "v long, component long")
    # a vertex hooked in some round follows the hooks of later rounds
    out = hooks[-1].select(F.col("a").alias("v"), F.col("p").alias("component"))
    for hook in reversed(hooks[:-1]):
        later = out.select(F.col("v").alias("p"), F.col("component").alias("c"))
        mine = hook.join(later, "p", "left").select(F.col("a").alias("v"), F.coalesce("c", "p").alias("component"))
        out = written(spark, mine.unionByName(out), "components")
    return out
