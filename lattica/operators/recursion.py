"""Closures over edges and levels of a graph.

A graph of at most SMALL edges (counted first) goes to the workers whole, and each task walks its share of the start nodes. A larger one is walked level
by level with joins; each level is a written table, and known pairs aren't walked again.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import written

#: Edges of a graph that is broadcast: a few MB.
SMALL = 50_000
#: Pairs of a batch that a task hands on.
BATCH = 10_000


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again."""
    return written(df, "level")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, start: DataFrame | None = None, most: int | None = None, small: int = SMALL) -> DataFrame:
    """(src, dst, depth): every node reachable from src over one edge or more, with the least number of edges.

    edges: (src, dst), edges with a null end don't count. start: (src) to walk from, all nodes if None. Cycles end where nothing new is found.
    most: walks of more edges aren't asked for; None: to the end, however deep.
    """
    edges = kept(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    starts = (edges if start is None else edges.join(start.select("src").distinct(), "src", "left_semi")).select("src").distinct()
    if edges.count() <= small:
        return _walked(edges, starts, most)
    step = edges.withColumnsRenamed({"src": "_at", "dst": "_to"})
    front = kept(edges.join(starts, "src", "left_semi").select("src", "dst", F.lit(1).alias("depth")))
    levels, found, depth = [front], front, 1
    while (most is None or depth < most) and not front.isEmpty():
        depth += 1
        reached = front.join(step, front["dst"] == step["_at"]).select("src", F.col("_to").alias("dst")).distinct()
        front = kept(reached.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        levels.append(front)
        found = front.unionByName(found)
        if depth % 8 == 0:  # plans stay small
            found = kept(found)
    return found


def _walked(edges: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
    """The closure of a small graph: breadth first from each start node of a task."""
    at: dict = {}
    for a, b in zip(*(c.to_pylist() for c in edges.select("src", "dst").toArrow().columns), strict=True):
        at.setdefault(a, []).append(b)
    sent = edges.sparkSession.sparkContext.broadcast(at)
    kind = edges.schema["src"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for src in b.column(0).to_pylist():
                depth = {dst: 1 for dst in sent.value.get(src, ())}
                open_ = deque(depth)
                while open_:
                    node = open_.popleft()
                    if most is not None and depth[node] >= most:
                        break
                    for dst in sent.value.get(node, ()):
                        if dst not in depth:
                            depth[dst] = depth[node] + 1
                            open_.append(dst)
                out += [(src, dst, d) for dst, d in depth.items()]
                while len(out) >= BATCH:
                    yield batch(out[:BATCH], b.schema[0].type)
                    del out[:BATCH]
            if out:
                yield batch(out, b.schema[0].type)
                out = []

    def batch(rows: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
        src, dst, depth = zip(*rows, strict=True)
        return pa.record_batch([pa.array(src, type_), pa.array(dst, type_), pa.array(depth, pa.int32())], ["src", "dst", "depth"])

    return starts.mapInArrow(walk, f"src {kind}, dst {kind}, depth int")


def shortest_paths(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst, hops) of the shortest path."""
    return closure(edges, start, most).select("src", "dst", F.col("depth").alias("hops"))


def tree_paths(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node, depth, path, cycle): every path downwards; a node met again on its own path is marked and not followed, so paths end.

    most: deeper nodes aren't asked for.
    """
    front = roots.select(F.col("src").alias("root"), F.col("src").alias("node"), F.lit(0).alias("depth"), F.array("src").alias("path"), F.lit(False).alias("cycle"))
    out = front = kept(front)
    step = kept(edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct())
    depth = 0
    while most is None or depth < most:
        depth += 1
        walked = front.filter("not cycle").join(step, F.col("node") == F.col("_at"))
        front = kept(walked.select("root", F.col("_to").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("_to")).alias("path"), F.array_contains("path", F.col("_to")).alias("cycle")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
        if depth % 8 == 0:
            out = kept(out)
    return out


def levels(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, level): the most edges of a path that begins at the node; 0 where it needs nothing. So src is always above dst.

    In a cycle some edge can't count: where every node left needs another one that is left, the least of them is placed as if it
    needed none of these.
    """
    edges = kept(edges.select("src", "dst").filter("src <> dst").distinct())
    if edges.count() <= small:
        return _peeled(edges)
    left = edges
    nodes = kept(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    placed, level = [], 0
    while not nodes.isEmpty():
        free = nodes.join(left.select(F.col("src").alias("node")), "node", "left_anti")
        free = kept(free.withColumn("level", F.lit(level)))
        if free.isEmpty():
            free = kept(nodes.agg(F.min("node").alias("node")).withColumn("level", F.lit(level)))
        placed.append(free)
        gone = free.select("node")
        nodes = kept(nodes.join(gone, "node", "left_anti"))
        left = kept(left.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"))
        level += 1
        if len(placed) >= 8:
            done = placed[0]
            for p in placed[1:]:
                done = done.unionByName(p)
            placed = [kept(done)]
    if not placed:
        return edges.select(F.col("src").alias("node"), F.lit(0).alias("level")).limit(0)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def _peeled(edges: DataFrame) -> DataFrame:
    """The levels of a small graph, found on the driver."""
    need: dict = {}
    users: dict = {}
    for a, b in zip(*(c.to_pylist() for c in edges.select("src", "dst").toArrow().columns), strict=True):
        need.setdefault(a, set()).add(b)
        need.setdefault(b, set())
        users.setdefault(b, []).append(a)
    out, level, left = [], 0, set(need)
    free = [n for n in left if not need[n]]
    while left:
        free = sorted(free) or [min(left)]
        out += [(n, level) for n in free]
        left.difference_update(free)
        after = set()
        for n in free:
            for u in users.get(n, ()):
                need[u].discard(n)
                if u in left and not need[u]:
                    after.add(u)
        free, level = list(after), level + 1
    return edges.sparkSession.createDataFrame(out, f"node {edges.schema['src'].dataType.simpleString()}, level int")
