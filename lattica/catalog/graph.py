"""The dependency graph: reduction, cycles, reports, key matching."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.recursion import closure, reverse, tree_paths


def reduced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) with columns lifted to their tables; self edges and repeats are dropped."""
    lift = nodes.filter("obj_type = 'COLUMN'").select(F.col("node").alias("_n"), "parent")
    a = edges.join(lift.withColumnsRenamed({"_n": "src", "parent": "_s"}), "src", "left")
    b = a.join(lift.withColumnsRenamed({"_n": "dst", "parent": "_d"}), "dst", "left")
    return b.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst")).filter("src <> dst").distinct()


def with_custom(edges: DataFrame, nodes: DataFrame, custom: DataFrame) -> DataFrame:
    """Adds the user's edges whose both ends exist."""
    known = custom.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return edges.select("src", "dst").unionByName(known.select("src", "dst")).distinct()


def cycles_broken(edges: DataFrame, nodes: DataFrame, through: str = "FUNCTION", to: tuple[str, ...] = ("COLUMN", "TABLE")) -> DataFrame:
    """Drops the edges from objects of the kind `through`, which reach themselves, to kinds `to`."""
    own = closure(edges).filter("src = dst").select("src")
    kind = nodes.select("node", "obj_type")
    cyclic = own.join(kind.filter(F.col("obj_type") == through).withColumnRenamed("node", "src"), "src", "left_semi")
    bad = edges.join(cyclic, "src", "left_semi").join(kind.filter(F.col("obj_type").isin(*to)).withColumnRenamed("node", "dst"), "dst", "left_semi")
    return edges.join(bad.select("src", "dst"), ["src", "dst"], "left_anti")


def key_edges(foreign: DataFrame, keys: DataFrame) -> DataFrame:
    """(fk, key): foreign keys (fk, ref_table, ref_columns) on the unique keys (key, tbl, cols) whose column list is the referenced one."""
    return foreign.join(keys, (F.col("ref_table") == F.col("tbl")) & (F.col("ref_columns") == F.col("cols"))).select("fk", "key")


def inherited_column_edges(columns: DataFrame, inherits: DataFrame) -> DataFrame:
    """(src, dst): a child's column on the parent's column of the same name, up the whole chain. inherits: (child, parent)."""
    up = closure(inherits.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    mine = columns.select(F.col("tbl").alias("src"), "name")
    theirs = columns.select(F.col("tbl").alias("dst"), "name")
    return up.join(mine, "src").join(theirs, ["dst", "name"]).select(F.concat_ws(".", "src", "name").alias("src"), F.concat_ws(".", "dst", "name").alias("dst"))


def name_matches(nodes: DataFrame, pattern: str) -> DataFrame:
    """Objects whose whole name matches, cases ignored; the qualified name counts if the pattern has an escaped bracket or a quote."""
    of = "node" if re.search(r'\\\[|"|\\\(', pattern) else "name"
    return nodes.filter(F.col(of).rlike(f"(?i)^(?:{pattern})$"))


def report(edges: DataFrame, nodes: DataFrame, pattern: str, depth: int = 10, backwards: bool = False, types: list[str] | None = None, invert: bool = False) -> DataFrame:
    """(root, node, depth, path, cycle): the dependency tree below the matching objects. Kinds that are filtered out are walked, not shown."""
    start = name_matches(nodes, pattern).select(F.col("node").alias("src"))
    walk = tree_paths(reverse(edges) if backwards else edges, start, depth)
    kinds = nodes.select("node", "obj_type")
    out = walk.join(kinds, "node")
    if types:
        chosen = F.col("obj_type").isin(types)
        out = out.filter(~chosen if invert else chosen)
    return out.select("root", "node", "depth", F.array_join("path", " > ").alias("path"), "cycle")


def neighbourhood(edges: DataFrame, nodes: DataFrame, name: str, dropped: bool = False, connected: bool = False) -> DataFrame:
    """(node): what must exist to create the object, or what goes when it is dropped; only neighbours if connected."""
    flat = reduced(edges, nodes)
    flat = reverse(flat) if dropped else flat
    start = nodes.sparkSession.createDataFrame([(name,)], "src string")
    if connected:
        return flat.join(start, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return closure(flat, start).select(F.col("dst").alias("node"))


def group_by_key_edges(grouped: DataFrame, keys: DataFrame) -> DataFrame:
    """(query, key): a query that groups by all columns of a primary key depends on it. grouped: (query, tbl, cols array)."""
    return grouped.join(keys, "tbl").filter(F.size(F.array_except(keys["cols"], grouped["cols"])) == 0).select("query", "key")
