"""Ordered migration plans: states, actions, merged alters, scripts, dangers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.catalog.model import kinds
from lattica.operators.recursion import closure, levels, reverse

#: Column type changes that keep the rows in place; any other change of a column recreates what depends on it.
WIDENING = [("int", "bigint"), ("smallint", "int"), ("float", "double"), ("date", "timestamp")]


def states(diff: DataFrame, column_changes: DataFrame) -> DataFrame:
    """(node, obj_type, state): CREATE, DROP, ALTER, ALTER_WITH_DEP (a column's type changes) or RECREATE (a changed view)."""
    widening = diff.sparkSession.createDataFrame([(f"{a}:{b}",) for a, b in WIDENING], "w string")
    typed = column_changes.filter("side = 'BOTH'").withColumn("w", F.concat_ws(":", "old_type", "new_type")).join(F.broadcast(widening), "w", "left_anti")
    typed = typed.select(F.concat(F.lit("main."), "tbl", F.lit("."), "name").alias("node"), F.lit(True).alias("_t"))
    state = F.when(F.col("side") == "LEFT", "DROP").when(F.col("side") == "RIGHT", "CREATE").when(F.col("_t"), "ALTER_WITH_DEP").when(F.col("obj_type") == "VIEW", "RECREATE").otherwise("ALTER")
    return diff.join(typed, "node", "left").select("node", "obj_type", state.alias("state"))


def recreated(plan: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """plan with views that depend on something dropped, recreated or altered with dependents turned into RECREATE, to the fixed point.

    The dependents of all starters are one closure, so the fixed point needs no loop over actions.
    """
    hard = plan.filter("state IN ('DROP', 'RECREATE', 'ALTER_WITH_DEP')").select(F.col("node").alias("src"))
    hit = closure(reverse(edges), hard).select(F.col("dst").alias("node")).distinct()
    views = hit.join(nodes.filter("obj_type IN ('VIEW', 'CONSTRAINT', 'INDEX')").select("node", "obj_type"), "node")
    forced = views.join(plan.filter("state IN ('DROP', 'CREATE')").select("node"), "node", "left_anti").select("node", "obj_type", F.lit("RECREATE").alias("state"))
    return plan.join(forced.select("node"), "node", "left_anti").unionByName(forced)


def ordered(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, phase, node, obj_type, state): drops first, dependents before what they need and later kinds first; then creations and alters by kind and
    level, the most edges to something that needs nothing. A recreation is a drop and a creation. Order within equals is by name: (phase, level, rank of the kind, name)."""
    spark = plan.sparkSession
    ranks = F.broadcast(kinds(spark))
    steps = plan.withColumn("action", F.explode(F.when(F.col("state") == "RECREATE", F.array(F.lit("DROP"), F.lit("CREATE"))).otherwise(F.array("state"))))
    steps = steps.join(levels(edges), "node", "left").join(ranks, "obj_type", "left").na.fill({"level": 0, "ordinal": 99})
    drop = F.col("action") == "DROP"
    keys = [
        F.when(drop, 0).otherwise(1).alias("phase"), F.when(drop, -F.col("level")).otherwise(F.col("level")).alias("by_level"), F.when(drop, -F.col("ordinal")).otherwise(F.col("ordinal")).alias("by_kind"),
    ]
    from lattica.operators.joins import numbered

    return numbered(steps.select("node", "obj_type", "action", *keys), ["phase", "by_level", "by_kind", "node", "action"], "seq").select("seq", "phase", "node", "obj_type", "action")


def merged_alters(actions: DataFrame) -> DataFrame:
    """(first, last, tbl, action, n): neighbouring alters of one table's columns as one statement. actions: (seq, tbl, action)."""
    w = Window.partitionBy("tbl").orderBy("seq")
    starts = actions.withColumn("_new", F.when((F.lag("seq").over(w) == F.col("seq") - 1) & (F.lag("action").over(w) == F.col("action")) & (F.col("action") == "ALTER"), 0).otherwise(1))
    islands = starts.withColumn("_i", F.sum("_new").over(w))
    return islands.groupBy("tbl", "_i").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.first("action").alias("action"), F.count("*").alias("n")).drop("_i")


def script(statements: DataFrame) -> DataFrame:
    """(place, phase, sql): statements (phase, seq, sql) in order, each text once in its phase, where it first stands."""
    once = statements.groupBy("phase", "sql").agg(F.min("seq").alias("seq"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("phase").orderBy("seq"))).select("phase", "place", "sql")


# Dangers and the statements that are ones.
DANGERS = {"DROP_TABLE": r"(?i)\bDROP\s+TABLE\b", "ALTER_COLUMN": r"(?i)\bALTER\s+COLUMN\b.*\bTYPE\b", "DROP_COLUMN": r"(?i)\bDROP\s+COLUMN\b", "RESTART_WITH": r"(?i)\bRESTART\s+WITH\b", "UPDATE": r"(?i)^\s*UPDATE\b"}


def dangers(statements: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """(sql, danger) of statements that are dangerous in a way that isn't allowed."""
    found = [F.when(F.col("sql").rlike(p), F.lit(d)) for d, p in DANGERS.items()]
    each = statements.select("sql", F.explode(F.array_compact(F.array(*found))).alias("danger"))
    return each.filter(~F.col("danger").isin(list(allowed))) if allowed else each


def statements(actions: DataFrame) -> DataFrame:
    """(phase, seq, sql) of ordered actions: the text of each change."""
    return actions.select("phase", "seq", F.concat_ws(" ", F.when(F.col("action").startswith("ALTER"), F.lit("ALTER")).otherwise(F.col("action")), "obj_type", "node").alias("sql"))


def moved_rows(old: DataFrame, new_columns: list[str], generated: list[str] = ()) -> DataFrame:
    """Rows of a recreated table: the columns that both have and that aren't generated."""
    return old.select(*(c for c in new_columns if c in old.columns and c not in generated))
