"""Fingerprints, tree diff, filter rules, selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.recursion import closure, kept, reverse


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(node, fp): hash of the object's own fields and of its children's, whatever their order; from the deepest level up, one join for each.

    A node whose parent is null or isn't there is a root. Children are summed, so equal ones don't cancel. Parents in a circle are an error.
    """
    own = kept(nodes.select("node", "parent", F.xxhash64("name", "obj_type", "def").alias("_own")))
    known = own.select(F.col("node").alias("parent"))
    levels, n = [kept(own.join(known, "parent", "left_anti").select("node", "parent", "_own"))], own.count()
    n -= levels[0].count()
    while n:
        above = levels[-1].select(F.col("node").alias("parent"))
        levels.append(kept(own.join(above, "parent").select("node", "parent", "_own")))
        if not (more := levels[-1].count()):
            raise ValueError(f"{n} objects are below no root: their parents form a circle")
        n -= more
    out, below = None, None
    for depth, level in enumerate(reversed(levels), 1):
        level = level.withColumn("_below", F.lit(None).cast("decimal(38,0)")) if below is None else level.join(below, "node", "left")
        level = level.select("node", "parent", F.xxhash64("_own", F.coalesce(F.col("_below").cast("string"), F.lit(""))).alias("fp"))
        if depth % 4 == 0:  # plans stay small
            level = kept(level)
        below = level.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("fp").cast("decimal(38,0)")).alias("_below"))
        out = level if out is None else level.unionByName(out)
        if depth % 8 == 0:
            out = kept(out)
    return out.select("node", "fp")


def ordered_fingerprint(columns: DataFrame, ignore_order: bool = False) -> DataFrame:
    """(tbl, fp): of a table's columns, in order or as a set."""
    h = F.xxhash64("name", "type")
    fp = F.bit_xor(h) if ignore_order else F.xxhash64(F.array_sort(F.collect_list(F.struct("ordinal", h.alias("h")))))
    return columns.groupBy("tbl").agg(fp.alias("fp"))


def side(left: Column, right: Column) -> Column:
    """BOTH, LEFT (only old) or RIGHT (only new)."""
    return F.when(left.isNotNull() & right.isNotNull(), "BOTH").when(left.isNotNull(), "LEFT").otherwise("RIGHT")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, parent, obj_type, side): objects that differ, matched by qualified name and kind; equal pairs are left out.

    A pair whose children differ differs as well.
    """
    a = old.join(fingerprints(old), "node").select("node", "obj_type", F.col("parent").alias("pa"), F.col("fp").alias("fa"))
    b = new.join(fingerprints(new), "node").select("node", "obj_type", F.col("parent").alias("pb"), F.col("fp").alias("fb"))
    both = a.join(b, ["node", "obj_type"], "full_outer").filter("fa IS NULL OR fb IS NULL OR fa <> fb")
    return both.select("node", F.coalesce("pa", "pb").alias("parent"), "obj_type", side(F.col("fa"), F.col("fb")).alias("side"))


def column_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tbl, name, side, old_type, new_type) of columns that were dropped, added or changed in type, in tables that both have."""
    shared = old.select("tbl").distinct().join(new.select("tbl").distinct(), "tbl", "left_semi")
    a = old.select("tbl", "name", F.col("type").alias("old_type"))
    b = new.select("tbl", "name", F.col("type").alias("new_type"))
    both = a.join(b, ["tbl", "name"], "full_outer").filter(~F.col("old_type").eqNullSafe(F.col("new_type")))
    return both.join(shared, "tbl", "left_semi").select("tbl", "name", side(F.col("old_type"), F.col("new_type")).alias("side"), "old_type", "new_type")


def attribute_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tbl, name, attribute, old_value, new_value): columns of both snapshots whose type or place differs, a row for each attribute."""
    values = lambda c, to: c.select("tbl", "name", F.explode(F.create_map(F.lit("type"), F.col("type"), F.lit("ordinal"), F.col("ordinal").cast("string"))).alias("attribute", to))
    both = values(old, "old_value").join(values(new, "new_value"), ["tbl", "name", "attribute"])
    return both.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def white_listed(nodes: DataFrame, schemas: list[str], patterns: list[str] = ()) -> DataFrame:
    """Objects of the schemas that a white list names, or whose whole name one of its patterns matches; schemas themselves are told by their own name."""
    schema = F.when(F.col("obj_type") == "SCHEMA", F.col("node")).otherwise(F.split("node", r"\.")[0])
    wanted = schema.isin(list(schemas))
    for p in patterns:
        wanted = wanted | schema.rlike(f"^(?:{p})$")
    return nodes.filter(wanted)


def reverted(diff: DataFrame) -> DataFrame:
    return diff.withColumn("side", F.when(F.col("side") == "LEFT", "RIGHT").when(F.col("side") == "RIGHT", "LEFT").otherwise(F.col("side")))


def changed_tables(diff: DataFrame, column_changes: DataFrame) -> DataFrame:
    """Table rows of the diff with a column change."""
    return diff.filter("obj_type = 'TABLE'").join(column_changes.select(F.concat(F.lit("main."), "tbl").alias("node")).distinct(), "node", "left_semi")


def flattened(diff: DataFrame, statuses: DataFrame, allowed: list[str] | None = None, only_edits: bool = False, edited: DataFrame | None = None) -> DataFrame:
    """Diff rows to act on: status ADD, kind allowed, and with only_edits of the rows on both sides only the edited ones."""
    out = diff.join(statuses.filter("status = 'ADD'").select("node"), "node", "left_semi").filter("obj_type <> 'DATABASE'")
    if allowed:
        out = out.filter(F.col("obj_type").isin(allowed))
    if only_edits and edited is not None:
        out = out.join(edited.select("node", F.lit(True).alias("_e")), "node", "left").filter("side <> 'BOTH' OR _e").drop("_e")
    return out


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """(node, n): size of the subtree below each object."""
    up = nodes.filter("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    return closure(up).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))


# --- rules --------------------------------------------------------------------------------------------------------

RULES = "ord int, pattern string, is_regex boolean, is_qualified boolean, types array<string>, is_show boolean, with_content boolean, db string"


def parse_rules(text: str) -> tuple[bool, list[tuple]]:
    """A rule list's text: (does it show what no rule names?, rows of RULES).

    First line `SHOW ALL` or `HIDE ALL`; then `SHOW|HIDE [NONE|CONTENT|REGEX|QUALIFIED,...] name [db=pattern] [type=A,B]`, a name in double
    or single quotes where it holds blanks. db: the rule counts only for databases whose whole name matches.
    """
    show_all, out = True, []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        if m := re.fullmatch(r"(SHOW|HIDE)\s+ALL", line, re.I):
            show_all = m[1].upper() == "SHOW"
            continue
        m = re.fullmatch(r'(SHOW|HIDE)\s+((?:(?:NONE|CONTENT|REGEX|QUALIFIED)(?:\s*,\s*|\s+))+)?(?:"((?:[^"]|"")*)"|\'((?:[^\']|\'\')*)\'|(\S+))(?:\s+db=(?:"([^"]*)"|\'([^\']*)\'|(\S+)))?(?:\s+type=(\S+))?', line, re.I)
        if not m:
            raise ValueError(f"not a rule: {line!r}")
        flags = {f.upper() for f in re.split(r"[\s,]+", m[2] or "") if f}
        name = m[3].replace('""', '"') if m[3] is not None else m[4].replace("\'\'", "\'") if m[4] is not None else m[5]
        db = next((x for x in (m[6], m[7], m[8]) if x is not None), None)
        out.append((len(out), name, "REGEX" in flags, "QUALIFIED" in flags, [t.upper() for t in m[9].split(",")] if m[9] else None, m[1].upper() == "SHOW", "CONTENT" in flags, db))
    return show_all, out


def merged_rules(rules: DataFrame) -> DataFrame:
    """One rule for each (pattern, types): the one with content wins, at equal width hiding wins."""
    w = Window.partitionBy("pattern", "is_regex", "is_qualified", "types", "db").orderBy(F.desc("with_content"), "is_show", "ord")
    return rules.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


#: Rules are written by people: more than this many are joined without a broadcast.
MOST_RULES = 10_000


def rule_statuses(nodes: DataFrame, rules: DataFrame, show_all: bool, db: str | None = None) -> DataFrame:
    """(node, status): ADD or SKIP.

    Of the rules that match an object a subtree rule beats a plain one, and hiding beats showing at the same width. An object without a match
    follows the nearest ancestor with a subtree rule, else the list's default. Below a hidden subtree everything is skipped.
    db: the database's name; rules for other databases don't count, and none that names one where db is None.
    """
    rules = rules.filter(F.col("db").isNull() | (F.lit(db).rlike(F.concat(F.lit("^(?:"), F.col("db"), F.lit(")$"))) if db is not None else F.lit(False)))
    text = F.when(F.col("is_qualified"), F.col("node")).otherwise(F.col("name"))
    hit = F.when(F.col("is_regex"), F.expr("CASE WHEN is_qualified THEN node ELSE name END RLIKE pattern")).otherwise(text == F.col("pattern"))
    kind = F.col("types").isNull() | F.array_contains("types", F.col("obj_type"))
    matched = nodes.join(F.broadcast(rules) if rules.limit(MOST_RULES + 1).count() <= MOST_RULES else rules, hit & kind)
    rank = F.col("with_content").cast("int") * 2 + (~F.col("is_show")).cast("int")
    best = matched.groupBy("node").agg(F.max_by(F.struct("is_show", "with_content"), rank).alias("b")).select("node", "b.*")
    up = nodes.filter("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    above = closure(up).join(best.filter("with_content").select(F.col("node").alias("dst"), F.col("is_show").alias("above")), "dst")
    inherited = above.groupBy(F.col("src").alias("node")).agg(F.min_by("above", "depth").alias("near"), F.bool_and("above").alias("open"))
    out = nodes.select("node").join(best, "node", "left").join(inherited, "node", "left")
    status = F.when(~F.coalesce("open", F.lit(True)), "SKIP").when(F.col("is_show").isNotNull(), F.when(F.col("is_show"), "ADD").otherwise("SKIP")).when(F.col("near"), "ADD").otherwise("ADD" if show_all else "SKIP")
    return out.select("node", status.alias("status"))


def extended_selection(diff: DataFrame, selected: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(node): the selection, what its new or edited objects need, and what needs its deleted objects, as far as it is in the diff."""
    chosen = diff.join(selected.select("node"), "node", "left_semi")
    need = closure(new_edges, chosen.filter("side <> 'LEFT'").select(F.col("node").alias("src"))).select(F.col("dst").alias("node"))
    users = closure(reverse(old_edges), chosen.filter("side = 'LEFT'").select(F.col("node").alias("src"))).select(F.col("dst").alias("node"))
    extra = need.unionByName(users).join(diff.select("node"), "node", "left_semi")
    return chosen.select("node").unionByName(extra).distinct()


def library_merge(main: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all objects, overrides): library objects that the database lacks are added; those it has otherwise are recorded."""
    key = ["node", "obj_type"]
    added = library.join(main.select(*key), key, "left_anti")
    differs = library.select(*key, F.col("def").alias("lib_def")).join(main.select(*key, "def"), key).filter("lib_def <> def")
    return main.unionByName(added.select(*main.columns)), differs.select(*key, "lib_def", "def")


def overridden(objects: DataFrame, overrides: DataFrame, column: str = "owner") -> DataFrame:
    """Owner or privileges from the override file where it names the object."""
    o = overrides.select("node", F.col(column).alias("_o"))
    return objects.join(o, "node", "left").withColumn(column, F.coalesce("_o", column)).drop("_o")
