"""Table changes as DataFrame algebra: the new table, and the changes (RETURNING / OUTPUT)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: of source rows with one key, one is taken."""
    new = source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new.select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE with the source's values."""
    return merge(target, source, keys, matched={c: F.col(f"s.{c}") for c in target.columns if c not in set(keys)}, not_matched={c: F.col(f"s.{c}") for c in target.columns})[0]


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM: values may name t.<column> and s.<column>; source has one row for each key."""
    return merge(target, source, keys, matched=values)[0]


def delete_using(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(source.select(*keys), list(keys), "left_anti")


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], matched: dict[str, Column] | None = None, matched_delete: Column | None = None, not_matched: dict[str, Column] | None = None, by_source_delete: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new table, changes with _action). One full outer join on the keys.

    matched: new values; matched_delete: which matched rows go instead; not_matched: the row to insert; by_source_delete: which
    target rows without a source row go.
    """
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    on = None
    for k in keys:
        here = F.col(f"t.{k}") == F.col(f"s.{k}")
        on = here if on is None else on & here
    both = t.join(s, on, "full_outer")
    is_match = F.col("t._t").isNotNull() & F.col("s._s").isNotNull()
    only_t, only_s = F.col("s._s").isNull(), F.col("t._t").isNull()
    action = F.when(is_match & (matched_delete if matched_delete is not None else F.lit(False)), "DELETE")
    if matched:
        action = action.when(is_match, "UPDATE")
    if not_matched:
        action = action.when(only_s, "INSERT")
    if by_source_delete is not None:
        action = action.when(only_t & by_source_delete, "DELETE")
    out = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        value = F.when(F.col("_action") == "UPDATE", matched[c]).otherwise(old) if matched and c in matched else old
        if not_matched and c in not_matched:
            value = F.when(F.col("_action") == "INSERT", not_matched[c]).otherwise(value)
        out.append(value.alias(c))
    rows = both.withColumn("_action", action).filter(~only_s | (F.col("_action") == "INSERT")).select(*out, "_action")
    return rows.filter("_action IS NULL OR _action <> 'DELETE'").select(*target.columns), rows.filter("_action IS NOT NULL")


def replace_partitions(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """REPLACE PARTITION: the new rows' partitions take the place of the old ones."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
