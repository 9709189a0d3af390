"""Joins that Spark SQL has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.recursion import kept


def any_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column], how: str = "left") -> DataFrame:
    """At most one match for each left row: the right side is cut to its first row of each key by `order` before the join.

    The cut is a grouped minimum of a struct, so it is combined on the map side and a hot key costs one row for each task.
    """
    keys = set(on)
    rest = [c for c in right.columns if c not in keys]
    first = right.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return left.join(first.select(*on, "_r.*"), list(on), how)


def lateral_top(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: Sequence[Column], n: int) -> DataFrame:
    """LATERAL (... WHERE right_key = left_key ORDER BY order LIMIT n): each left row with the first n right rows of its key; those without any go.

    Spark's own rewrite numbers a key's rows in the order in which they arrive after a shuffle, whatever the ORDER BY; here the window has the
    order. Its limit is applied before the shuffle too, so a hot key costs n rows for each task.
    """
    w = Window.partitionBy(right_key).orderBy(*order)
    first = right.filter(F.col(right_key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
    return left.join(first, F.col(left_key) == F.col(right_key))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], how: str = "left", bucket: float | None = None) -> DataFrame:
    """For each left row the right row of the same key with the greatest time not after its own.

    One union and one window: no row meets more than its own key's rows once, unlike a join on an inequality. Of right rows
    with one time, the one with the greatest values wins. Null keys and times match nothing.

    bucket: a length of time (seconds, or the unit of whole-number times) by which a key's rows are split, for keys too hot for one task.
    Each bucket that has left rows then also gets the last value before it, from one row for each key and bucket.
    """
    none = F.lit(None)
    known = right.filter(F.col(right_time).isNotNull())
    for k in by:
        known = known.filter(F.col(k).isNotNull())
    lefts = left.select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), none.cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_value"))
    rights = known.select(*by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), none.cast(lefts.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"))
    keys = list(by)
    if bucket is not None:
        lefts, rights = (df.withColumn("_bucket", _bucket(df, "_time", bucket)) for df in (lefts, rights))
        keys.append("_bucket")
        ends = rights.groupBy(*keys).agg(F.max_by("_value", F.struct("_time", "_value")).alias("_end"), F.lit(False).alias("_asked"))
        asked = lefts.filter("_bucket IS NOT NULL").select(*keys, none.cast(ends.schema["_end"].dataType).alias("_end"), F.lit(True).alias("_asked")).distinct()
        buckets = ends.unionByName(asked).groupBy(*keys).agg(F.max("_end").alias("_end"), F.bool_or("_asked").alias("_asked"))
        before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = buckets.withColumn("_value", F.last("_end", ignorenulls=True).over(before)).filter("_asked AND _value IS NOT NULL")
        rights = rights.unionByName(carried.select(*keys, none.cast(rights.schema["_time"].dataType).alias("_time"), F.lit(0).alias("_side"), none.cast(lefts.schema["_row"].dataType).alias("_row"), "_value"))
    w = Window.partitionBy(*keys).orderBy("_time", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    out = lefts.unionByName(rights).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    if how == "inner":
        out = out.filter("_last IS NOT NULL")
    return out.select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def _bucket(df: DataFrame, time: str, width: float) -> Column:
    """The number of the bucket of a time; its seconds, if it is a date or a timestamp."""
    kind = dict(df.dtypes)[time]
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000 if kind == "date" or kind.startswith("timestamp") else F.col(time)
    return F.floor(t / width)


def paste_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows side by side by position, as many as the shorter side has.

    Positions are numbered without a global window: rows are sorted by range, and each partition adds its offset.
    """
    a, b = numbered(left, left_order, "_n"), numbered(right, right_order, "_n")
    return a.join(b, "_n").drop("_n")


def ranged(df: DataFrame, order: Sequence[str], name: str = "_p") -> DataFrame:
    """df dealt by range of the given columns, with the number of each row's range; kept, since a second sampling could deal otherwise."""
    return kept(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with its row number from 1 in the given total order; only one count for each range meets in one task."""
    rows = ranged(df, order)
    counts = rows.groupBy("_p").count()
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_i", inside).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def sequence_values(df: DataFrame, order: Sequence[str], name: str, start: int = 1, increment: int = 1) -> DataFrame:
    """NEXT VALUE FOR a sequence, in a total order, without a global window."""
    return numbered(df, order, name).withColumn(name, F.lit(start) + (F.col(name) - 1) * increment)


def carried_forward(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with nulls of the columns replaced by the last value before, in the given order; one row for each range meets in one task."""
    rows = ranged(df, order)
    at = F.struct(*order)
    ends = rows.groupBy("_p").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_end_{i}") for i, c in enumerate(columns)))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_p", *(F.last(f"_end_{i}", ignorenulls=True).over(before).alias(f"_end_{i}") for i in range(len(columns))))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_in_{i}": F.last(c, ignorenulls=True).over(inside) for i, c in enumerate(columns)}).join(F.broadcast(ends), "_p")
    return out.select(*(F.coalesce(f"_in_{columns.index(c)}", f"_end_{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns))


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= value < high, by buckets of the given width instead of a nested loop.

    Each right row goes to every bucket that its range touches; the exact condition is checked in the bucket.
    """
    l_ = left.withColumn("_b", F.floor(F.col(value) / width))
    r_ = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return l_.join(r_, "_b").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_b")


def array_join(df: DataFrame, columns: dict[str, str], outer: bool = False) -> DataFrame:
    """ARRAY JOIN: one row for each position of the named arrays (array column: alias), shorter ones padded with null."""
    zipped = F.arrays_zip(*columns)
    rows = df.withColumn("_z", F.explode_outer(zipped) if outer else F.explode(zipped))
    for source, alias in columns.items():
        rows = rows.withColumn(alias, F.col(f"_z.{source}"))
    return rows.drop("_z")
