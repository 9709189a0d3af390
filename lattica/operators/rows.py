"""Row selection and ordering constructs that Spark SQL refuses: QUALIFY, DISTINCT ON, LIMIT BY, ties, fill, frames."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, value: Column, condition) -> DataFrame:
    """Rows for which condition(window value) holds."""
    return df.withColumn("_q", value).filter(condition(F.col("_q"))).drop("_q")


def limit_by(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column], offset: int = 0) -> DataFrame:
    """LIMIT [offset,] n BY keys. The window's rank filter lets Spark cut each group on the map side."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return qualify(df, rank, lambda r: (r <= n + offset) & (r > offset) if offset else r <= n)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return limit_by(df, 1, keys, order)


def final_rows(df: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """FINAL: the newest version of each key, by a grouped maximum (combined on the map side)."""
    rest = [c for c in df.columns if c not in set(keys)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def with_ties(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows and those that tie with the n-th: the n-th row's keys come from a top-n, the rest is a filter.

    order: SQL expressions, each with ASC (nulls first) or DESC (nulls last) after it, or neither.
    """
    parts = [_order(o) for o in order]
    names = [f"_o{i}" for i in range(len(parts))]
    keyed = df.withColumns({name: F.expr(text) for name, (text, _) in zip(names, parts, strict=True)})
    way = lambda back: [F.col(name).asc() if up != back else F.col(name).desc() for name, (_, up) in zip(names, parts, strict=True)]
    ends = keyed.select(*names).orderBy(*way(False)).limit(n)
    last = ends.orderBy(*way(True)).limit(1).select(F.struct(*names).alias("_last"))
    out = keyed.join(F.broadcast(last))
    before, tie = F.lit(False), F.lit(True)
    for name, (_, up) in zip(names, parts, strict=True):
        here, there = F.col(name), F.col(f"_last.{name}")
        first = (here.isNull() & there.isNotNull()) | (here < there) if up else (here.isNotNull() & there.isNull()) | (here > there)
        before, tie = before | (tie & F.coalesce(first, F.lit(False))), tie & here.eqNullSafe(there)
    return out.filter(before | tie).drop(*names, "_last")


def _order(text: str) -> tuple[str, bool]:
    """(expression, is it ascending?)."""
    m = re.fullmatch(r"(.*?)(?:\s+(ASC|DESC))?\s*", text, re.I | re.S)
    return m[1], (m[2] or "ASC").upper() == "ASC"


def top_percent(df: DataFrame, percent: float, order: Sequence[str]) -> DataFrame:
    """TOP p PERCENT: the first ceil(p * rows / 100) rows of a total order."""
    from lattica.operators.joins import numbered

    n = df.agg(F.ceil(F.count("*") * percent / 100).alias("_m"))
    return numbered(df, order, "_n").join(F.broadcast(n)).filter("_n <= _m").drop("_n", "_m")


def with_fill(df: DataFrame, key: str, start: Column, end: Column, step: Column, interpolate: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """ORDER BY key WITH FILL: a row for every step from start to before end; columns to interpolate take the last value before.

    by: gaps are filled within each of these keys.
    """
    grid = (df.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")).select(*by, F.explode(F.sequence(start, end, step)).alias(key))
    out = grid.join(df, [*by, key], "left")
    if interpolate and not by:
        from lattica.operators.joins import carried_forward

        return carried_forward(out, [key], list(interpolate))
    if interpolate:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in interpolate})
    return out


def fill_stale(df: DataFrame, key: str, step: Column, staleness: Column, by: Sequence[str] = ()) -> DataFrame:
    """WITH FILL STALENESS: after each row, rows for every step that lies before the next row and less than `staleness` away; their other columns are null."""
    if by:
        following = df.withColumn("_next", F.lead(key).over(Window.partitionBy(*by).orderBy(key)))
    else:
        from lattica.operators.joins import numbered

        keys = numbered(df.select(key).distinct(), [key], "_n")
        following = df.join(keys, key).join(keys.select((F.col("_n") - 1).alias("_n"), F.col(key).alias("_next")), "_n", "left").drop("_n")
    at = F.sequence(F.col(key), F.greatest(F.col(key), F.col(key) + staleness - step), step)
    out = following.withColumn("_at", F.explode(at)).filter(F.col("_next").isNull() | (F.col("_at") < F.col("_next")) | (F.col("_at") == F.col(key)))
    own = F.col("_at") == F.col(key)
    return out.select(*(F.col("_at").alias(c) if c == key else F.col(c) if c in by else F.when(own, F.col(c)).alias(c) for c in df.columns))


def groups_frame(df: DataFrame, value, by: Sequence[str], order: Sequence[Column], before: int, after: int, name: str) -> DataFrame:
    """value (an aggregate) over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: a range frame over the dense rank."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_g", F.dense_rank().over(w.orderBy(*order)))
    return ranked.withColumn(name, value.over(w.orderBy("_g").rangeBetween(-before, after))).drop("_g")


def sum_excluding(df: DataFrame, column: str, by: Sequence[str], order: Sequence[Column], exclude: str, name: str) -> DataFrame:
    """sum(column) over a whole partition, EXCLUDE CURRENT ROW, GROUP or TIES: frames combined by subtraction."""
    w = Window.partitionBy(*by)
    every = F.coalesce(F.sum(column).over(w), F.lit(0))
    peers = F.coalesce(F.sum(column).over(w.orderBy(*order).rangeBetween(0, 0)), F.lit(0))
    own = F.coalesce(F.col(column), F.lit(0))
    left = {"CURRENT ROW": every - own, "GROUP": every - peers, "TIES": every - peers + own}[exclude]
    return df.withColumn(name, left)


def count_excluding(df: DataFrame, by: Sequence[str], order: Sequence[Column], exclude: str, name: str) -> DataFrame:
    """count(*) over a whole partition, EXCLUDE CURRENT ROW, GROUP or TIES."""
    return sum_excluding(df.withColumn("_one", F.lit(1).cast("long")), "_one", by, order, exclude, name).drop("_one")


def avg_excluding(df: DataFrame, column: str, by: Sequence[str], order: Sequence[Column], exclude: str, name: str) -> DataFrame:
    """avg(column) over a whole partition, EXCLUDE CURRENT ROW, GROUP or TIES; null where nothing is left."""
    with_n = sum_excluding(df.withColumn("_there", F.col(column).isNotNull().cast("long")), "_there", by, order, exclude, "_n")
    with_s = sum_excluding(with_n, column, by, order, exclude, "_s")
    return with_s.withColumn(name, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))).drop("_there", "_n", "_s")


def star_apply(df: DataFrame, pattern: str, function) -> DataFrame:
    """COLUMNS('pattern') APPLY(function): the function of every column whose name matches, under the column's name."""
    return df.select(*(function(F.col(c)).alias(c) for c in df.columns if re.search(pattern, c)))


def formatted(df: DataFrame, kind: str) -> DataFrame:
    """FORMAT kind: one text column `line`. TSV and CSV: fields joined, null as \\N, CSV texts in double quotes; JSONEachRow: an object a row."""
    if kind == "JSONEachRow":
        return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    quote = lambda c, t: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if kind == "CSV" and t == "string" else F.col(c).cast("string")
    return df.select(F.concat_ws("," if kind == "CSV" else "\t", *(F.coalesce(quote(c, t), F.lit("\\N")) for c, t in df.dtypes)).alias("line"))


def column_statistics(df: DataFrame) -> DataFrame:
    """(name, rows, nulls, distinct_values, least, most) of every column, in one pass; least and most as text."""
    cells = [F.struct(F.lit(c).alias("name"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_values"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most")) for c in df.columns]
    return df.agg(F.array(*cells).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def sample_ratio(df: DataFrame, keys: Sequence[str], ratio: float, offset: float = 0.0) -> DataFrame:
    """SAMPLE ratio OFFSET offset: a fixed share of the keys' hash space (the first 32 bits of the MD5 of the keys' texts, joined by "|"), the same rows each time."""
    b = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.filter((b >= int(offset * (1 << 32))) & (b < int((offset + ratio) * (1 << 32))))
