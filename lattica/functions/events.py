"""Event sequences, time decay, sampling and downsampling per key."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_funnel(df: DataFrame, key: str, time: str, event: str, steps: Sequence[str], seconds: int) -> DataFrame:
    """(key, level): the longest run of steps, in order, that begins with steps[0] and ends within `seconds` of it.

    Each event of a step carries the latest start of a run that has reached it: running maxima over one sort, so a key's events are
    never held in one row and a hot key's spill.
    """
    known = df.filter(F.col(event).isin(list(steps))).select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(event).alias("_e"))
    before = Window.partitionBy(key).orderBy("_t", "_e").rowsBetween(Window.unboundedPreceding, -1)
    runs = known.withColumn("_s0", F.when(F.col("_e") == steps[0], F.col("_t")))
    for i, step in enumerate(steps[1:], 1):
        runs = runs.withColumn("_b", F.max(f"_s{i - 1}").over(before))
        runs = runs.withColumn(f"_s{i}", F.when((F.col("_e") == step) & (F.col("_t") - F.col("_b") <= seconds * 1_000_000), F.col("_b")))
    reached = F.greatest(F.lit(0), *(F.when(F.col(f"_s{i}").isNotNull(), i + 1) for i in range(len(steps))))
    levels = runs.groupBy(key).agg(F.max(reached).alias("level"))
    people = df.select(key).distinct()
    return people.join(levels, key, "left").select(key, F.coalesce("level", F.lit(0)).alias("level"))


def sequence_match(df: DataFrame, key: str, time: str, event: str, codes: dict[str, str], pattern: str) -> DataFrame:
    """(key, matched, times): a regular expression over each key's events in time order, one letter for each."""
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col(event)), F.lit("."))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time), code.alias("c")))), lambda s: s["c"]), "")
    return df.groupBy(key).agg(text.alias("_s")).select(key, F.col("_s").rlike(pattern).alias("matched"), F.regexp_count("_s", F.lit(pattern)).alias("times"))


def next_event(df: DataFrame, key: str, time: str, event: str, after: str) -> DataFrame:
    """(key, next): the event that follows the first `after`."""
    w = Window.partitionBy(key).orderBy(time)
    follows = df.withColumn("_n", F.lead(event).over(w)).filter(F.col(event) == after)
    return follows.groupBy(key).agg(F.min_by("_n", time).alias("next"))


def moving_average(df: DataFrame, key: str, time: str, value: str, half_life: float, name: str = "ema") -> DataFrame:
    """Exponentially weighted mean of all values up to each row; half_life in seconds. One pass over sums scaled to the key's first time."""
    w = Window.partitionBy(key).orderBy(time, value).rowsBetween(Window.unboundedPreceding, 0)
    t = (F.unix_micros(F.col(time).cast("timestamp")) - F.min(F.unix_micros(F.col(time).cast("timestamp"))).over(Window.partitionBy(key))) / 1e6
    weight = F.pow(F.lit(2.0), t / half_life)
    return df.withColumn("_w", weight).withColumn(name, F.sum(F.col(value) * F.col("_w")).over(w) / F.sum("_w").over(w)).drop("_w")


def sampled_lists(df: DataFrame, key: str, value: str, n: int, seed: int = 0) -> DataFrame:
    """(key, sample): n values of each key, those with the least seeded hash; heaps of n, not whole groups, are shuffled."""
    ranked = Window.partitionBy(key).orderBy(F.xxhash64(value, F.lit(seed)), value)
    return df.select(key, value).withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= n).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("sample"))


def downsampled(df: DataFrame, key: str, x: str, y: str, points: int) -> DataFrame:
    """(key, x, y): largest-triangle three-bucket downsampling of each key's series."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([x, y]).reset_index(drop=True)
        n = len(rows)
        if n <= points or points < 3:
            return rows[[key, x, y]]
        xs, ys = rows[x].to_numpy(float), rows[y].to_numpy(float)
        kept, a = [0], 0
        edges = [1 + (n - 2) * i // (points - 2) for i in range(points - 1)]
        for i in range(points - 2):
            low, high = edges[i], edges[i + 1]
            nx, ny = (xs[high : edges[i + 2]].mean(), ys[high : edges[i + 2]].mean()) if i + 2 < len(edges) else (xs[-1], ys[-1])
            area = abs((xs[a] - nx) * (ys[low:high] - ys[a]) - (xs[a] - xs[low:high]) * (ny - ys[a]))
            a = low + int(area.argmax())
            kept.append(a)
        return rows.loc[[*kept, n - 1], [key, x, y]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(key, x, y).groupBy(key).applyInPandas(pick, f"{key} {kinds[key]}, {x} {kinds[x]}, {y} {kinds[y]}")
