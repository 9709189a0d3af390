"""User-defined and statistical aggregates."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(df: DataFrame, keys: list[str], order: list[str], value: str, start: Column, step, finish=lambda x: x, name: str = "result") -> DataFrame:
    """A user aggregate given by state, transition and final function: a fold of each group's values in order."""
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_l"))
    return lists.select(*keys, F.aggregate("_l", start, lambda acc, x: step(acc, x["_v"]), finish).alias(name))


def mann_whitney(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """(u1, u2): rank sums of two samples, ties at their mean rank; ranks come from counts of equal values, not from a global sort."""
    from pyspark.sql import Window

    both = df.filter(F.col(group).isin(first, second))
    counts = both.groupBy(value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    from lattica.operators.joins import ranged

    ranked = ranged(counts, [value])
    below = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy("_p").agg(F.sum(F.col("a") + F.col("b")).alias("_n"), F.min(value).alias("_v"))
    offs = parts.select("_p", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    mid = ranked.withColumn("_b", F.coalesce(F.sum(F.col("a") + F.col("b")).over(below), F.lit(0))).join(F.broadcast(offs), "_p")
    rank = F.col("_o") + F.col("_b") + (F.col("a") + F.col("b") + 1) / 2
    sums = mid.agg(F.sum(rank * F.col("a")).alias("r"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    u1 = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.select(u1.alias("u1"), (F.col("n1") * F.col("n2") - u1).alias("u2"))


def analysis_of_variance(df: DataFrame, group: str, value: str) -> DataFrame:
    """(f): one-way F statistic, from each group's count, sum and sum of squares."""
    parts = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = parts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    return t.select(((between / (F.col("k") - 1)) / ((F.col("q") - F.col("b")) / (F.col("n") - F.col("k")))).alias("f"))


def information_value(df: DataFrame, category: str, label: str) -> DataFrame:
    """(category, iv): information value of each category for a 0/1 label."""
    parts = df.groupBy(category).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    totals = parts.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    a, b = F.col("p") / F.col("tp"), F.col("n") / F.col("tn")
    return parts.join(F.broadcast(totals)).select(category, F.when((F.col("p") > 0) & (F.col("n") > 0), (a - b) * F.log(a / b)).alias("iv"))


def geometric_mean(column: str) -> Column:
    """A grouped aggregate over Arrow batches."""
    import numpy as np

    @F.pandas_udf("double")
    def mean(values: pd.Series) -> float:
        v = values[values > 0]
        return float(np.exp(np.log(v).mean())) if len(v) else float("nan")

    return mean(column)
