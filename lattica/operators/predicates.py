"""Predicates that Spark SQL refuses, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    return x.between(F.least(a, b), F.greatest(a, b))


def similar_to(x: Column, pattern: str) -> Column:
    """SIMILAR TO: % and _ as in LIKE; | * + ? {m,n} ( ) [ ] as in regular expressions; whole string."""
    out = []
    inside = False
    for c in pattern:
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(c if inside or c in "|*+?{},()[]0123456789" and c not in "0123456789" else ".*" if c == "%" else "." if c == "_" else c if c.isalnum() or c in " ]" else "\\" + c)
    return x.rlike(f"^(?s:{''.join(out)})$")


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """(start, end) OVERLAPS (start, end): half-open periods, ends in either order; an instant overlaps where it lies."""
    la, ha, lb, hb = F.least(start_a, end_a), F.greatest(start_a, end_a), F.least(start_b, end_b), F.greatest(start_b, end_b)
    return ((la < hb) & (lb < ha)) | (la == lb)


def compared_to_all(df: DataFrame, column: str, op: str, values: DataFrame, of: str, quantifier: str = "ALL") -> DataFrame:
    """Rows with column op ALL/ANY (values.of): one aggregate row of the other side is broadcast.

    Nulls as in SQL: op ALL over an empty set keeps every row; a null among the values keeps no row that would need it.
    """
    ends = values.agg(F.min(of).alias("_min"), F.max(of).alias("_max"), F.count("*").alias("_n"), F.count(of).alias("_known"))
    x = F.col(column)
    strict = {">": ("_max", "_min"), ">=": ("_max", "_min"), "<": ("_min", "_max"), "<=": ("_min", "_max")}[op]
    bound = F.col(strict[0] if quantifier == "ALL" else strict[1])
    holds = {">": x > bound, ">=": x >= bound, "<": x < bound, "<=": x <= bound}[op]
    keep = ((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & holds)) if quantifier == "ALL" else holds
    return df.join(F.broadcast(ends)).filter(keep).drop("_min", "_max", "_n", "_known")


def text_match(x: Column, words: list[str], every: bool = True) -> Column:
    """CONTAINS / @@: do the words stand in the text, cases ignored?"""
    tokens = F.split(F.lower(x), r"[^\p{L}\p{N}]+")
    hits = [F.array_contains(tokens, w.lower()) for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = out & h if every else out | h
    return out
