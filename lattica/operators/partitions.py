"""Partition numbers by range, list and hash, and partitions taken out of a table and put in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_number(value: Column, bounds: Sequence, right: bool = False) -> Column:
    """The number, from 1, of the range that value falls in. right: a bound belongs to the range above it. Null is in the first."""
    past = [F.when(value >= b if right else value > b, 1).otherwise(0) for b in bounds]
    return sum(past, F.lit(1))


def list_name(value: Column, lists: dict[str, Sequence], default: str | None = None) -> Column:
    """The name of the list that holds value, else the default partition's."""
    out = F.lit(default)
    for name, members in reversed(lists.items()):
        out = F.when(value.isin(list(members)), name).otherwise(out)
    return out


def hash_number(value: Column, modulus: int) -> Column:
    """The remainder of the first 32 bits of the MD5 of the value's text; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % modulus, F.lit(0))


def detached(df: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """(the table without the partition, the partition); rows of which the condition is unknown stay in the table."""
    here = F.coalesce(inside, F.lit(False))
    return df.filter(~here), df.filter(here)


def attached(df: DataFrame, part: DataFrame, inside: Column) -> DataFrame:
    """The table with the partition's rows; one that lies outside of the partition's bounds fails the query."""
    fits = F.when(F.coalesce(inside, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a row lies outside of the partition")).cast("boolean"))
    return df.unionByName(part.filter(fits))
