"""Overload and operator resolution, result types and column lineage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names that a select item without alias gets from its outermost form.
ITEM_NAMES = {"case": "case", "exists": "exists", "array": "array", "extract": "date_part", "coalesce": "coalesce", "greatest": "greatest", "least": "least", "row": "row"}


def resolve_calls(calls: DataFrame, candidates: DataFrame, casts: DataFrame) -> DataFrame:
    """(call, signature, returns): the best overload of each call.

    calls(call, name, args array), candidates(name, signature, params array, defaults int, returns), casts(source, target): implicit ones.
    Each argument must equal its parameter or be castable; missing ones need defaults. Most exact matches win, then the least signature.
    """
    pairs = calls.join(candidates, "name").filter((F.size("args") <= F.size("params")) & (F.size("args") >= F.size("params") - F.col("defaults")))
    each = pairs.select("call", "signature", "returns", "params", F.posexplode_outer("args").alias("pos", "arg")).withColumn("param", F.get("params", F.col("pos")))
    ok = each.join(casts.withColumnsRenamed({"source": "arg", "target": "param"}).withColumn("_cast", F.lit(True)), ["arg", "param"], "left")
    fits = ok.withColumn("_exact", (F.col("arg") == F.col("param")) | F.col("param").isin("any", "anyelement")).groupBy("call", "signature", "returns").agg(
        F.bool_and(F.coalesce(F.col("_exact") | F.coalesce("_cast", F.lit(False)), F.lit(True))).alias("_ok"), F.count_if("_exact").alias("exact")
    )
    best = Window.partitionBy("call").orderBy(F.desc("exact"), "signature")
    return fits.filter("_ok").withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("call", "signature", "returns")


def item_name(text: str) -> str:
    """The name of a select item: its alias, the column, what is cast, or that of its form; else ?column?."""
    text = text.strip()
    if m := re.search(r"(?i)\s+as\s+\"?(\w+)\"?$", text):
        return m[1]
    if m := re.match(r"(?i)cast\s*\((.*)\s+as\s+[^()]+(?:\([^)]*\))?\)$", text):
        return item_name(m[1])
    if m := re.match(r"(.*)::\s*[\w ]+(?:\([^)]*\))?(?:\[\])*$", text):
        return item_name(m[1])
    if m := re.match(r"(?i)(case|exists|array|extract|coalesce|greatest|least|row)\b", text):
        return ITEM_NAMES[m[1].lower()]
    if re.fullmatch(r"[\w.\"]+", text) and not re.fullmatch(r"[\d.]+", text):
        return text.split(".")[-1].strip('"')
    if m := re.match(r"([\w.]+)\s*\(.*\)$", text):
        return m[1].split(".")[-1].lower()
    return "?column?"


def result_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Ordered (name, type) of a query's result, as the analyzer gives them."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def lineage(spark, text: str) -> list[tuple[str, str]]:
    """(table, column) that a query reads: the scans of its physical plan hold exactly the columns that matter."""
    out = set()
    leaves = spark.sql(text)._jdf.queryExecution().sparkPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        place = re.search(r"/(\w+)\.parquet", leaf.relation().location().rootPaths().toString()) if leaf.nodeName().startswith("Scan parquet") else None
        columns = leaf.output()
        for j in range(columns.size()):
            out.add((place[1] if place else leaf.nodeName(), columns.apply(j).name()))
    return sorted(out)


def references(spark, texts: dict[str, str], columns: DataFrame) -> DataFrame:
    """(query, tbl, name): columns of known tables that queries name, by their words; an index, not an analysis."""
    q = spark.createDataFrame(list(texts.items()), "query string, text string")
    words = q.select("query", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\w]+"))).alias("word"))
    tables = words.join(columns.select(F.col("tbl").alias("word")).distinct(), "word").withColumnRenamed("word", "tbl")
    named = words.join(columns.select(F.col("name").alias("word"), "tbl"), "word").withColumnRenamed("word", "name")
    return named.join(tables, ["query", "tbl"], "left_semi").select("query", "tbl", "name")
