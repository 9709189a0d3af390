"""Catalog tables of a schema snapshot.

nodes(snapshot, node, parent, obj_type, schema, name, qname, owner, def) - objects, columns included;
columns(snapshot, tbl, ordinal, name, type, nullable); edges(src, dst, kind) - src depends on dst.
A snapshot of a data folder is derived from its Parquet schemas; foreign keys are the columns that name another table's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import TABLES, table

# Object kinds; a kind's place is its rank in plans.
KINDS = [
    "DATABASE", "SCHEMA", "EXTENSION", "FOREIGN_DATA_WRAPPER", "SERVER", "USER_MAPPING", "CAST", "ROLE", "USER", "ASSEMBLY", "TYPE", "DOMAIN", "COLLATION", "SEQUENCE", "FTS_PARSER", "FTS_TEMPLATE", "FTS_DICTIONARY",
    "FTS_CONFIGURATION", "OPERATOR", "FUNCTION", "PROCEDURE", "AGGREGATE", "TABLE", "DICTIONARY", "COLUMN", "CONSTRAINT", "INDEX", "STATISTICS", "VIEW", "RULE", "TRIGGER", "EVENT_TRIGGER", "POLICY",
]

#: Key columns of the tables, and the columns that refer to them.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id", "events": "event_id"}
REFERENCES = [
    ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"),
    ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("labels", "doc_id", "documents"),
]
#: Views of the snapshots: name -> tables and views that it reads.
VIEWS = {"revenue": ["lineitem", "orders"], "customers_by_region": ["customer", "nation", "region"], "top_customers": ["revenue", "customers_by_region"], "part_supply": ["part", "supplier", "lineitem"], "labelled": ["documents", "labels"]}


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i) for i, k in enumerate(KINDS)], "obj_type string, ordinal int")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, ordinal, name, type) of every table in the folder, from the Parquet schemas alone."""
    found = [(t, i, f.name, f.dataType.simpleString()) for t in TABLES for i, f in enumerate(table(spark, sf_dir, t).schema)]
    return spark.createDataFrame(found, "tbl string, ordinal int, name string, type string")


def changed(columns: DataFrame) -> DataFrame:
    """A later snapshot: some columns dropped, added, retyped, moved; a table dropped and one added."""
    kept = columns.filter("tbl <> 'benchmark' AND NOT (tbl = 'part' AND name = 'p_size')")
    typed = kept.withColumn("type", F.when((F.col("tbl") == "orders") & (F.col("name") == "o_totalprice"), "decimal(18,2)").when((F.col("tbl") == "nation") & (F.col("name") == "n_regionkey"), "bigint").otherwise(F.col("type")))
    moved = typed.withColumn("ordinal", F.when((F.col("tbl") == "supplier") & (F.col("ordinal") < 2), 1 - F.col("ordinal")).otherwise(F.col("ordinal")))
    new = columns.sparkSession.createDataFrame([("customer", 5, "c_phone", "string"), ("returns", 0, "ret_id", "bigint"), ("returns", 1, "ret_orderkey", "bigint")], columns.schema)
    return moved.unionByName(new)


def nodes(columns: DataFrame, view_names: list[str] | None = None) -> DataFrame:
    """(node, parent, obj_type, name, def): the schema, its tables, their columns, and views."""
    tables = columns.select("tbl").distinct()
    spark = columns.sparkSession
    one = spark.createDataFrame([("main", None, "SCHEMA", "main", "")], "node string, parent string, obj_type string, name string, def string")
    t = tables.select(F.concat(F.lit("main."), "tbl").alias("node"), F.lit("main").alias("parent"), F.lit("TABLE").alias("obj_type"), F.col("tbl").alias("name"), F.lit("").alias("def"))
    c = columns.select(F.concat(F.lit("main."), "tbl", F.lit("."), "name").alias("node"), F.concat(F.lit("main."), "tbl").alias("parent"), F.lit("COLUMN").alias("obj_type"), "name", F.concat_ws(":", "type", F.col("ordinal").cast("string")).alias("def"))
    views = [(f"main.{v}", "main", "VIEW", v, ",".join(reads)) for v, reads in VIEWS.items() if view_names is None or v in view_names]
    return one.unionByName(t).unionByName(c).unionByName(spark.createDataFrame(views, one.schema))


def edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, kind): children on parents, foreign keys, views on what they read; ends that don't exist and self edges are dropped."""
    spark = nodes.sparkSession
    up = nodes.filter("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"), F.lit("contains").alias("kind"))
    named = [(f"main.{t}.{c}", f"main.{r}.{KEYS[r]}", "foreign key") for t, c, r in REFERENCES] + [(f"main.{v}", f"main.{r}", "reads") for v, reads in VIEWS.items() for r in reads]
    wanted = spark.createDataFrame(named, "src string, dst string, kind string").filter("src <> dst").distinct()
    there = nodes.select("node")
    known = wanted.join(there.withColumnRenamed("node", "src"), "src", "left_semi").join(there.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return up.unionByName(known.select("src", "dst", "kind"))
