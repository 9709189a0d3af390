"""Helpers shared by the training-data operators: the shared folder, written tables, text as bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: white space as the operators' contracts define it, `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and the master is local a folder of our own takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here and lost executors cost nothing."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def dropped(spark: SparkSession, *paths_or_tables) -> None:
    """Deletes written tables that no later step reads."""
    for x in paths_or_tables:
        path = x if isinstance(x, str) else getattr(x, "_lattica_path", None)
        if path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_bytes(col: str = "text"):
    """The text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def held_out(col: str, remainder: int):
    """crc32(doc_id as text) mod 5 is the remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 == remainder
