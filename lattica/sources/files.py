"""File sources and sinks: COPY, external tables with rejects, SQL dumps, partitioned exports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import session


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{session.shared(spark)}/files-{uuid.uuid4().hex[:12]}"


def copy_to(df: DataFrame, path: str, header: bool = False, delimiter: str = ",", quote: str = '"', escape: str = '"', null: str = "") -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=delimiter, quote=quote, escape=escape, nullValue=null)


def copy_from(spark: SparkSession, path: str, schema: str, header: bool = False, delimiter: str = ",", quote: str = '"', escape: str = '"', null: str = "", on_error: str = "STOP", where: str | None = None) -> DataFrame:
    """COPY FROM: on_error IGNORE drops rows that don't fit the schema, STOP fails."""
    mode = "DROPMALFORMED" if on_error.upper() == "IGNORE" else "FAILFAST"
    df = spark.read.csv(path, schema=schema, header=header, sep=delimiter, quote=quote, escape=escape, nullValue=null, mode=mode)
    return df.filter(where) if where else df


def external_table(spark: SparkSession, path: str, schema: str, delimiter: str = ",", reject_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines); more rejects than the limit are an error."""
    read = spark.read.csv(path, schema=f"{schema}, _bad string", sep=delimiter, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    names = [c for c in read.columns if c != "_bad"]
    read = session.written(read.select(*names, "_bad"), "external")  # read once: a reject is told while all columns are parsed
    good, bad = read.filter("_bad IS NULL").select(*names), read.filter("_bad IS NOT NULL").select("_bad")
    if reject_limit is not None and (n := bad.count()) > reject_limit:
        raise ValueError(f"{n} rejected rows; {reject_limit} are allowed")
    return good, bad


def statements(text: str) -> list[str]:
    """A script's statements: semicolons in quotes, dollar quotes and comments don't end one."""
    out, start = [], 0
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|(\$\w*\$).*?\1|;", re.S)
    for m in token.finditer(text):
        if m[0] == ";":
            out.append(text[start : m.start()])
            start = m.end()
    out.append(text[start:])
    clean = (re.sub(r"(?s)--[^\n]*|/\*.*?\*/", "", s).strip() for s in out)
    return [s for s in clean if s]


_NAME = r'((?:"(?:[^"]|"")*"|[\w$]+)(?:\s*\.\s*(?:"(?:[^"]|"")*"|[\w$]+))*)'
_KIND = r"((?:MATERIALIZED\s+VIEW|FOREIGN\s+TABLE|EVENT\s+TRIGGER|\w+))"
_HEADS = [
    rf"(CREATE)\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:(?:UNIQUE|TEMP|TEMPORARY|UNLOGGED|RECURSIVE)\s+)*{_KIND}\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}",
    rf"(ALTER|DROP)\s+{_KIND}\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_NAME}",
    rf"(COMMENT)\s+ON\s+{_KIND}\s+{_NAME}",
    rf"(GRANT|REVOKE)\s+.*?\sON\s+(?:(TABLE|SEQUENCE|FUNCTION|PROCEDURE|SCHEMA|DATABASE|TYPE|VIEW)\s+)?{_NAME}",
    rf"(INSERT)\s+INTO\s+()?{_NAME}",
]


def head(statement: str) -> tuple[str | None, str | None, str | None]:
    """(action, kind, name) of a statement; a grant or an insert that says no kind is of a TABLE. Nones where the form isn't known."""
    for form in _HEADS:
        if m := re.match(form, statement, re.I | re.S):
            return m[1].upper(), re.sub(r"\s+", " ", m[2] or "TABLE").upper(), re.sub(r"\s*\.\s*", ".", m[3])
    return None, None, None


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, action, obj_type, name, sql): the statements of SQL files, one task for each file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(file, pos, *head(s), s) for file, text in zip(b["file"], b["value"], strict=True) for pos, s in enumerate(statements(text))]
            yield pd.DataFrame(rows, columns=["file", "pos", "action", "obj_type", "name", "sql"])

    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).selectExpr("_metadata.file_path AS file", "value")
    return texts.mapInPandas(parse, "file string, pos int, action string, obj_type string, name string, sql string")


def write_project(objects: DataFrame, path: str, dropped: DataFrame | None = None) -> None:
    """A folder for each kind and object (obj_type, name) with its text (sql). Objects that aren't given stay as they are, so changed ones alone
    make an update; those of `dropped` (obj_type, name) are emptied, which the reader takes for gone.
    """
    rows = objects.select(F.col("sql").alias("value"), "obj_type", "name")
    if dropped is not None:
        rows = rows.unionByName(dropped.select(F.lit("").alias("value"), "obj_type", "name"))
    rows.repartition("obj_type", "name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obj_type", "name").text(path)


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """(obj_type, name, sql) of the objects of a project folder."""
    texts = spark.read.schema("value string, obj_type string, name string").text(path, wholetext=True)
    return texts.select("obj_type", "name", F.regexp_replace("value", r"\n\z", "").alias("sql")).filter("sql <> ''")


def export(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder for each value of `by`; a later export replaces only the folders it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
