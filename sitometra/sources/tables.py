"""Delimited files that stages exchange, every column text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text, missing ones empty. A byte-order mark before the first name is dropped; required columns must be there."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).na.fill("")
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return rows


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def candidate_jobs(candidates: DataFrame, max_docs: int = 0) -> DataFrame:
    """Candidates with DDB_ID and XML_RelPath trimmed, slashes forward, blank ones gone; the first max_docs by id and path, if any."""
    rows = candidates.withColumn("DDB_ID", F.trim("DDB_ID")).withColumn("XML_RelPath", F.translate(F.trim("XML_RelPath"), "\\", "/"))
    rows = rows.where("DDB_ID <> '' and XML_RelPath <> ''")
    return rows.orderBy("DDB_ID", "XML_RelPath").limit(max_docs) if max_docs > 0 else rows


def with_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with what files have on their XML_RelPath; jobs whose file is not there are left out."""
    return files.join(jobs, "XML_RelPath")


def missing_files(jobs: DataFrame, files: DataFrame, left: str = "XML_RelPath", right: str = "rel_path") -> DataFrame:
    """Jobs whose file is not there."""
    return jobs.join(files, jobs[left] == files[right], "left_anti")


def require_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def text_schema(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
