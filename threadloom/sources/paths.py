"""File listing through the session's Hadoop file systems (local, HDFS, object stores)."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob; an empty list when there are none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def exists(spark: SparkSession, pattern: str) -> bool:
    return bool(matching_files(spark, pattern))


def csv_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in the first line of a CSV file, or of the first file with a line in a folder
    that Spark wrote; only that line is read."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = matching_files(spark, f"{path}/part-*") if fs.getFileStatus(p).isDirectory() else [path]
    for file in files:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(file))
        try:
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()
        if line:
            return tuple(next(csv.reader([line.lstrip("﻿")])))
    return ()


def read_or_empty(spark: SparkSession, pattern: str, schema: T.StructType, read) -> DataFrame:
    """``read(files)``, or an empty frame of ``schema`` when nothing matches ``pattern``."""
    files = matching_files(spark, pattern)
    return read(files) if files else spark.createDataFrame([], schema)
