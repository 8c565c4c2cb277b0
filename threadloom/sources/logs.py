"""Console logs: lines with an exact number, also for files that are split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threadloom.functions.text import utrim

FILE_NAME = r"([^/]+)$"


def line_columns(source: Column | None = None) -> list[Column]:
    """Stripped line with its place: ``source, file, split, value``."""
    path = F.col("_metadata.file_path")
    return [
        (F.regexp_extract(path, FILE_NAME, 1) if source is None else source).alias("source"),
        path.alias("file"), F.col("_metadata.file_block_start").alias("split"),
        utrim(F.col("value")).alias("value"),
    ]


def read_lines(spark: SparkSession, path, source: Column | None = None) -> DataFrame:
    """``source, line_no, value``. ``source`` names the log; by default each file is one.

    A log that was rotated into several files is one source when ``source``
    maps its paths to one name (an expression over ``_metadata.file_path``);
    its files continue each other in name order.
    """
    raw = spark.read.text(path).select(*line_columns(source), F.monotonically_increasing_id().alias("seq"))
    return number_lines(raw)


def number_lines(raw: DataFrame) -> DataFrame:
    """``source, file, split, seq, value`` -> ``source, line_no, value``, 1-based."""
    return number_rows(raw, "line_no", ["source"]).select("source", (F.col("line_no") + 1).alias("line_no"), "value")


def number_rows(raw: DataFrame, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``out`` instead of ``file, split, seq``: the 0-based place of a row within ``keys``, by file name, then in the file.

    ``seq`` counts up inside a file split, so only the line counts of the splits
    must be added up: one narrow row per split, however long the log. Adaptive
    execution broadcasts their table when it is small, and no line moves; else the
    lines are shuffled by split, which bounds every group by the split size.
    """
    where = [*keys, "file", "split"]
    splits = raw.groupBy(*where).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*where, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return raw.join(starts, where).withColumn(
        out, F.col("start") + F.col("seq") - F.col("first")).drop("file", "split", "seq", "first", "start")
