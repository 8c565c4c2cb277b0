"""JSON inputs: dataset documents and API feed dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from threadloom.constants import DATASET_DOCUMENT, FEED_COMMENT, FEED_POST
from threadloom.sources.logs import number_rows
from threadloom.sources.paths import read_or_empty

WITH_FILE = T.StructType([T.StructField("file", T.StringType()), *DATASET_DOCUMENT.fields])


def read_documents(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """Raw or harvest documents with their ``file``; no file is an empty frame.

    ``multi_line=False`` reads one document per line, which Spark can split.
    """
    def read(files):
        return spark.read.schema(DATASET_DOCUMENT).json(files, multiLine=multi_line).select(
            F.col("_metadata.file_path").alias("file"), *DATASET_DOCUMENT.names)

    return read_or_empty(spark, pattern, WITH_FILE, read)


def _feed(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    with_ord = T.StructType([*schema.fields, T.StructField("ord", T.LongType())])

    def read(files):
        rows = spark.read.schema(schema).json(files).select(
            *schema.names, F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"))
        return number_rows(rows, "ord")

    return read_or_empty(spark, pattern, with_ord, read)


def read_feed_posts(spark: SparkSession, pattern: str) -> DataFrame:
    """A dump of feed posts, one JSON object per line; ``ord`` is the place in the feed.

    The files of a dump follow each other by name, whatever tasks read them.
    """
    return _feed(spark, pattern, FEED_POST)


def read_feed_comments(spark: SparkSession, pattern: str) -> DataFrame:
    return _feed(spark, pattern, FEED_COMMENT)
