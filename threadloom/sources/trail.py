"""Append tables that hold each batch once: manifests name the files of published batches, readers take no others.

A batch is written to a folder of its own first and published by renaming one small file. Who repeats a batch (a stream
after a crash, a job that is run again) finds it published; what a failed attempt left is named by no manifest and so is
never read. The rename fails where the name is taken, on HDFS and local disks in one step; object stores without such
a rename need one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from threadloom.sources.paths import exists, matching_files

BATCH_NAME = re.compile(r"[A-Za-z0-9_-]+")


def batch_name(batch: int | str) -> str:
    """Numbers are padded, so that names have the order of the numbers."""
    name = f"{batch:012d}" if isinstance(batch, int) else batch
    if not BATCH_NAME.fullmatch(name):
        raise ValueError(f"a batch name has letters, digits, _ and - only, not {name!r}")
    return name


def _manifest(path: str, name: str) -> str:
    return f"{path}/_manifest/{name}.json"


def _publish(spark: SparkSession, text: str, target: str) -> bool:
    """Make ``target`` with this text, whole or not at all; False if it is there already."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    new = hadoop.Path(f"{target[:target.rindex('/')]}/.{uuid.uuid4().hex}")
    end = hadoop.Path(target)
    fs = end.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(end.toUri() if end.toUri().getScheme() else fs.getUri(),
                                                spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        context.rename(new, end, options)
        return True
    except Exception:  # the Java error: the name is taken, or the rename failed
        if not exists(spark, target):
            raise
        return False
    finally:
        fs.delete(new, False)


def append_once(df: DataFrame, path: str, batch: int | str, order: Sequence[str] = ()) -> bool:
    """Append ``df`` as ``batch``; False, without running ``df``, if that batch has been published.

    With ``order`` the rows lie in that order within the batch, sorted by range over many tasks.
    """
    spark, name = df.sparkSession, batch_name(batch)
    if exists(spark, _manifest(path, name)):
        return False
    folder = f"{name}-{uuid.uuid4().hex}"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.parquet(f"{path}/data/{folder}")
    return _publish(spark, json.dumps({"batch": name, "folder": folder, "schema": df.schema.json()}), _manifest(path, name))


def read_trail(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of all published batches, with ``batch`` and ``ord``: their place by batch name, then in the batch.

    The schema is that of the newest batch unless given; a trail without batches needs it.
    """
    manifests = matching_files(spark, f"{path}/_manifest/[!.]*.json")
    found = []
    if manifests:
        found = [json.loads(r.value) for r in spark.read.text(manifests, wholetext=True).collect()]
        found.sort(key=lambda m: m["batch"])
        schema = schema or T.StructType.fromJson(json.loads(found[-1]["schema"]))
    elif schema is None:
        raise ValueError(f"{path} has no batch yet: give a schema")
    if not found:
        return spark.createDataFrame([], T.StructType(
            [*schema.fields, T.StructField("batch", T.StringType()), T.StructField("ord", T.LongType())]))
    rows = spark.read.schema(schema).parquet(*[f"{path}/data/{m['folder']}" for m in found]).select(
        *schema.names, F.regexp_extract("_metadata.file_path", r"/data/([^/]+)-[0-9a-f]{32}/[^/]+$", 1).alias("batch"),
        F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("batch", "__file").agg(F.count(F.lit(1)).alias("n"))  # one narrow row per file
    earlier = Window.orderBy("batch", "__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("batch", "__file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    return rows.join(starts, ["batch", "__file"]).select(
        *[F.col(f"`{c}`") for c in schema.names], "batch", (F.col("__start") + F.col("__row")).alias("ord"))


def append_stream_once(df: DataFrame, path: str, checkpoint: str, order: Sequence[str] = (), once: bool = True):
    """Append each micro-batch of a stream once, whatever it takes to repeat one after a failure."""
    w = df.writeStream.foreachBatch(lambda batch, n: append_once(batch, path, n, order) and None)
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
