"""Contiguous shards of nearly equal bytes, from global prefix sums of the sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.llm.prefix_sums import PART, range_parts, sums_before
from threadloom.llm.registry import documents, query
from threadloom.session import stage_table


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put each document into one of ``shards`` contiguous ranges of ``id_col``, near equal in bytes.

    A document's size is the UTF-8 length of its text plus 1 (NULL text: 1). With all sizes laid end to end in the
    order of the ids, the line is cut into ``shards`` equal parts; a document goes where its middle lies. ``slot``
    counts from 0 within a shard. Only (id, size, checksum) is sorted, never a text.

    NULL ids come first; repeated rows are rows of their own, in adjacent slots; a document larger than a part
    leaves other shards short or empty; an empty table gives no rows. The checksum of a NULL text is that of ''.
    Other columns of ``docs`` are not read. Returns id, size, text_crc32, shard, slot.
    """
    narrow = stage_table(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32")), "shard-sizes")
    order = ["doc_id", "text_crc32", "size"]
    placed = sums_before(range_parts(narrow, order, "shard-ranges"), [], order,
                         {"before": F.col("size"), "index": F.lit(1).cast("long")})
    total = narrow.agg(F.sum("size").alias("total"))
    middle = (2 * F.col("before") + F.col("size")) / (2 * F.col("total"))
    cut = placed.join(F.broadcast(total)).withColumn(  # one row
        "shard", F.least(F.floor(middle * shards), F.lit(shards - 1)).cast("int"))
    first = cut.groupBy("shard").agg(F.min("index").alias("first"))
    return (cut.join(F.broadcast(first), "shard")  # one row per shard
            .withColumn("slot", F.col("index") - F.col("first"))
            .select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", "slot"))


@query("op1_sharding")
def sharding(spark, sf_dir) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), 16).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
