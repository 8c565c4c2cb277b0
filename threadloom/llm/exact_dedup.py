"""Exact de-duplication by sorting the texts themselves: equal texts become neighbours and are compared in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.registry import documents, query
from threadloom.session import stage_table

HEAD_CHARS = 64  # of a text, in the sampled splitters; a checksum of the whole text follows
HOT_PER_PARTITION = 4  # a text is hot if it fills a quarter of a mean partition: at most this many hot texts a partition


def same(text: Column) -> Column:
    return text


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 normalise: Callable[[Column], Column] = same) -> DataFrame:
    """A row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. Groups are rows of equal normalised text.

    The texts are sorted once. Sampled splitters over (first characters, checksum, slice) deal them to tasks, each
    task sorts externally by the whole text, and a group ends where two neighbours differ in full; a checksum alone
    never makes two texts equal. A text so frequent that it fills a quarter of a task is cut into slices, which other
    tasks take; exact counts of checksums say which texts those are, at most ``HOT_PER_PARTITION`` a partition, so the
    list has a bound at any size. The slices' results (one row each, the only ones that keep their text) are compared
    in full again and put together.

    Of a group the row with the largest id stays, exactly one of it where the row is repeated; a NULL id stays only
    where the group has no other, with keep_id NULL. NULL text counts as ''. A table without rows gives none. Other
    columns of ``docs``, whatever their names, are not read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(normalise(F.col(text_col)), F.lit("")).alias("text"))
    most = max(docs.count() // (HOT_PER_PARTITION * parts), 1)
    frequent = narrow.groupBy(F.xxhash64("text").alias("checksum")).count().where(F.col("count") > most)
    hot = [0, *[r.checksum for r in frequent.collect()]]  # never empty: a constant slice would cost one more shuffle
    slice_ = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(parts)).cast("int")
    keyed = narrow.withColumns({"head": F.substring("text", 1, HEAD_CHARS), "checksum": F.xxhash64("text")}).withColumn(
        "slice", F.when(F.col("checksum").isin(hot), slice_).otherwise(F.lit(-1)))
    place = ["head", "checksum", "slice"]
    alike = Window.partitionBy(*place, "text").orderBy(F.desc_nulls_last("doc_id"))
    whole = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The second window has the order of the first: it numbers the different texts of one place.
    found = keyed.repartitionByRange(parts, *place).withColumns({
        "nth": F.row_number().over(alike), "most_id": F.first("doc_id").over(whole), "rows": F.count("*").over(whole),
    }).withColumn("text_nth", F.dense_rank().over(Window.partitionBy(*place).orderBy("text"))).select(
        "doc_id", "checksum", "slice", "text_nth", "nth", "most_id", "rows", F.sha2("text", 256).alias("text_sha256"),
        F.when((F.col("slice") >= 0) & (F.col("nth") == 1), F.col("text")).alias("text"),
        F.when(F.col("slice") >= 0, F.xxhash64("head")).alias("head_checksum"))
    found = stage_table(found, "dedup-groups")
    name = ["head_checksum", "checksum", "slice", "text_nth"]
    by_slice = found.where("text is not null").withColumnRenamed("rows", "n")
    of_text = Window.partitionBy("text")
    first = F.row_number().over(of_text.orderBy(F.desc_nulls_last("most_id"), "slice"))
    merged = by_slice.select(
        *name, F.max("most_id").over(of_text).alias("all_id"), F.sum("n").over(of_text).alias("all_rows"),
        (first == 1).alias("has_kept"))
    return found.join(merged, name, "left").select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("all_rows").isNull(), F.col("most_id")).otherwise(F.col("all_id")).alias("keep_id"),
        F.coalesce("all_rows", "rows").cast("long").alias("group_size"),
        ((F.col("nth") == 1) & F.coalesce("has_kept", F.lit(True))).alias("kept"), "text_sha256")


EQUAL_SQL = """
SELECT doc_id, max(doc_id) OVER same_text AS keep_id, count(*) OVER same_text AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same_text AS (PARTITION BY coalesce(text, ''))
"""


@query("op12_exact_dedup", EQUAL_SQL)
def exact_dedup(spark, sf_dir) -> DataFrame:
    return equal_groups(documents(spark, sf_dir))
