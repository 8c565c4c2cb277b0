"""Rows to annotator requests: ordinals, fixed-size batches, prompts, corpus sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from threadloom.constants import CORPUS_ROWS, SEGMENT, SWEEP_BATCH
from threadloom.functions.text import comment_text, id_text, post_text
from threadloom.operators.ordering import BLOCK, first_n, floor_div, with_ordinal

ROW_PROMPT_HEADER = (
    "Label each item below.\n"
    "sentiment is one of Positive, Negative, Neutral.\n"
    "toxicity is one of Low, Medium, High.\n"
    "topics is a short comma-separated list of key words.\n"
    'Answer with one JSON object {"results": [{"id", "sentiment", "toxicity", "topics"}, ...]} '
    "and repeat every id unchanged.\n"
    "Items:\n"
)

MACRO_PROMPT_HEADER = (
    "Read the sample of community posts below.\n"
    'Answer with one JSON object: "summary" is a text of three sentences on topics, tone and '
    'behaviour; "patterns" is a list of three recurring conversation patterns.\n'
    "Sample:\n"
)


def post_payload(posts: DataFrame) -> DataFrame:
    """Posts -> ``community, kind, id, text, ord``."""
    return posts.select(
        "community", F.lit("posts").alias("kind"), id_text(F.col("post_id")).alias("id"),
        post_text(F.col("title"), F.col("body")).alias("text"), "ord",
    )


def comment_payload(comments: DataFrame) -> DataFrame:
    return comments.select(
        "community", F.lit("comments").alias("kind"), id_text(F.col("comment_id")).alias("id"),
        comment_text(F.col("text")).alias("text"), "ord",
    )


def assign_batches(rows: DataFrame, size: int = SWEEP_BATCH, keys: Sequence[str] = SEGMENT,
                   mode: str = "exact", block: int = BLOCK) -> DataFrame:
    """Add ``batch_no`` and ``pos`` (place in the batch), in ``ord`` order per segment.

    ``exact`` numbers the batches of a segment 0, 1, 2 ... without gaps and costs
    a second shuffle when batches are gathered. ``partition`` starts a new batch
    at each block of ``ord``; the batches then stay on the partitioning of the
    blocks, so text is shuffled once. Its ``batch_no`` is unique but has gaps.
    """
    keys = list(keys)
    if mode == "exact":
        placed = with_ordinal(rows, keys, block=block)
        return (
            placed.withColumn("batch_no", floor_div("ord0", size))
            .withColumn("pos", (F.col("ord0") % size).cast("bigint")).drop("ord0")
        )
    if mode != "partition":
        raise ValueError(f"mode must be exact or partition, not {mode!r}")
    blocked = rows.withColumn("block", floor_div("ord", block))
    # a block is bounded, so its plain row number is too
    place = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("ord"))
    placed = blocked.withColumn("ord0", (place - 1).cast("bigint"))
    per_block = -(-block // size)
    return (
        placed.withColumn(
            "batch_no", F.col("block") * per_block + floor_div("ord0", size))
        .withColumn("pos", (F.col("ord0") % size).cast("bigint")).drop("ord0")
    )


def slice_batch(rows: DataFrame, n: int, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """The first ``n`` rows of each segment as its single batch 0."""
    head = first_n(rows, keys, F.col("ord"), n, rank="pos")
    return head.withColumn("pos", F.col("pos") - 1).withColumn("batch_no", F.lit(0).cast("bigint"))


def gather_requests(batched: DataFrame, keys: Sequence[str] = SEGMENT,
                    header: str = ROW_PROMPT_HEADER) -> DataFrame:
    """One row per batch: ordered ``members`` and the ``prompt``. Arrays are batch-sized."""
    group = [*keys, *(["block"] if "block" in batched.columns else []), "batch_no"]
    ordered = batched.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "text"))).alias("items"))
    line = lambda r: F.concat(F.lit("ID: "), r["id"], F.lit(" | Text: "), r["text"], F.lit("\n"))
    return ordered.select(
        *keys, "batch_no",
        F.col("items.id").alias("members"),
        F.concat(F.lit(header), F.array_join(F.transform("items", line), "")).alias("prompt"),
    )


def corpus_prompts(rows: DataFrame, n: int = CORPUS_ROWS, keys: Sequence[str] = SEGMENT,
                   header: str = MACRO_PROMPT_HEADER) -> DataFrame:
    """One prompt per segment over its first ``n`` texts, each with its 0-based place."""
    head = first_n(rows, keys, F.col("ord"), n, rank="rn")
    block = F.concat(F.lit("Content block ["), (F.col("rn") - 1).cast("string"), F.lit("]: "),
                     F.col("text"))
    return (
        head.select(*keys, "rn", block.alias("line"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("lines"))
        .select(*keys, F.concat(F.lit(header), F.array_join(F.col("lines.line"), "\n")).alias("prompt"))
    )
