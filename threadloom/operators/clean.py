"""Cleaning: keep-first dedupe, placeholder purge, null fill, date repair, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.constants import PLACEHOLDERS, UNKNOWN_AUTHOR
from threadloom.functions.dates import (
    epoch_to_ts, repaired_date_text, standard_date_text, whole_number,
)
from threadloom.operators.ordering import keep_first

POST_KEYS = ("community", "post_id")
COMMENT_KEYS = ("community", "comment_id")

# Fill value by column, applied to the columns a frame has.
FILLS = {"title": "", "body": "", "text": "", "author": UNKNOWN_AUTHOR, "score": 0, "num_comments": 0}


def is_placeholder(*columns: Column) -> Column:
    """True where any column is exactly a deletion placeholder, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).isin(*PLACEHOLDERS), F.lit(False))
    return hit


def purge_placeholders(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [F.col(c) for c in columns if c in df.columns]
    return df.where(~is_placeholder(*present)) if present else df


def fill_missing(df: DataFrame) -> DataFrame:
    """Text fills for text columns; counts become whole numbers with 0 for missing."""
    filled = {}
    for name, value in FILLS.items():
        if name in df.columns:
            c = F.col(name) if isinstance(value, str) else whole_number(F.col(name))
            filled[name] = F.coalesce(c, F.lit(value))
    return df.withColumns(filled)


def epoch_column_to_ts(df: DataFrame) -> DataFrame:
    """Replace ``created_epoch`` by ``created_at`` in place; a bad epoch becomes NULL."""
    if "created_epoch" not in df.columns:
        return df
    return df.withColumn("created_epoch", epoch_to_ts(F.col("created_epoch"))).withColumnRenamed(
        "created_epoch", "created_at"
    )


def clean_posts(posts: DataFrame, keys: Sequence[str] = POST_KEYS, purge: bool = False) -> DataFrame:
    """Dedupe, fill, convert times. Deleted posts stay unless ``purge`` is set."""
    df = keep_first(posts, keys) if all(k in posts.columns for k in keys) else posts
    if purge:
        df = purge_placeholders(df, ("title", "body", "author"))
    return epoch_column_to_ts(fill_missing(df))


def clean_comments(comments: DataFrame, keys: Sequence[str] = COMMENT_KEYS) -> DataFrame:
    """Dedupe *before* the purge: a deleted first copy takes its live second copy with it."""
    df = keep_first(comments, keys) if all(k in comments.columns for k in keys) else comments
    return epoch_column_to_ts(fill_missing(purge_placeholders(df, ("text", "author"))))


def cleaning_metrics(df: DataFrame, kind: str, id_col: str, purge: bool) -> DataFrame:
    """Rows in, duplicates removed, placeholders purged and rows out per community.

    Two narrow aggregations: the purge test is a boolean before the first
    shuffle, and a hot id is pre-aggregated in its map tasks.
    """
    flag = is_placeholder(F.col("text"), F.col("author")) if purge else F.lit(False)
    per_id = (
        df.select("community", id_col, "ord", flag.alias("gone"))
        .groupBy("community", id_col)
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("gone", "ord").alias("gone"))
    )
    return (
        per_id.groupBy("community")
        .agg(
            F.sum("n").alias("rows_in"),
            F.sum(F.col("n") - 1).alias("duplicates_removed"),
            F.count_if("gone").alias("placeholders_purged"),
            F.count_if(~F.col("gone")).alias("rows_out"),
        )
        .select("community", F.lit(kind).alias("kind"), "rows_in", "duplicates_removed",
                "placeholders_purged", "rows_out")
    )


def harmonize_posts(df: DataFrame) -> DataFrame:
    """Repair pass over stored posts: merge the split date column, standardise dates, fill text.

    Works on the stored (renamed) sheet: ``created_at`` as text and, in drifted
    sheets, ``creationtimestamp`` holding raw epochs.
    """
    if "creationtimestamp" in df.columns:
        df = df.withColumn(
            "created_at", repaired_date_text(F.col("created_at"), F.col("creationtimestamp"))
        ).drop("creationtimestamp")
    return _standard_dates_and_text(df)


def harmonize_comments(df: DataFrame) -> DataFrame:
    return _standard_dates_and_text(df)


def _standard_dates_and_text(df: DataFrame) -> DataFrame:
    changes = {}
    if "created_at" in df.columns:
        changes["created_at"] = standard_date_text(F.col("created_at"))
    for name in ("title", "body", "text"):
        if name in df.columns:
            changes[name] = F.coalesce(F.col(name), F.lit(""))
    return df.withColumns(changes) if changes else df
