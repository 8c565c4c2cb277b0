"""Sinks: CSV, partitioned tables, append tables, JSON documents, text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from threadloom.constants import (
    BANNER_RULE, RAW_COMMENT_FIELDS, RAW_POST_FIELDS, SECTION_END, SECTION_START, SEGMENT,
)
from threadloom.functions.dates import ts_to_text
from threadloom.operators.harvest import export_lines
from threadloom.sources.trail import append_once


def write_csv(df: DataFrame, path: str, raw_names: dict[str, str] | None = None) -> None:
    """Overwrite as CSV with a header; times as text; ``raw_names`` maps column -> header."""
    out = df.withColumns({
        f.name: ts_to_text(F.col(f.name)) for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))
    })
    if raw_names:
        out = out.select(*[F.col(c).alias(n) for c, n in raw_names.items() if c in out.columns])
    # an empty text is an empty cell and outer blanks stay, as pandas writes them
    out.write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def sheet_headers(kind: str) -> dict[str, str]:
    """Column -> header of a cleaned posts or comments sheet."""
    fields = RAW_POST_FIELDS if kind == "posts" else RAW_COMMENT_FIELDS
    return {("created_at" if n == "created_epoch" else n): raw for raw, n in fields.items()}


def write_segments(df: DataFrame, path: str, keys: Sequence[str] = SEGMENT, fmt: str = "parquet",
                   mode: str = "overwrite", touched_only: bool = False) -> None:
    """One folder per segment; readers prune by it.

    Rows are rebalanced by segment first: a segment gets few files, and a
    segment with a large share of the rows is split over many tasks. With
    ``touched_only`` segments without rows in ``df`` stay as they are.
    """
    writer = df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).format(fmt)
    writer = writer.option("partitionOverwriteMode", "dynamic" if touched_only else "static")
    (writer.options(header=True, quote='"', escape='"', emptyValue="") if fmt == "csv" else writer).save(path)


SHEET_KEYS = ["sheet", *SEGMENT, "model"]
LABEL_SHEETS, MACRO_SHEETS = ("sentiment", "toxicity", "topics"), ("summary", "patterns")


def write_annotations(annotations: DataFrame, macro: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """The five result sheets of all segments in one job: one folder per sheet, community, kind and model.

    Each row is read once and becomes one row ``id, value`` per sheet, and all sheets go through one write.
    Only segments that have rows here are written anew; a repeated job changes nothing.
    """
    keys = [*SEGMENT, "model"]

    def rows(df: DataFrame, names, key) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("sheet"), key.alias("id"), F.col(n).alias("value")) for n in names])
        return df.select(*keys, F.inline(cells))

    both = rows(annotations, LABEL_SHEETS, F.col("id")).unionByName(rows(macro, MACRO_SHEETS, F.lit(None).cast("string")))
    write_segments(both, folder, SHEET_KEYS, fmt, touched_only=True)


def read_sheet(spark: SparkSession, folder: str, sheet: str) -> DataFrame:
    """One sheet of ``write_annotations``: ``community, kind, model, id`` and its value; other sheets aren't opened."""
    schema = ", ".join(f"{c} string" for c in ("id", "value", *SHEET_KEYS))
    found = spark.read.schema(schema).parquet(folder).where(F.col("sheet") == sheet)
    return found.select(*SEGMENT, "model", *(["id"] if sheet in LABEL_SHEETS else []), F.col("value").alias(sheet))


def append_audit(audit: DataFrame, path: str, batch: int | str, order: Sequence[str] = ()) -> bool:
    """Append audit rows to the trail as ``batch``; a batch that is there already is left as it is (False)."""
    return append_once(audit, path, batch, order)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.write.mode("overwrite").options(ignoreNullFields="false").json(path)


def write_report(lines: DataFrame, path: str, order: Sequence[str], keys: Sequence[str] = ()) -> None:
    """Text files whose concatenation in name order is the report.

    The lines are range-partitioned and sorted, so a report of any size is
    written by many tasks; with ``keys`` there is one folder per report.
    """
    sort = [*keys, *order]
    ordered = lines.repartitionByRange(*sort).sortWithinPartitions(*sort)
    out = ordered.select(*keys, F.col("line").alias("value"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def export_log(posts: DataFrame, comments: DataFrame, target: Column, keys: Sequence[str] = ()) -> DataFrame:
    """All lines of a console export, ``keys, section, ord, line``: banners and prefixed JSON.

    Each group of ``keys`` is one session between a start and an end banner that
    name ``target``, so the export has finished sessions when it is read again.
    """
    keys = list(keys)
    banner = lambda word: F.concat(
        F.lit(f"{BANNER_RULE} {word} STREAM HARVEST: r/"), F.coalesce(target, F.lit("")), F.lit(f" {BANNER_RULE}"))
    texts = [(-2, banner("START")), (-1, F.lit("\n" + SECTION_START.format("POSTS"))),
             (1, F.lit(SECTION_END.format("POSTS") + "\n")), (2, F.lit(SECTION_START.format("COMMENTS"))),
             (4, F.lit(SECTION_END.format("COMMENTS") + "\n")), (5, banner("END"))]
    groups = posts.select(*keys).unionByName(comments.select(*keys)).distinct() if keys else (
        posts.sparkSession.range(1).select())
    fixed = groups.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(0).cast("bigint").alias("ord"), t.alias("line")) for s, t in texts])))
    records = export_lines(posts, comments, keys).select(
        *keys, F.when(F.col("section") == 1, 3).otherwise(0).alias("section"), "ord", F.col("value").alias("line"))
    return fixed.unionByName(records)
