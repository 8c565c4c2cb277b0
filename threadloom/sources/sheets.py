"""CSV sheets: posts, comments and annotations, under the header variants they come in."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from threadloom.constants import (
    ANNOTATIONS, MACRO, NA_TOKENS, RAW_COMMENT_FIELDS, RAW_POST_FIELDS, SEGMENT,
)
from threadloom.functions.dates import whole_number
from threadloom.functions.bind import bind
from threadloom.operators.ordering import with_ordinal
from threadloom.session import stage_table
from threadloom.sources.paths import csv_header, matching_files
from threadloom.sources.records import read_records

CSV_OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"'}  # of one record, which may hold line breaks
SHEET_NAME = re.compile(r"([^/_]+)_(posts|comments)_([^/_]+)_([^/_.]+)\.csv$", re.IGNORECASE)
TABLE_NAME = re.compile(r"([^/_]+)_(posts|comments)\.csv$", re.IGNORECASE)
LABEL_SHEETS = {"sentiment": "sentiment", "toxicity": "toxicity", "topics": "topics"}

# Known header variants, lower case -> column (fixed values).
HEADER_VARIANTS = {"topic": "topics", "discussion pattern": "patterns", "pattern number": "pattern_no"}


def missing_tokens_to_null(df: DataFrame) -> DataFrame:
    """Texts that a pandas reader takes as missing become NULL."""
    changes = {
        f.name: F.when(~F.col(f"`{f.name}`").isin(*NA_TOKENS), F.col(f"`{f.name}`"))
        for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(changes)


def read_csv(spark: SparkSession, files, header, pandas_na: bool = True) -> DataFrame:
    """Files that share ``header``, every column as text, plus ``file`` and ``seq``, the row's number in its file.

    Files are split like any others, also inside cells with line breaks (see ``records``).
    """
    names = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{n} string" for n in names)
    rows = bind(read_records(spark, files), row=F.from_csv("record", schema, CSV_OPTIONS))
    df = rows.select("row.*", "file", "seq").toDF(*header, "file", "seq")
    return missing_tokens_to_null(df) if pandas_na else df


def with_place(df: DataFrame) -> DataFrame:
    """``ord`` instead of ``seq``: the place of a row, by file name and row, whatever tasks the files were read by.

    Only the row counts of the files must be added up: one narrow row per file, which goes to all tasks, so that no
    parsed row moves. The parsed rows are staged, so the sheets are read once.
    """
    df = stage_table(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), "sheet-rows").toDF(*df.columns)
    files = df.groupBy("file").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return df.join(F.broadcast(starts), "file").select(
        *[F.col(f"`{c}`") for c in df.columns if c != "seq"], (F.col("start") + F.col("seq") - F.col("first")).alias("ord"))


def lower_headers(df: DataFrame) -> DataFrame:
    """Column names in lower case, known variants under their usual name."""
    return df.toDF(*[HEADER_VARIANTS.get(c.lower(), c.lower()) for c in df.columns])


def id_column(columns) -> str:
    """The first column whose name contains ``ID`` or ``id``."""
    return next(c for c in columns if "ID" in c or "id" in c)


def by_header(spark: SparkSession, files) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by header line: one Spark read per distinct header."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        groups.setdefault(csv_header(spark, f), []).append(f)
    return {h: fs for h, fs in groups.items() if h}


def _segment(pattern: re.Pattern, parts: dict[str, int]) -> list[Column]:
    """Segment columns from the file name, or from the name of the folder that Spark wrote."""
    java = "(?i)" + pattern.pattern.replace("$", "(?:/|$)")
    out = []
    for name, group in parts.items():
        c = F.regexp_extract("file", java, group)
        out.append((c if name == "community" else F.lower(c)).alias(name))
    return out


def _union(frames: list[DataFrame], schema: T.StructType, spark: SparkSession) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sheet_files(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Annotation sheets of a folder by sheet name (sentiment, toxicity, ...)."""
    out: dict[str, list[str]] = {}
    for f in matching_files(spark, f"{folder}/*.csv"):
        m = SHEET_NAME.search(f)
        if m:
            out.setdefault(m.group(4).lower(), []).append(f)
    return out


_SHEET_PARTS = {"community": 1, "kind": 2, "model": 3}
LABEL_ROW = T.StructType([T.StructField(n, T.StringType()) for n in
                          ("community", "kind", "model", "id", "value")]
                         + [T.StructField("ord", T.LongType())])


def read_labels(spark: SparkSession, folder: str, sheet: str, strict: bool = False) -> DataFrame:
    """One label sheet of all segments: ``community, kind, model, id, value, ord``.

    ``strict`` reads only sheets whose label column has the exact usual name,
    so a sheet with another header is left out.
    """
    frames = []  # with ``file`` and ``seq``: rows are numbered over all headers
    for header, files in by_header(spark, sheet_files(spark, folder).get(sheet, [])).items():
        df = read_csv(spark, files, header)
        names = {c: HEADER_VARIANTS.get(c.lower(), c.lower()) for c in header}
        label = next((c for c, n in names.items() if (c if strict else n) == LABEL_SHEETS[sheet]), None)
        if label is None:
            continue
        key = id_column(header)
        frames.append(df.select(
            *_segment(SHEET_NAME, _SHEET_PARTS), F.col(f"`{key}`").alias("id"),
            F.col(f"`{label}`").alias("value"), "file", "seq"))
    return with_place(_union(frames, LABEL_ROW, spark)).drop("file") if frames else _union(frames, LABEL_ROW, spark)


def read_annotations(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """The label sheets of all segments and models as one long table with ``ord``.

    The three sheets of a segment list the same ids; they are stacked and
    folded by id rather than joined.
    """
    stacked = None
    for sheet in LABEL_SHEETS:
        one = read_labels(spark, folder, sheet, strict).withColumn("sheet", F.lit(sheet))
        stacked = one if stacked is None else stacked.unionByName(one)
    keys = [*SEGMENT, "model", "id"]
    # the nth row of an id in one sheet belongs to its nth row in the others
    stacked = with_ordinal(stacked, ["sheet", *keys], "ord", out="nth")
    pick = lambda s: F.max(F.when(F.col("sheet") == s, F.col("value"))).alias(s)
    # the place in the topics sheet orders first appearances; other sheets stand in without one
    place = F.coalesce(F.min(F.when(F.col("sheet") == "topics", F.col("ord"))), F.min("ord"))
    return stacked.groupBy(*keys, "nth").agg(*[pick(s) for s in LABEL_SHEETS], place.alias("ord")).drop("nth")


def read_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Summary and pattern sheets: ``community, kind, model, summary, patterns``.

    A sheet with one numbered pattern per row is folded into the joined form.
    """
    frames = []
    files = sheet_files(spark, folder)
    for sheet, column in (("summarization", "summary"), ("patterns", "patterns")):
        for header, group in by_header(spark, files.get(sheet, [])).items():
            df = lower_headers(read_csv(spark, group, header))
            if column not in df.columns:
                continue
            rows = with_place(df.select(*_segment(SHEET_NAME, _SHEET_PARTS), F.col(column).alias("value"), "file", "seq"))
            keys = [*SEGMENT, "model"]
            if "pattern_no" in df.columns:
                # one row per pattern: a handful per segment by construction of the sheet
                one = rows.groupBy(*keys).agg(F.array_join(F.transform(
                    F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda r: r["value"]),
                    " | ").alias(column))
            else:
                one = rows.groupBy(*keys).agg(F.min_by("value", "ord").alias(column))
            frames.append(one)
    macro = _union(frames, MACRO, spark)
    for c in ("summary", "patterns"):
        if c not in macro.columns:
            macro = macro.withColumn(c, F.lit(None).cast("string"))
    return macro.groupBy(*SEGMENT, "model").agg(
        F.max("summary").alias("summary"), F.max("patterns").alias("patterns"))


def _read_table(spark, pattern, fields, pandas_na) -> DataFrame:
    """Posts or comments sheets under canonical names; unknown columns keep theirs."""
    names = {raw.lower(): name for raw, name in fields.items()} | {n: n for n in fields.values()}
    frames = []
    for header, files in by_header(spark, matching_files(spark, pattern)).items():
        df = read_csv(spark, files, header, pandas_na)
        columns = [names.get(h.lower(), h.lower()) for h in header]
        renamed = df.toDF(*columns, "file", "seq")
        renamed = renamed.withColumnsRenamed({"created_epoch": "created_at"})
        community = _segment(TABLE_NAME, {"community": 1})[0]
        if "community" not in renamed.columns:
            renamed = renamed.withColumn("community", community)
        counts = {c: whole_number(F.col(c)) for c in ("score", "num_comments") if c in renamed.columns}
        frames.append(renamed.withColumns(counts))
    empty = T.StructType([T.StructField(
        "created_at" if n == "created_epoch" else n,
        T.LongType() if n in ("score", "num_comments") else T.StringType()) for n in fields.values()]
        + [T.StructField("file", T.StringType()), T.StructField("ord", T.LongType())])
    return with_place(_union(frames, empty, spark)) if frames else _union(frames, empty, spark)


def read_posts(spark: SparkSession, pattern: str, pandas_na: bool = True) -> DataFrame:
    """Posts sheets: canonical columns, ``created_at`` as text, plus ``file`` and ``ord``."""
    return _read_table(spark, pattern, RAW_POST_FIELDS, pandas_na)


def read_comments(spark: SparkSession, pattern: str, pandas_na: bool = True) -> DataFrame:
    return _read_table(spark, pattern, RAW_COMMENT_FIELDS, pandas_na)
