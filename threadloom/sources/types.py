"""Column types of sheets, as a pandas reader infers them, from one pass over all rows.

Each cell has a type; types form a lattice (missing < integer < float < text, missing < truth < text); a column's type is
the join of its cells' types. Joins are folded as flags in one aggregation, so all columns cost one scan and one row
per task is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.constants import NA_TOKENS

MISSING, TRUTH, INTEGER, FLOAT, TEXT = "missing", "truth", "integer", "float", "text"
SPARK_TYPES = {MISSING: "double", TRUTH: "boolean", INTEGER: "bigint", FLOAT: "double", TEXT: "string"}
# How a reader without options spells truth values and numbers. Blanks around a number don't matter.
TRUTH_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")
WHOLE = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
DECIMAL = r"^[ \t]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$|(?i)^[+-]?inf(inity)?$"


def _is_missing(cell: Column) -> Column:
    return cell.isNull() | cell.isin(*NA_TOKENS)


def cell_type(cell: Column) -> Column:
    """The type of one cell. A whole number beyond 64 bits is a float."""
    fits = F.trim(cell).try_cast("bigint").isNotNull()
    return (F.when(_is_missing(cell), MISSING).when(cell.isin(*TRUTH_WORDS), TRUTH)
            .when(cell.rlike(WHOLE) & fits, INTEGER).when(cell.rlike(DECIMAL), FLOAT).otherwise(TEXT))


def column_types(df: DataFrame) -> DataFrame:
    """``column, place, type, missing``: the type of each column of texts and how many of its cells are missing.

    A column of whole numbers with missing cells is one of floats, a column of truth values with missing cells or
    numbers is text, and a column with nothing but missing cells is ``missing`` (read as floats).
    """
    flags = []
    for i, c in enumerate(df.columns):
        kind = cell_type(F.col(f"`{c}`").cast("string"))
        flags.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("place"),
            *[F.count_if(kind == t).alias(t) for t in (MISSING, TRUTH, INTEGER, FLOAT, TEXT)]).alias(f"c{i}"))
    if not flags:
        return df.sparkSession.createDataFrame([], "column string, place int, type string, missing bigint")
    row = df.agg(*flags)
    some = lambda t: F.col(t) > 0
    number = some(INTEGER) | some(FLOAT)
    joined = (F.when(some(TEXT) | (some(TRUTH) & (number | some(MISSING))), TEXT).when(some(TRUTH), TRUTH)
              .when(some(FLOAT) | (some(INTEGER) & some(MISSING)), FLOAT).when(some(INTEGER), INTEGER).otherwise(MISSING))
    return row.select(F.inline(F.array(*row.columns))).select("column", "place", joined.alias("type"), "missing")


def typed(df: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """``df`` with each column of texts in its inferred type; one row per column comes to the driver."""
    found = {r["column"]: r["type"] for r in (types or column_types(df)).collect()}
    return df.select(*[_cast(F.col(f"`{c}`"), found[c]).alias(c) for c in df.columns])


def _cast(cell: Column, kind: str) -> Column:
    value = F.when(~_is_missing(cell), cell)
    if kind == TEXT:
        return value
    if kind == TRUTH:
        return F.lower(value) == "true"
    return F.trim(value).try_cast(SPARK_TYPES[kind])


def union_types(frames: list[DataFrame]) -> DataFrame:
    """Column types over several sheets with unlike headers: a column that a sheet lacks is missing there."""
    return column_types(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))
