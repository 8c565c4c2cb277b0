"""Global prefix sums over an order: range partitions, one total per partition, a running sum inside each.

Only narrow rows are dealt out by range. The partition number is written with
the rows, so a task that is repeated after a lost executor can't number them
differently. The totals are one row per partition (and key); a hot key is
spread over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.session import stage_table

PART = "__part"


def range_parts(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` dealt by range of ``order`` and written, with the partition number as a column.

    ``df`` is read twice (Spark samples it for the borders): hand over narrow or staged rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_table(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), name)


def sums_before(parts: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add a column per entry of ``values``: its sum over all earlier rows of the same ``keys`` (not NULL)."""
    keys = list(keys)
    totals = parts.groupBy(*keys, PART).agg(*[F.sum(v).alias(f"__{n}_total") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, PART, *[
        F.coalesce(F.sum(f"__{n}_total").over(earlier), F.lit(0)).alias(f"__{n}_offset") for n in values])
    inside = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = parts.withColumns({n: F.sum(v).over(inside) - v for n, v in values.items()})
    return running.join(offsets, [*keys, PART]).withColumns(
        {n: F.col(n) + F.col(f"__{n}_offset") for n in values}).drop(*[f"__{n}_offset" for n in values])
