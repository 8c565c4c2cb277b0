"""Order-dependent operators that never put a whole group into one task.

``ord`` is a bigint that is unique within the grouping keys. Exact running
totals are built from blocks of ``BLOCK`` consecutive ``ord`` values: a block
holds at most ``BLOCK`` rows however many rows its group has, so a community
with a third of all rows is spread over as many tasks as it has blocks. Only
the per-block totals (one narrow row each) meet per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 16

_BLOCK, _VALUE, _RANK, _TOTAL = "__block", "__value", "__rank", "__total"


def floor_div(name: str, n: int) -> Column:
    """Whole-number floor of a bigint column divided by ``n``; exact over the full range."""
    return F.expr(f"(`{name}` - pmod(`{name}`, {n}L)) div {n}L")


def _running(keys: Sequence[str], order: Sequence[str], value: str) -> Column:
    """Sum of the earlier rows. A frame up to the current row is far cheaper than one that ends before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(w) - F.col(value)


def running_total_before(
    df: DataFrame,
    keys: Sequence[str],
    ord_col: str,
    value: Column,
    out: str,
    total: str | None = None,
    block: int = BLOCK,
    levels: int = 2,
) -> DataFrame:
    """Add ``out``: sum of ``value`` over the earlier rows of the same ``keys``.

    ``total`` names a further column for the sum over the whole group. The
    block offsets travel as extra rows of their own block, so there is no join,
    the rows are shuffled once, and NULL keys group like any other key.
    The offsets are built in blocks as well (``levels=2``), so a group with very
    many blocks, as a sparse ``ord`` makes, does not meet in one task either.
    """
    keys = list(keys)
    rows = df.withColumns({_BLOCK: floor_div(ord_col, block), _VALUE: F.coalesce(value.cast("bigint"), F.lit(0))})
    sums = rows.groupBy(*keys, _BLOCK).agg(F.sum(_VALUE).alias(_VALUE))
    if levels > 1:
        offsets = running_total_before(
            sums.withColumnsRenamed({_BLOCK: "__sub", _VALUE: "__sum"}),
            keys, "__sub", F.col("__sum"), "__before", "__all" if total else None, block, levels - 1,
        ).withColumnsRenamed({"__sub": _BLOCK, "__before": _VALUE, "__all": _TOTAL}).drop("__sum")
    else:
        offsets = sums.withColumn("__before", _running(keys, [_BLOCK], _VALUE))
        if total:
            offsets = offsets.withColumn(_TOTAL, F.sum(_VALUE).over(Window.partitionBy(*keys)))
        offsets = offsets.drop(_VALUE).withColumnRenamed("__before", _VALUE)
    both = rows.withColumn(_RANK, F.lit(1)).unionByName(
        offsets.withColumn(_RANK, F.lit(0)), allowMissingColumns=True
    )
    added = {out: _running([*keys, _BLOCK], [_RANK, ord_col], _VALUE)}
    if total:
        w = Window.partitionBy(*keys, _BLOCK).orderBy(_RANK, ord_col)
        added[total] = F.first(_TOTAL, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        both.withColumns(added).where(F.col(_RANK) == 1).drop(_BLOCK, _VALUE, _RANK, _TOTAL)
    )


def with_ordinal(df: DataFrame, keys: Sequence[str], ord_col: str = "ord", out: str = "ord0",
                 block: int = BLOCK, levels: int = 2) -> DataFrame:
    """0-based position of each row within ``keys`` by ``ord_col``."""
    return running_total_before(df, keys, ord_col, F.lit(1), out, None, block, levels)


SALTS = 256


def first_n(df: DataFrame, keys: Sequence[str], order, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, for any ``n``.

    The first ``n`` of each of 256 parts of a group are taken first, by the input
    partition a row comes from, so no task sees more of a hot group than a part
    of it, or ``256 * n`` rows. Catalyst moreover limits groups before a shuffle
    where ``n`` is small, which makes the first step cheap.
    """
    keys, order = list(keys), list(order) if isinstance(order, (list, tuple)) else [order]
    name = rank or "__rn"
    salted = df.withColumn("__salt", F.spark_partition_id() % SALTS)
    within = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))
    df = salted.withColumn(name, within).where(F.col(name) <= n).drop("__salt", name)
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return kept.withColumn(name, F.col(name).cast("bigint")) if rank else kept.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """One row per key, the earliest by ``ord_col``. NULL keys form one group.

    An aggregation: each map task hands on one row per key at most, and rows are shuffled once.
    """
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(ord_col))
    return df.groupBy(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)]).agg(first.alias("__row")).select("__row.*")


def keep_last(df: DataFrame, keys: Sequence[str], *ord_cols: str) -> DataFrame:
    """Last write wins: one row per key, the latest by ``ord_cols``."""
    return first_n(df, keys, [F.col(c).desc() for c in ord_cols], 1)
