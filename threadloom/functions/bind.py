"""Evaluate an expression once per row, however often later steps refer to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose values are fixed here.

    A plain projection is copied by the optimizer into every filter and column
    built on it, which repeats costly parsing many times. A one-element
    generator is a border for that. Existing columns of the same name are replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(
        *[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once; for use inside array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
