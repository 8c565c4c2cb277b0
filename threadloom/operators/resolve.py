"""Labels back onto the base rows, with the fill label of each model's coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.constants import SEGMENT, SKIPPED, SLICE_ROWS, UNKNOWN
from threadloom.operators.ordering import first_n, keep_last
from threadloom.operators.responses import LABELS

KEYS = [*SEGMENT, "id"]


def last_labels(aligned: DataFrame) -> DataFrame:
    """One row per segment and id; a later batch or place overwrites an earlier one."""
    return keep_last(aligned, KEYS, "batch_no", "pos").select(*KEYS, *LABELS)


def _labelled(rows: DataFrame, labels: DataFrame, on: list[str], fill: str) -> DataFrame:
    """Keys match as they are, missing ones too: a row without a community gets its labels back."""
    named = labels.select(*[F.col(k).alias(f"__{k}") for k in on], *LABELS)
    same = F.lit(True)
    for k in on:
        same = same & rows[k].eqNullSafe(named[f"__{k}"])
    out = rows.join(named, same, "left")
    return out.select(*rows.columns, *[F.coalesce(n, F.lit(fill)).alias(n) for n in LABELS])


def resolve_sweep(rows: DataFrame, labels: DataFrame, fill: str = UNKNOWN) -> DataFrame:
    """Every base row ``community, kind, id, ord`` with its labels, else ``Unknown``."""
    return _labelled(rows, labels, KEYS, fill)


def resolve_slice(rows: DataFrame, labels: DataFrame, n: int = SLICE_ROWS,
                  fill: str = SKIPPED) -> DataFrame:
    """Labels only for the first ``n`` rows of a segment; all others get ``Skipped``,
    even if their id was labelled."""
    head = first_n(rows.select(*KEYS, "ord"), SEGMENT, [F.col("ord"), F.col("id")], n).distinct()
    known = _labelled(head, labels, KEYS, fill)
    return _labelled(rows, known, [*KEYS, "ord"], fill)


def coverage(resolved: DataFrame) -> DataFrame:
    """Rows per segment by how far the annotator came."""
    skipped = F.col("sentiment") == SKIPPED
    unknown = F.col("sentiment") == UNKNOWN
    return resolved.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(unknown).alias("unknown"),
        F.count_if(~skipped & ~unknown).alias("labelled"),
    )
