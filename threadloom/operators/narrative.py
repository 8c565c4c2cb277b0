"""Side-by-side table of the models' summaries and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.constants import SLICE_MODEL, SWEEP_MODEL
from threadloom.functions.text import pattern_cell, utrim

MISSING_SUMMARY = {SWEEP_MODEL: "No data summary generated.", SLICE_MODEL: "Analysis tier skipped."}
MISSING_PATTERNS = {SWEEP_MODEL: "No distinct patterns found.", SLICE_MODEL: "Analysis tier skipped."}
KINDS = ("posts", "comments")
MODELS = (SWEEP_MODEL, SLICE_MODEL)


def narrative_matrix(communities: DataFrame, macro: DataFrame, models=MODELS) -> DataFrame:
    """Every community and kind, with each model's texts or its default.

    ``macro`` may have an ``ord`` column; the first row per segment and model
    counts. ``communities`` has a ``community`` column and may have an ``ord``.
    """
    if "ord" not in macro.columns:
        macro = macro.withColumn("ord", F.lit(0).cast("bigint"))
    aggs = []
    for m in models:
        place = F.when(F.col("model") == m, F.col("ord"))
        for text in ("summary", "patterns"):
            aggs.append(F.min_by(text, place).alias(f"{m}_{text}"))
    per_segment = macro.groupBy("community", "kind").agg(*aggs)
    extra = [c for c in communities.columns if c != "community"]
    grid = communities.select("community", *extra, F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    cells = []
    for m in models:
        cells.append(F.coalesce(utrim(F.col(f"{m}_summary")),
                                F.lit(MISSING_SUMMARY.get(m, ""))).alias(f"{m}_summary"))
        cells.append(pattern_cell(F.coalesce(utrim(F.col(f"{m}_patterns")), F.lit(
            MISSING_PATTERNS.get(m, "")))).alias(f"{m}_patterns"))
    return grid.join(per_segment, ["community", "kind"], "left").select(
        "community", "kind", *extra, *cells)
