"""Normalisation of annotator labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadloom.constants import AUDIT_SAFE, AUDIT_TOXIC, CHART_TOXIC, UNANNOTATED
from threadloom.functions.text import capitalize, utrim


def compare_key(c: Column) -> Column:
    return F.lower(utrim(c))


def sentiment_label(c: Column) -> Column:
    return capitalize(utrim(c))


def audit_toxicity(c: Column) -> Column:
    """Two-way bucket for the agreement audit; an off-scale label stays itself."""
    v = compare_key(c)
    return (
        F.when(v.isin(*AUDIT_SAFE), "safe")
        .when(v.isin(*AUDIT_TOXIC), "toxic")
        .otherwise(v)
    )


def chart_toxicity(c: Column) -> Column:
    """Two-way bucket for charts; every label outside the toxic set is Non-Toxic."""
    return F.when(compare_key(c).isin(*CHART_TOXIC), "Toxic").otherwise("Non-Toxic")


def is_annotated(c: Column) -> Column:
    """False only for the fill labels; a missing label passes. No trim, as in the audit."""
    return F.coalesce(~F.lower(c).isin(*UNANNOTATED), F.lit(True))
