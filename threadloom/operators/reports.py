"""Text reports as rows: order columns plus ``line``. ``sources.sinks`` writes them.

Line texts are fixed values of the report formats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.constants import SLICE_MODEL, SWEEP_MODEL
from threadloom.functions.text import percent
from threadloom.operators.narrative import KINDS, MODELS

RULE_50 = "-" * 50
RULE_66 = "=" * 66
AUDIT_TITLE = "               LLM MODEL AGREEMENT AUDIT REPORT                   "
AUDIT_LABELS = {"sentiment": ("📊", "Sentiment"), "toxicity": ("💀", "Toxicity")}
MATRIX_TITLE = "# 📊 Subreddit Cross-Community Narrative & Pattern Comparison Matrix"
SUMMARY_HEADING = "## 💬 1. Cross-Subreddit Analytical Matrix: "
PATTERN_HEADING = "## 🎯 2. Recurring Behavioral & Discussion Patterns: "
MATRIX_RULE = "| :--- | :--- | :--- |"
SUMMARY_COLUMNS = {SWEEP_MODEL: "Groq Engine Summary (100% Sweep Context)",
                   SLICE_MODEL: "Gemini Engine Summary (Overlapping Slice)"}
PATTERN_COLUMNS = {SWEEP_MODEL: "Groq Identified Discussion Patterns",
                   SLICE_MODEL: "Gemini Identified Discussion Patterns"}


def _shown(c: Column | str) -> Column:
    """A field as the report shows it; a missing one reads ``None``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("None"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def harvest_report(posts: DataFrame, comments: DataFrame, keys: Sequence[str], subreddit: Column,
                   mode: str, stamp: Column) -> DataFrame:
    """``keys, section, ord, line`` of one report per key group; a group with no rows has none.

    Each record is one row, so a report of any size stays distributed.
    """
    keys = list(keys)
    zero = F.lit(0).cast("bigint")
    post_lines = _lines(
        F.concat(F.lit("["), _shown("post_id"), F.lit("] "), _shown("title")),
        F.concat(F.lit("Author: "), _shown("author"), F.lit(" | Score: "), _shown("score"),
                 F.lit(" | Comments: "), _shown("num_comments")),
        F.concat(F.lit("URL: "), _shown("permalink")),
        F.when(F.col("body") != "", F.concat(F.lit("Body: "), F.col("body"))),
        F.lit(RULE_50),
    )
    comment_lines = _lines(
        F.concat(F.lit("["), _shown("comment_id"), F.lit("] Post: "), _shown("post_id"),
                 F.lit(" | Author: "), _shown("author"), F.lit(" | Score: "), _shown("score")),
        F.concat(F.lit("Text: "), _shown("text")),
        F.lit(RULE_50),
    )
    held = (
        posts.select(*keys, F.lit(True).alias("p"), F.lit(False).alias("c"))
        .unionByName(comments.select(*keys, F.lit(False).alias("p"), F.lit(True).alias("c")))
        .groupBy(*keys).agg(F.max("p").alias("has_posts"), F.max("c").alias("has_comments"))
    )
    title = F.concat(F.lit("=== HARVEST REPORT: r/"), subreddit, F.lit(f" [{mode.upper()}] - "),
                     stamp, F.lit(" ===\n"))
    head = lambda no, text, when: F.struct(
        F.lit(no).alias("section"), zero.alias("ord"), F.when(when, text).alias("line"))
    heads = held.select(*keys, F.inline(F.array(
        head(0, title, F.lit(True)),
        head(1, F.lit("--- POSTS ---"), F.col("has_posts")),
        head(3, F.lit("\n--- COMMENTS ---"), F.col("has_comments")),
    ))).where(F.col("line").isNotNull())
    return heads.unionByName(
        posts.select(*keys, F.lit(2).alias("section"), "ord", post_lines.alias("line"))
    ).unionByName(
        comments.select(*keys, F.lit(4).alias("section"), "ord", comment_lines.alias("line")))


def agreement_report(agreement: DataFrame) -> DataFrame:
    """``community, kind, label, line``: the rate with its sample size, or that data is missing."""
    kind = F.initcap("kind")
    icon = F.when(F.col("label") == "sentiment", AUDIT_LABELS["sentiment"][0]).otherwise(
        AUDIT_LABELS["toxicity"][0])
    lead = F.concat(icon, F.lit(" "), _shown("community"), F.lit(" "), kind, F.lit(" -> "),
                    F.initcap("label"), F.lit(" Agreement Rate: "))
    rate = F.concat(percent(F.col("agreement_pct"), 2), F.lit(" (Sample Window: "),
                    F.col("sample_rows").cast("string"), F.lit(" rows)"))
    text = F.when(F.col("sample_rows") > 0, rate).otherwise("Insufficient valid data pairs.")
    return agreement.select(*["community", "kind", "label"], F.concat(lead, text).alias("line"))


def agreement_document(agreement: DataFrame) -> DataFrame:
    """The whole audit report: ``community, kind_no, label_no, line`` in that order."""
    lines = agreement_report(agreement)
    heading = agreement.sparkSession.createDataFrame(
        [("", -1, i, t) for i, t in enumerate([RULE_66, AUDIT_TITLE, RULE_66 + "\n"])],
        "community string, kind_no int, label_no int, line string")
    body = lines.select(
        "community", F.when(F.col("kind") == "posts", 0).otherwise(1).alias("kind_no"),
        F.when(F.col("label") == "sentiment", 0).otherwise(1).alias("label_no"),
        # the toxicity line closes its segment with an empty line
        F.when(F.col("label") == "toxicity", F.concat("line", F.lit("\n"))).otherwise(
            F.col("line")).alias("line"))
    return heading.unionByName(body)


def narrative_rows(matrix: DataFrame, models=MODELS) -> DataFrame:
    """``kind, section (summary | patterns), community, line``: one table row each."""
    def line(text: str) -> Column:
        return F.concat(F.lit("| **r/"), F.col("community"), F.lit("** | "),
                        F.concat_ws(" | ", *[F.col(f"{m}_{text}") for m in models]), F.lit(" |"))

    entries = F.array(*[
        F.struct(F.lit(t).alias("section"), line(t).alias("line")) for t in ("summary", "patterns")])
    return matrix.select("kind", "community", *[c for c in matrix.columns if c == "ord"],
                         F.inline(entries))


def narrative_document(matrix: DataFrame, models=MODELS) -> DataFrame:
    """The whole Markdown report: ``place, ord, community, line`` in that order."""
    spark = matrix.sparkSession
    heads = [(0, MATRIX_TITLE), (0, "One row per community; one column per annotator.\n")]
    for i, kind in enumerate(KINDS):
        at = 10 * (i + 1)
        names = lambda first, cols: f"| {first} | " + " | ".join(cols.get(m, m) for m in models) + " |"
        heads += [
            (at, SUMMARY_HEADING + kind.upper()), (at, ""),
            (at, names("Subreddit Community", SUMMARY_COLUMNS)), (at, MATRIX_RULE),
            (at + 2, "\n" + "—" * 40 + "\n"),
            (at + 2, PATTERN_HEADING + kind.upper()), (at + 2, ""),
            (at + 2, names("Subreddit Category", PATTERN_COLUMNS)), (at + 2, MATRIX_RULE),
            (at + 4, "\n\n" + "=" * 60 + "\n\n"),
        ]
    fixed = spark.createDataFrame(
        [(p, i, "", t) for i, (p, t) in enumerate(heads)],
        "place int, ord bigint, community string, line string")
    rows = narrative_rows(matrix, models)
    place = (F.when(F.col("kind") == KINDS[0], 10).otherwise(20)
             + F.when(F.col("section") == "summary", 1).otherwise(3))
    order = F.col("ord") if "ord" in rows.columns else F.lit(0).cast("bigint")
    return fixed.unionByName(rows.select(place.alias("place"), order.alias("ord"), "community", "line"))
