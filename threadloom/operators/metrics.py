"""Reports over the long annotations table: agreement, distributions, prevalence, topics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.constants import (
    SEGMENT, SENTIMENTS, SLICE_MODEL, SWEEP_MODEL, TOPIC_LIMIT, TOPIC_STOP_WORDS, TOXIC_STATUSES,
)
from threadloom.functions.bind import bind
from threadloom.functions.labels import (
    audit_toxicity, chart_toxicity, compare_key, is_annotated, sentiment_label,
)
from threadloom.functions.text import raw_topics, title_case, utrim
from threadloom.operators.ordering import first_n


def annotator_pairs(first: DataFrame, second: DataFrame, labels=("sentiment", "toxicity")) -> DataFrame:
    """Both annotators' labels side by side: ``<label>_a`` and ``<label>_b`` per segment and id.

    Equal rows of the first side are one row with their number in ``pairs``, so
    an id that is repeated on both sides does not multiply.
    """
    keys = [*SEGMENT, "id"]
    a = (
        first.groupBy(*keys, *[F.col(n).alias(f"{n}_a") for n in labels])
        .agg(F.count(F.lit(1)).alias("pairs"))
    )
    b = second.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(n).alias(f"{n}_b") for n in labels])
    same = (F.col("id") == F.col("__id"))
    for k in SEGMENT:  # a missing community is a segment of its own
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(b, same).drop(*[f"__{k}" for k in keys])


def sentiment_agrees(a: Column, b: Column) -> Column:
    """A missing label agrees with nothing."""
    return F.coalesce(compare_key(a) == compare_key(b), F.lit(False))


def toxicity_agrees(a: Column, b: Column) -> Column:
    """Same audit bucket; two missing labels agree."""
    return audit_toxicity(a).eqNullSafe(audit_toxicity(b))


def pair_agreement(pairs: DataFrame) -> DataFrame:
    """``community, kind, label, sample_rows, matches, agreement_pct`` from label pairs.

    Pairs whose *first* label is a fill label do not count; the second side is
    not filtered. Both labels come out of one aggregation; a segment without a
    valid pair keeps its row with a NULL rate.
    """
    tests = {"sentiment": sentiment_agrees, "toxicity": toxicity_agrees}
    present = [n for n in tests if f"{n}_a" in pairs.columns]
    aggs = []
    for n in present:
        valid = is_annotated(F.col(f"{n}_a"))
        hit = valid & tests[n](F.col(f"{n}_a"), F.col(f"{n}_b"))
        for name, test in ((f"{n}_rows", valid), (f"{n}_hits", hit)):
            aggs.append(F.sum(F.when(test, F.col("pairs")).otherwise(0)).alias(name))
    wide = pairs.groupBy(*SEGMENT).agg(*aggs)
    entry = lambda n: F.struct(F.lit(n).alias("label"), F.col(f"{n}_rows").alias("sample_rows"),
                               F.col(f"{n}_hits").alias("matches"))
    return (
        wide.select(*SEGMENT, F.inline(F.array(*[entry(n) for n in present])))
        .withColumn("agreement_pct", F.try_divide(F.col("matches") * F.lit(100.0), F.col("sample_rows")))
    )


def model_agreement(annotations: DataFrame, first: str = SLICE_MODEL,
                    second: str = SWEEP_MODEL) -> DataFrame:
    """Agreement of two models of the annotations table, for each segment that both have rows of.

    The fill labels of the first model are dropped before the join when both of
    its labels are fills: such a row can count for neither rate. Segments come
    from the unfiltered table, as pairs that weigh nothing: one whose first model
    was skipped, or whose models share no id, keeps its rows with a NULL rate.
    """
    present = annotations.groupBy(*SEGMENT).agg(
        F.bool_or(F.col("model") == first).alias("a"), F.bool_or(F.col("model") == second).alias("b"))
    segments = present.where("a and b").select(*SEGMENT, F.lit(0).cast("bigint").alias("pairs"))
    a = annotations.where((F.col("model") == first)
                          & (is_annotated(F.col("sentiment")) | is_annotated(F.col("toxicity"))))
    b = annotations.where(F.col("model") == second)
    return pair_agreement(annotator_pairs(a, b).unionByName(segments, allowMissingColumns=True))


def sentiment_counts(annotations: DataFrame) -> DataFrame:
    """One row per segment, one count per sentiment of the domain; other labels do not count."""
    labels = annotations.select(*SEGMENT, "sentiment").dropna(subset=["sentiment"])
    return (
        bind(labels, label=sentiment_label(F.col("sentiment")))
        .where(F.col("label").isin(*SENTIMENTS))
        .groupBy(*SEGMENT)
        .agg(*[F.count_if(F.col("label") == s).alias(s) for s in SENTIMENTS])
    )


def _percentages(counts: DataFrame, keys, labels, name: str) -> DataFrame:
    total = sum((F.col(x) for x in labels[1:]), F.col(labels[0]))
    long = counts.withColumn("total", total).unpivot([*keys, "total"], list(labels), name, "n")
    return long.withColumn("pct", F.col("n") * F.lit(100.0) / F.col("total"))


def sentiment_distribution(annotations: DataFrame) -> DataFrame:
    """``community, kind, sentiment, n, total, pct``, zero counts included."""
    return _percentages(sentiment_counts(annotations), SEGMENT, SENTIMENTS, "sentiment")


def toxicity_counts(annotations: DataFrame) -> DataFrame:
    status = annotations.where(F.col("toxicity").isNotNull()).select(
        "community", chart_toxicity(F.col("toxicity")).alias("status"))
    return status.groupBy("community").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in TOXIC_STATUSES])


def toxicity_prevalence(annotations: DataFrame) -> DataFrame:
    """Toxic share per community, posts and comments together, highest first."""
    total = F.col("Toxic") + F.col("Non-Toxic")
    return (
        toxicity_counts(annotations)
        .select("community", F.col("Toxic").alias("toxic"), F.col("Non-Toxic").alias("non_toxic"),
                (F.col("Toxic") * F.lit(100.0) / total).alias("toxic_pct"))
        .orderBy(F.desc("toxic_pct"), "community")
    )


def topic_counts(annotations: DataFrame, stop_words=TOPIC_STOP_WORDS) -> DataFrame:
    """``community, topic, n, place`` for each topic token that is not a stop word.

    ``place`` orders tokens as they first appear: posts before comments, then by
    row, then inside the cell. It is one decimal so that the minimum per token
    stays in the hash aggregation before the shuffle. Tokens are counted as they
    are written first; only distinct ones are brought to title case.
    """
    cells = annotations.where(F.col("topics").isNotNull()).select(
        "community", "kind", "ord", F.posexplode(raw_topics(F.col("topics"))).alias("pos", "raw"))
    kind_no = F.when(F.col("kind") == "posts", 0).otherwise(1)
    place = (
        kind_no.cast("decimal(1,0)") * F.lit(Decimal(10 ** 29))
        + F.col("ord").cast("decimal(19,0)") * F.lit(Decimal(10 ** 10))
        + F.col("pos").cast("decimal(10,0)")
    ).cast("decimal(38,0)")
    written = cells.select("community", "raw", place.alias("place")).groupBy("community", "raw").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    # bound, or the filters below would take the title case down to every token before they are counted
    titled = bind(written, topic=utrim(title_case(F.col("raw"))))
    return titled.where((F.col("topic") != "") & ~F.lower("topic").isin(*stop_words)).groupBy(
        "community", "topic").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def top_topics(annotations: DataFrame, k: int = TOPIC_LIMIT, stop_words=TOPIC_STOP_WORDS) -> DataFrame:
    """The ``k`` most frequent topics per community; ties go to the earlier first use."""
    freq = topic_counts(annotations, stop_words)
    return first_n(freq, ["community"], [F.desc("n"), F.asc("place")], k, rank="rank").drop("place")
