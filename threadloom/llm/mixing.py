"""Mix sources to target weights: hash-random order, prefix sums of sizes, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.prefix_sums import PART, range_parts, sums_before
from threadloom.llm.registry import documents, query
from threadloom.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: Column, seed: str) -> Column:
    """An order that looks random and is the same in each run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """One row per source: its size, target, whole epochs and the words still to take after them.

    ``sizes`` has (source, size) rows. Sources in code point order, NULL last, weigh ``weights`` in turn and share
    ``share`` of all words. A target stops at ``max_epochs`` times the source; the excess goes to the others by
    weight. That is one level ``t`` with targets ``min(cap, weight * t)``: sorted by cap / weight, the level is set
    by the first source that stays under its cap. Three windows over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), rank % len(weights) + 1).cast("long")
    ranked = by_source.withColumns({"weight": weight, "cap": F.col("source_size") * max_epochs})
    everything, by_level = Window.partitionBy(), Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
             / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    target = F.least(F.coalesce(F.col("t"), F.lit(float("inf"))) * F.col("weight"), F.col("cap").cast("double"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (ranked.withColumn("level", level)
            .withColumn("t", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "source", "level"))
                                   ).over(everything)["level"])
            .withColumn("target", target)
            .withColumn("epochs", epochs.cast("long"))
            .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
            .select("source", "source_size", "target", "epochs", "rest"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3,
             seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents, and per source what to take of it.

    Within a source documents stand in random order, those that share an id in the order of their texts' hashes. Its
    target is met by whole epochs, then by the documents up to the cut: those whose middle lies within the words
    still to take. The cut is a position (``cut_key``, ``cut_id``, ``cut_hash``) and how many of the equal rows there
    are taken (``cut_taken`` of ``cut_rows``), so whether a document is taken again depends on its own row and one
    row of its source: texts are never shuffled, but for equal rows that the cut parts.

    Empty and NULL texts have size 0; NULL sources are one source; a source without words has target 0; NULL ids
    sort first; an empty table gives empty frames. Only the three named columns are read.
    """
    sizes = stage_table(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key"),
        F.xxhash64(F.col(text_col)).alias("hash")), "mix-sizes")
    targets = stage_table(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    named = sizes.withColumns({"nosource": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    order = ["key", "doc_id", "hash", "size"]
    places = stage_table(named.groupBy("nosource", "name", *order).agg(F.count("*").alias("rows")), "mix-places")
    parts = range_parts(places, ["nosource", "name", *order], "mix-ranges")
    before = sums_before(parts, ["nosource", "name"], order, {"before": F.col("size") * F.col("rows")})
    # The nth of equal rows, from 0, is taken if 2 * (before + n * size) + size <= 2 * rest.
    fit = F.floor((2 * F.col("rest") - 2 * F.col("before") - F.col("size")) / (2 * F.col("size"))) + 1
    taken = before.withColumn("source", F.when(~F.col("nosource"), F.col("name"))).alias("a").join(
        targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).where(
        2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).where(F.col("size") > 0)
    cuts = taken.groupBy(F.col("a.source").alias("cut_source")).agg(F.max(F.struct(
        "key", "doc_id", "hash", F.least(fit, F.col("rows")).cast("long").alias("taken"), "rows")).alias("cut"))
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").select(
        *targets.columns, F.col("cut.key").alias("cut_key"), F.col("cut.doc_id").alias("cut_id"),
        F.col("cut.hash").alias("cut_hash"), F.col("cut.taken").alias("cut_taken"), F.col("cut.rows").alias("cut_rows"))
    return sizes, stage_table(plan, "mix-plan")


def with_times(rows: DataFrame, plan: DataFrame, key: Column, doc_id: Column, text_hash: Column,
               source: Column) -> DataFrame:
    """``rows`` and ``times``, how often each is taken: whole epochs, and one more up to the cut of its source.

    ``rows`` has columns c0, c1, ..., besides which the plan's row of the source is joined. Equal rows that the cut
    parts are written and numbered, by the task that wrote them; most plans part none.
    """
    cut_key, cut_id, cut_hash = F.col("b.cut_key"), F.col("b.cut_id"), F.col("b.cut_hash")
    smaller = F.coalesce((doc_id.isNull() & cut_id.isNotNull()) | (doc_id < cut_id), F.lit(False))
    same = doc_id.eqNullSafe(cut_id)
    below = (key < cut_key) | ((key == cut_key) & (smaller | (same & (text_hash < cut_hash))))
    at_cut = F.coalesce((key == cut_key) & same & (text_hash == cut_hash), F.lit(False))
    parted = at_cut & (F.col("b.cut_taken") < F.col("b.cut_rows"))
    joined = rows.join(plan.alias("b"), source.eqNullSafe(F.col("b.source")))
    once_more = (F.coalesce(below, F.lit(False)) | at_cut).cast("long")
    whole = joined.where(~parted).select(*rows.columns, (F.col("b.epochs") + once_more).alias("times"))
    if not plan.where("cut_taken < cut_rows").head(1):
        return whole
    tied = stage_table(joined.where(parted).select(
        *rows.columns, F.col("b.source").isNull().alias("nosource"), F.coalesce("b.source", F.lit("")).alias("name"),
        "b.epochs", "b.cut_taken", F.monotonically_increasing_id().alias("seq"),
        F.spark_partition_id().alias(PART)), "mix-tied")
    placed = sums_before(tied, ["nosource", "name"], ["seq"], {"place": F.lit(1).cast("long")})
    return whole.union(placed.select(
        *rows.columns, (F.col("epochs") + (F.col("place") < F.col("cut_taken")).cast("long")).alias("times")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: words taken of each document, repeats counted. See ``mix_plan``."""
    sizes, plan = mix_plan(docs, **options)
    rows = sizes.join(plan.select(F.col("source").alias("of"), "source_size", "target"),
                      F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", "key", "hash", "source")
    rows = rows.toDF(*[f"c{i}" for i in range(7)])
    timed = with_times(rows, plan, F.col("c4"), F.col("c0"), F.col("c5"), F.col("c6"))
    return timed.select(F.col("c0").alias("doc_id"), F.col("c1").alias("size"), F.col("c2").alias("source_size"),
                        F.col("c3").alias("target"), (F.col("c1") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged."""
    _, plan = mix_plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # Columns travel as c0, c1, ..., so that their names can't clash with those of the plan.
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text, source = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col, source_col))
    timed = with_times(docs.toDF(*names), plan, random_key(doc_id, seed), doc_id, F.xxhash64(text), source)
    return timed.where("times > 0").select(
        *names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).drop("copy").toDF(*docs.columns)


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sizes GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
               ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
level AS (
  SELECT level AS t FROM levels WHERE level * w <= 3 * source_size ORDER BY 3 * source_size / w, source LIMIT 1),
targets AS (
  SELECT source, source_size, least(t * w, 3.0::DOUBLE * source_size) AS target FROM levels, level),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id) - s.size AS before
  FROM sizes s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


@query("op8_mixing", MIX_SQL)
def mixing(spark, sf_dir) -> DataFrame:
    return mix(documents(spark, sf_dir))
