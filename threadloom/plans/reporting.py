"""Agreement, distributions, prevalence, topics, narrative."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators.metrics import (
    model_agreement, sentiment_distribution, top_topics, topic_counts,
    toxicity_prevalence,
)
from threadloom.operators.narrative import narrative_matrix
from threadloom.operators.reports import agreement_report, narrative_rows
from threadloom.plans import bindings as b
from threadloom.plans.registry import query

_STATUS = "CASE WHEN lower(trim(toxicity)) IN ('high', 'medium', 'toxic') THEN 1 ELSE 0 END"


@query("toxicity_prevalence", f"""WITH {b.SWEEP}, {b.LABELLED},
  both_kinds AS (
    SELECT community, toxicity FROM labelled UNION ALL
    SELECT community, toxicity FROM sweep WHERE kind = 'comments'),
  counted AS (
    SELECT community, sum({_STATUS}) AS toxic, count(*) AS n
    FROM both_kinds WHERE toxicity IS NOT NULL GROUP BY community)
  SELECT community, CAST(toxic AS BIGINT) AS toxic, CAST(n - toxic AS BIGINT) AS non_toxic,
         round(toxic * 100.0 / n, 6) AS toxic_pct
  FROM counted ORDER BY toxic_pct DESC, community""")
def _(spark, sf):
    rows = b.labelled(spark, sf).select("community", "toxicity").unionByName(
        b.sweep(spark, sf).where("kind = 'comments'").select("community", "toxicity"))
    return toxicity_prevalence(rows).withColumn("toxic_pct", F.round("toxic_pct", 6))


@query("sentiment_distribution", f"""WITH {b.SWEEP},
  norm AS (
    SELECT community, kind, upper(substr(trim(sentiment), 1, 1)) || lower(substr(trim(sentiment), 2)) AS s
    FROM sweep WHERE sentiment IS NOT NULL),
  kept AS (SELECT * FROM norm WHERE s IN ('Positive', 'Negative', 'Neutral')),
  totals AS (SELECT community, kind, count(*) AS total FROM kept GROUP BY ALL),
  grid AS (SELECT community, kind, total, unnest(['Positive', 'Negative', 'Neutral']) AS sentiment FROM totals)
  SELECT g.community, g.kind, g.sentiment, CAST(count(k.s) AS BIGINT) AS n, CAST(g.total AS BIGINT) AS total,
         round(count(k.s) * 100.0 / g.total, 6) AS pct
  FROM grid g LEFT JOIN kept k ON k.community = g.community AND k.kind = g.kind AND k.s = g.sentiment
  GROUP BY g.community, g.kind, g.sentiment, g.total""")
def _(spark, sf):
    return sentiment_distribution(b.sweep(spark, sf)).withColumn("pct", F.round("pct", 6))


_BUCKET = """CASE WHEN lower(trim({0})) IN ('low', 'non-toxic', 'nontoxic', 'safe') THEN 'safe'
  WHEN lower(trim({0})) IN ('medium', 'high', 'toxic') THEN 'toxic' ELSE lower(trim({0})) END"""

_PAIRS = f"""{b.SWEEP}, {b.LABELLED}, {b.TWO_MODELS}, segments AS (
    SELECT community, kind FROM first_model INTERSECT SELECT community, kind FROM second_model),
  pairs AS (
    SELECT g.community, g.kind, a.id, a.sentiment AS sa, s.sentiment AS sb,
           a.toxicity AS ta, s.toxicity AS tb, a.id IS NOT NULL AS paired
    FROM segments g LEFT JOIN (first_model a JOIN second_model s
      ON s.community IS NOT DISTINCT FROM a.community AND s.kind = a.kind AND s.id = a.id)
    ON g.community IS NOT DISTINCT FROM a.community AND g.kind = a.kind),
  rates AS (
    SELECT community, kind, 'sentiment' AS label,
           CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS sample_rows,
           CAST(sum(CASE WHEN ok AND hit THEN 1 ELSE 0 END) AS BIGINT) AS matches
    FROM (SELECT *, paired AND coalesce(lower(sa) NOT IN ('skipped', 'unknown'), true) AS ok,
                 coalesce(lower(trim(sa)) = lower(trim(sb)), false) AS hit FROM pairs) x
    GROUP BY community, kind
    UNION ALL
    SELECT community, kind, 'toxicity',
           CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT),
           CAST(sum(CASE WHEN ok AND hit THEN 1 ELSE 0 END) AS BIGINT)
    FROM (SELECT *, paired AND coalesce(lower(ta) NOT IN ('skipped', 'unknown'), true) AS ok,
                 ({_BUCKET.format('ta')}) IS NOT DISTINCT FROM ({_BUCKET.format('tb')}) AS hit
          FROM pairs) x
    GROUP BY community, kind)"""


def _agreement(spark, sf):
    return model_agreement(b.two_models(spark, sf), "slice", "sweep")


for _label in ("sentiment", "toxicity"):
    def _one(spark, sf, label=_label):
        return _agreement(spark, sf).where(F.col("label") == label).withColumn(
            "agreement_pct", F.round("agreement_pct", 6))

    query(f"model_agreement_{_label}", f"""WITH {_PAIRS}
      SELECT *, round(matches * 100.0 / nullif(sample_rows, 0), 6) AS agreement_pct FROM rates
      WHERE label = '{_label}'""")(_one)


@query("agreement_report_lines", f"""WITH {_PAIRS}
  SELECT community, kind, label,
         CASE WHEN label = 'sentiment' THEN '📊 ' ELSE '💀 ' END || coalesce(community, 'None') || CASE kind WHEN 'posts' THEN ' Posts' ELSE ' Comments' END || ' -> '
         || CASE WHEN label = 'sentiment' THEN 'Sentiment' ELSE 'Toxicity' END || ' Agreement Rate: '
         || CASE WHEN sample_rows = 0 THEN 'Insufficient valid data pairs.'
                 ELSE printf('%.2f', matches * 100.0 / sample_rows) || '% (Sample Window: '
                      || sample_rows || ' rows)' END AS line
  FROM rates""")
def _(spark, sf):
    return agreement_report(_agreement(spark, sf))


_TITLE = r"""array_to_string(list_transform(
    regexp_extract_all(tok, '([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)'),
    lambda r: CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END || lower(r[2:])), '')"""

_TOKENS = rf"""{b.SWEEP}, cells AS (
    SELECT community, kind, ord, string_split(translate(topics, '[]"''', ''), ',') AS parts
    FROM sweep WHERE topics IS NOT NULL),
  raw_tokens AS (
    SELECT community, kind, ord, generate_subscripts(parts, 1) AS pos, unnest(parts) AS raw FROM cells),
  trimmed AS (
    SELECT community, kind, ord, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS tok FROM raw_tokens),
  titled AS (
    SELECT community, kind, ord, pos, {_TITLE} AS topic FROM trimmed WHERE tok <> ''),
  tokens AS (
    SELECT * FROM titled WHERE lower(topic) NOT IN (
      'phone', 'comment', 'post', 'tech', 'gaming', 'smartphone', 'general', 'unknown', 'threads')),
  placed AS (
    SELECT *, row_number() OVER (PARTITION BY community ORDER BY CASE kind WHEN 'posts' THEN 0 ELSE 1 END,
                                 ord, pos) AS place
    FROM tokens),
  freq AS (
    SELECT community, topic, count(*) AS n, min(place) AS place FROM placed GROUP BY community, topic)"""


@query("top_topics", f"""WITH {_TOKENS}, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, place) AS rank FROM freq)
  SELECT community, topic, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank
  FROM ranked WHERE rank <= 10""")
def _(spark, sf):
    return top_topics(b.sweep(spark, sf))


@query("topic_frequencies", f"""WITH {_TOKENS}
  SELECT community, topic, CAST(n AS BIGINT) AS n FROM freq""")
def _(spark, sf):
    return topic_counts(b.sweep(spark, sf)).drop("place")


@query("segment_union", f"""WITH {b.SWEEP}
  SELECT community, kind, id, sentiment, toxicity FROM sweep""")
def _(spark, sf):
    return b.sweep(spark, sf).select("community", "kind", "id", "sentiment", "toxicity")


# --- narrative: a macro table with gaps, from the sources of each language ---------------


def _macro(spark, sf):
    """Two models, rows missing on purpose; the first document of a source speaks for it."""
    d = b.table(spark, sf, "documents")
    return d.select(
        F.col("source").alias("community"),
        F.when(F.col("doc_id") % 2 == 0, "posts").otherwise("comments").alias("kind"),
        F.when(F.col("doc_id") % 3 == 0, "groq").otherwise("gemini").alias("model"),
        F.concat(F.lit("  "), "lang", F.lit(" summary "), F.col("doc_id").cast("string"), F.lit(" "))
        .alias("summary"),
        F.when(F.col("n_chars") % 4 != 0, F.concat_ws(" | ", "lang", "source", F.col("n_chars").cast("string")))
        .alias("patterns"),
        F.col("doc_id").alias("ord"),
    ).where("model = 'groq' or n_chars % 2 = 0")


_MACRO = """macro AS (
    SELECT source AS community, CASE WHEN doc_id % 2 = 0 THEN 'posts' ELSE 'comments' END AS kind,
           CASE WHEN doc_id % 3 = 0 THEN 'groq' ELSE 'gemini' END AS model,
           '  ' || lang || ' summary ' || doc_id || ' ' AS summary,
           CASE WHEN n_chars % 4 <> 0 THEN lang || ' | ' || source || ' | ' || n_chars END AS patterns,
           doc_id AS ord
    FROM documents WHERE doc_id % 3 = 0 OR n_chars % 2 = 0),
  first_rows AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community, kind, model ORDER BY ord) AS rn
                   FROM macro) x WHERE rn = 1),
  grid AS (SELECT community, unnest(['posts', 'comments']) AS kind
           FROM (SELECT DISTINCT source AS community FROM documents) c),
  matrix AS (
    SELECT g.community, g.kind,
           coalesce(trim(q.summary), 'No data summary generated.') AS groq_summary,
           replace(coalesce(q.patterns, 'No distinct patterns found.'), ' | ', '<br><br>') AS groq_patterns,
           coalesce(trim(m.summary), 'Analysis tier skipped.') AS gemini_summary,
           replace(coalesce(m.patterns, 'Analysis tier skipped.'), ' | ', '<br><br>') AS gemini_patterns
    FROM grid g
    LEFT JOIN first_rows q ON q.community = g.community AND q.kind = g.kind AND q.model = 'groq'
    LEFT JOIN first_rows m ON m.community = g.community AND m.kind = g.kind AND m.model = 'gemini')"""


def _matrix(spark, sf):
    communities = b.table(spark, sf, "documents").select(F.col("source").alias("community")).distinct()
    return narrative_matrix(communities, _macro(spark, sf))


@query("narrative_matrix", f"WITH {_MACRO} SELECT * FROM matrix")
def _(spark, sf):
    return _matrix(spark, sf)


@query("narrative_lines", f"""WITH {_MACRO}
  SELECT kind, community, 'summary' AS section,
         '| **r/' || community || '** | ' || groq_summary || ' | ' || gemini_summary || ' |' AS line FROM matrix
  UNION ALL
  SELECT kind, community, 'patterns',
         '| **r/' || community || '** | ' || groq_patterns || ' | ' || gemini_patterns || ' |' FROM matrix""")
def _(spark, sf):
    return narrative_rows(_matrix(spark, sf))
