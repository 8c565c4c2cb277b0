"""Dedupe, purge, fill, dates and cleaning counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.dates import (
    epoch_to_text, millis_to_epoch, standard_date_text, ts_to_micros, ts_to_text, whole_number,
)
from threadloom.operators.clean import (
    clean_comments, clean_posts, cleaning_metrics, harmonize_comments, harmonize_posts,
)
from threadloom.plans import bindings as b
from threadloom.plans.registry import query


def _gappy_posts(spark, sf):
    """Posts keyed by their text (copies are duplicates), with missing fields."""
    k = F.col("ord")
    return b.posts(spark, sf).select(
        "community", F.md5("body").alias("post_id"),
        F.when(k % 5 != 0, F.col("title")).alias("title"),
        F.when(k % 7 != 0, F.col("body")).alias("body"),
        F.when(k % 3 != 0, F.col("author")).alias("author"),
        F.when(k % 11 != 0, F.col("created_epoch")).alias("created_epoch"),
        F.when(k % 4 != 0, F.col("score")).alias("score"),
        F.when(k % 6 != 0, F.col("num_comments")).alias("num_comments"),
        "permalink", "ord",
    )


_GAPPY_POSTS = f"""{b.POSTS}, gappy AS (
    SELECT community, md5(body) AS post_id, CASE WHEN ord % 5 <> 0 THEN title END AS title,
           CASE WHEN ord % 7 <> 0 THEN body END AS body, CASE WHEN ord % 3 <> 0 THEN author END AS author,
           CASE WHEN ord % 11 <> 0 THEN created_epoch END AS created_epoch,
           CASE WHEN ord % 4 <> 0 THEN score END AS score,
           CASE WHEN ord % 6 <> 0 THEN num_comments END AS num_comments, permalink, ord
    FROM posts)"""

_AT = "strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(created_epoch), '%Y-%m-%d %H:%M:%S')"


@query("clean_posts_dedupe", f"""WITH {_GAPPY_POSTS},
  firsts AS (SELECT *, row_number() OVER (PARTITION BY community, post_id ORDER BY ord) AS rn FROM gappy)
  SELECT community, post_id, coalesce(title, '') AS title, coalesce(body, '') AS body,
         coalesce(author, '[unknown_user]') AS author, {_AT} AS created_at,
         coalesce(score, 0) AS score, coalesce(num_comments, 0) AS num_comments, permalink, ord
  FROM firsts WHERE rn = 1""")
def _(spark, sf):
    return clean_posts(_gappy_posts(spark, sf)).withColumn("created_at", ts_to_text(F.col("created_at")))


def _gappy_comments(spark, sf):
    """Two turns share an id; system turns are placeholders in text or author, in mixed case."""
    c, k = b.comments(spark, sf), F.col("ord")
    gone = F.col("author") == "system"
    return c.select(
        "community",
        F.concat("post_id", F.lit("_"), F.floor(F.col("ord") % 1_000_000 / 2).cast("string")).alias("comment_id"),
        "post_id", "parent_id",
        F.when(gone & (k % 2 == 0), "[Deleted]").when(k % 9 == 4, " [removed]")
        .when(k % 9 != 5, F.col("text")).alias("text"),
        F.when(gone & (k % 2 == 1), "[REMOVED]").when(k % 5 != 0, F.col("author")).alias("author"),
        "created_epoch", F.when(k % 4 != 0, F.col("score")).alias("score"), "ord",
    )


_GAPPY_COMMENTS = f"""{b.COMMENTS}, gappy AS (
    SELECT community, post_id || '_' || CAST(floor(ord % 1000000 / 2) AS BIGINT) AS comment_id,
           post_id, parent_id,
           CASE WHEN author = 'system' AND ord % 2 = 0 THEN '[Deleted]' WHEN ord % 9 = 4 THEN ' [removed]'
                WHEN ord % 9 <> 5 THEN text END AS text,
           CASE WHEN author = 'system' AND ord % 2 = 1 THEN '[REMOVED]'
                WHEN ord % 5 <> 0 THEN author END AS author,
           created_epoch, CASE WHEN ord % 4 <> 0 THEN score END AS score, ord
    FROM comments),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY community, comment_id ORDER BY ord) AS rn,
                    coalesce(lower(text) IN ('[deleted]', '[removed]'), false)
                    OR coalesce(lower(author) IN ('[deleted]', '[removed]'), false) AS gone
             FROM gappy)"""


@query("clean_comments_purge", f"""WITH {_GAPPY_COMMENTS}
  SELECT community, comment_id, post_id, parent_id, coalesce(text, '') AS text,
         coalesce(author, '[unknown_user]') AS author, {_AT} AS created_at,
         coalesce(score, 0) AS score, ord
  FROM firsts WHERE rn = 1 AND NOT gone""")
def _(spark, sf):
    return clean_comments(_gappy_comments(spark, sf)).withColumn(
        "created_at", ts_to_text(F.col("created_at")))


@query("clean_metrics_comments", f"""WITH {_GAPPY_COMMENTS}
  SELECT community, 'comments' AS kind, count(*) AS rows_in,
         CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates_removed,
         CAST(sum(CASE WHEN rn = 1 AND gone THEN 1 ELSE 0 END) AS BIGINT) AS placeholders_purged,
         CAST(sum(CASE WHEN rn = 1 AND NOT gone THEN 1 ELSE 0 END) AS BIGINT) AS rows_out
  FROM firsts GROUP BY community""")
def _(spark, sf):
    return cleaning_metrics(_gappy_comments(spark, sf), "comments", "comment_id", purge=True)


@query("clean_metrics_posts", f"""WITH {_GAPPY_POSTS}
  SELECT community, 'posts' AS kind, count(*) AS rows_in,
         count(*) - count(DISTINCT post_id) AS duplicates_removed,
         CAST(0 AS BIGINT) AS placeholders_purged, count(DISTINCT post_id) AS rows_out
  FROM gappy GROUP BY community""")
def _(spark, sf):
    return cleaning_metrics(_gappy_posts(spark, sf), "posts", "post_id", purge=False)


# --- dates, over events --------------------------------------------------------------------


def _event_micros():
    """Event time in microseconds; a naive time cast to naive is unchanged."""
    return ts_to_micros(F.col("ts").cast("timestamp_ntz"))


def _event_seconds():
    return F.floor(_event_micros() / 1_000_000).cast("bigint")


_TS = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"


@query("timestamp_epoch", f"""SELECT event_id,
    CASE WHEN event_id % 11 NOT IN (0, 1) THEN {_TS} END AS created_at FROM events""")
def _(spark, sf):
    e = b.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 11 == 0, "bad").when(
        F.col("event_id") % 11 != 1, _event_seconds().cast("string"))
    return e.select("event_id", epoch_to_text(whole_number(raw)).alias("created_at"))


@query("timestamp_millis", """SELECT event_id,
    CASE WHEN event_id % 7 = 0 THEN CAST(0 AS BIGINT)
         ELSE CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) END AS created_epoch FROM events""")
def _(spark, sf):
    e = b.table(spark, sf, "events")
    ms = F.when(F.col("event_id") % 7 != 0, F.floor(_event_micros() / 1000).cast("bigint"))
    return e.select("event_id", millis_to_epoch(ms).alias("created_epoch"))


@query("timestamp_mixed", """SELECT event_id,
    CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00')
         WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:00')
         WHEN 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at FROM events""")
def _(spark, sf):
    e, k = b.table(spark, sf, "events").select("event_id", "ts"), F.col("event_id") % 6
    f = lambda fmt: F.date_format("ts", fmt)
    text = (F.when(k == 0, f("yyyy-MM-dd HH:mm:ss")).when(k == 1, f("yyyy-MM-dd HH:mm"))
            .when(k == 2, f("yyyy-MM-dd")).when(k == 3, f("dd-MM-yyyy HH:mm"))
            .when(k == 4, "yesterday").otherwise(f("yyyy-MM-dd'T'HH:mm:ss")))
    return e.select("event_id", standard_date_text(text).alias("created_at"))


@query("timestamp_repair", f"""SELECT event_id,
    CASE WHEN event_id % 3 = 2 THEN NULL ELSE {_TS} END AS created_at,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS title FROM events""")
def _(spark, sf):
    e, k = b.table(spark, sf, "events"), F.col("event_id")
    sheet = e.select(
        "event_id",
        F.when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        F.when(k % 3 == 1, _event_seconds().cast("string")).alias("creationtimestamp"),
        F.when(k % 5 != 0, F.col("event_type")).alias("title"),
    )
    return harmonize_posts(sheet)


@query("harmonize_comments", f"""SELECT event_id,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE {_TS} END AS created_at,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS text FROM events""")
def _(spark, sf):
    e = b.table(spark, sf, "events").select("event_id", "ts", "event_type")
    k = F.col("event_id")
    return harmonize_comments(e.select(
        "event_id",
        F.when(k % 4 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("n.d.").alias("created_at"),
        F.when(k % 5 != 0, F.col("event_type")).alias("text")))
