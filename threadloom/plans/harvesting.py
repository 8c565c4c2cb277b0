"""Log lines, sessions, feed projections, caps, selection, documents and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.text import target_name
from threadloom.operators.harvest import (
    capped_harvest, export_lines, feed_order, feed_posts, harvest_documents,
    marker_sessions, parse_log, parse_tally, project_comments, project_posts, select_harvest,
    session_counts,
)
from threadloom.operators.ordering import first_n
from threadloom.operators.reports import harvest_report
from threadloom.plans import bindings as b
from threadloom.plans.registry import query

_POST_OBJECT = """json_object('post ID', post_id, 'subreddit name', community, 'title', title,
      'body/self-text', body, 'author', author, 'creation timestamp', created_epoch,
      'score/upvotes', score, 'number of comments', num_comments, 'URL/permalink', permalink)"""
_COMMENT_OBJECT = """json_object('comment ID', comment_id, 'parent post ID', post_id,
      'parent comment ID', parent_id, 'subreddit', community, 'comment text', text, 'author', author,
      'timestamp', created_epoch, 'score/upvotes', score)"""


@query("log_export", f"""WITH {b.POSTS}, {b.COMMENTS}
  SELECT 0 AS section, ord, 'POST_ROW:' || CAST({_POST_OBJECT} AS VARCHAR) AS value FROM posts
  UNION ALL
  SELECT 1, ord, 'COMMENT_ROW:' || CAST({_COMMENT_OBJECT} AS VARCHAR) FROM comments""")
def _(spark, sf):
    return export_lines(b.posts(spark, sf), b.comments(spark, sf))


_POST_COLUMNS = "post_id, community, title, body, author, created_epoch, score, num_comments, permalink"
_EMPTY_POST = ", ".join(f"NULL AS {c.strip()}" for c in _POST_COLUMNS.split(","))


@query("log_parse_strict", f"""WITH {b.POSTS}
  SELECT author AS source, ord, {_POST_COLUMNS} FROM posts WHERE ord % 8 IN (0, 1)
  UNION ALL
  SELECT author, ord, {_EMPTY_POST} FROM posts WHERE ord % 8 = 5""")
def _(spark, sf):
    return parse_log(b.noisy_lines(spark, sf), "strict").posts


@query("log_parse_loose", f"""WITH {b.POSTS}
  SELECT author AS source, ord, {_POST_COLUMNS} FROM posts WHERE ord % 8 IN (0, 1, 3, 4)""")
def _(spark, sf):
    return parse_log(b.noisy_lines(spark, sf), "loose").posts


@query("log_parse_comments", f"""WITH {b.POSTS}
  SELECT author AS source, ord, 't1_' || ord AS comment_id, post_id, post_id AS parent_id, community,
         body AS text, author, created_epoch, score FROM posts WHERE ord % 8 = 6""")
def _(spark, sf):
    return parse_log(b.noisy_lines(spark, sf), "strict").comments


@query("log_quarantine", f"""WITH {b.POSTS}
  SELECT author AS source, ord AS line_no, 'unreadable post object' AS reason
  FROM posts WHERE ord % 8 IN (2, 4)""")
def _(spark, sf):
    return parse_log(b.noisy_lines(spark, sf), "strict").quarantine


@query("log_tally", f"""WITH {b.POSTS}
  SELECT author AS source,
         CAST(sum(CASE WHEN ord % 8 IN (0, 1, 5) THEN 1 ELSE 0 END) AS BIGINT) AS posts,
         CAST(sum(CASE WHEN ord % 8 = 6 THEN 1 ELSE 0 END) AS BIGINT) AS comments,
         CAST(sum(CASE WHEN ord % 8 IN (2, 4) THEN 1 ELSE 0 END) AS BIGINT) AS rejected
  FROM posts GROUP BY author""")
def _(spark, sf):
    return parse_tally(b.noisy_lines(spark, sf), "strict")


# --- sessions -----------------------------------------------------------------------------


def _sessions(spark, sf, **options):
    return marker_sessions(b.event_lines(spark, sf), "loose", **options)


def _record_columns(sessions):
    return sessions.select(
        "source", "session_no", F.col("line_no").alias("ord"), "kind",
        F.coalesce(F.col("post")["post ID"], F.col("comment")["comment ID"]).alias("id"),
        F.coalesce(F.col("post")["score/upvotes"], F.col("comment")["score/upvotes"])
        .cast("bigint").alias("score"), "complete")


@query("marker_sessions", f"""WITH {b.EVENT_SESSIONS}
  SELECT source, session_no, ord, kind, id, score FROM sessions WHERE complete""")
def _(spark, sf):
    return _record_columns(_sessions(spark, sf)).drop("complete")


@query("marker_sessions_incomplete", f"""WITH {b.EVENT_SESSIONS}
  SELECT source, session_no, ord, kind, id, score, complete FROM sessions""")
def _(spark, sf):
    return _record_columns(_sessions(spark, sf, emit_incomplete=True))


@query("session_counts", f"""WITH {b.EVENT_SESSIONS}
  SELECT source, session_no,
         CAST(sum(CASE WHEN kind = 'post' THEN 1 ELSE 0 END) AS BIGINT) AS total_posts,
         CAST(sum(CASE WHEN kind = 'comment' THEN 1 ELSE 0 END) AS BIGINT) AS total_comments
  FROM sessions WHERE complete GROUP BY source, session_no""")
def _(spark, sf):
    return session_counts(_sessions(spark, sf))


# --- feed ------------------------------------------------------------------------------------


@query("feed_projection_posts", f"""WITH {b.POSTS}
  SELECT post_id, CASE WHEN ord % 5 >= 2 THEN community ELSE 'demo' END AS community, title,
         CASE WHEN ord % 6 <> 0 THEN body ELSE '' END AS body, author,
         CASE WHEN ord % 7 <> 0 THEN created_epoch ELSE 0 END AS created_epoch, score, num_comments,
         'https://reddit.com' || permalink AS permalink, ord FROM posts""")
def _(spark, sf):
    return project_posts(b.feed_posts(spark, sf), "demo")


@query("feed_projection_comments", f"""WITH {b.COMMENTS}
  SELECT comment_id, post_id, parent_id, CASE WHEN ord % 5 >= 2 THEN community ELSE 'demo' END AS community,
         text, author, CASE WHEN ord % 7 <> 0 THEN created_epoch ELSE 0 END AS created_epoch, score, ord
  FROM comments""")
def _(spark, sf):
    return project_comments(b.feed_comments(spark, sf), "demo")


@query("target_names", """SELECT doc_id,
    CASE WHEN doc_id % 5 = 0 THEN 'formula1' ELSE lang || source END AS target FROM documents""")
def _(spark, sf):
    d = b.table(spark, sf, "documents")
    typed = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("  r/"), F.upper("lang"), "source", F.lit(" \t"))
                   ).otherwise(F.lit("  "))
    return d.select("doc_id", target_name(typed).alias("target"))


def _caps_sql(post_limit: int, per_post: int, stop_total: int) -> str:
    return f"""WITH {b.POSTS}, {b.COMMENTS},
  feed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY ord) AS rn
                          FROM posts) x WHERE rn <= {post_limit}),
  taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ord) AS rn
                           FROM comments) x WHERE rn <= {per_post}),
  per_post AS (SELECT f.community AS feed, f.post_id, f.ord AS post_ord, count(t.comment_id) AS n
               FROM feed f JOIN taken t ON t.post_id = f.post_id WHERE f.num_comments > 0 GROUP BY ALL),
  running AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feed ORDER BY post_ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per_post)
  SELECT t.post_id, t.comment_id, t.parent_id, t.community, t.text, t.author, t.created_epoch, t.score, t.ord
  FROM taken t JOIN running r ON r.post_id = t.post_id WHERE r.before < {stop_total}"""


@query("harvest_caps", _caps_sql(100, 50, 550))
def _(spark, sf):
    return capped_harvest(b.posts(spark, sf), b.comments(spark, sf)).comments


@query("harvest_caps_tight", _caps_sql(30, 3, 40))
def _(spark, sf):
    return capped_harvest(b.posts(spark, sf), b.comments(spark, sf), 30, 3, 40).comments


@query("feed_first_posts", f"""WITH {b.POSTS}
  SELECT post_id, community, ord FROM (
    SELECT *, row_number() OVER (PARTITION BY community ORDER BY ord) AS rn FROM posts) x WHERE rn <= 100""")
def _(spark, sf):
    return feed_posts(b.posts(spark, sf)).select("post_id", "community", "ord")


for _sort, _by in (("top", "score DESC, ord"), ("new", "created_epoch DESC, ord"), ("hot", "ord"),
                   ("rising", "ord")):
    def _sorted(spark, sf, sort=_sort):
        return first_n(b.posts(spark, sf), ["community"], feed_order(sort), 100, rank="place").select(
            "community", "place", "post_id", "score", "created_epoch")

    query(f"harvest_select_{_sort}", f"""WITH {b.POSTS}
      SELECT community, place, post_id, score, created_epoch FROM (
        SELECT *, row_number() OVER (PARTITION BY community ORDER BY {_by}) AS place FROM posts) x
      WHERE place <= 100""")(_sorted)


@query("harvest_select_post", f"""WITH {b.COMMENTS}
  SELECT comment_id, post_id, text FROM comments
  WHERE post_id = 't3_0'""")
def _(spark, sf):
    chosen = select_harvest(b.posts(spark, sf), b.comments(spark, sf), "post", post_id="t3_0",
                            include_comments=True)
    return chosen.comments.select("comment_id", "post_id", "text")


@query("harvest_select_target", f"""WITH {b.POSTS}, {b.COMMENTS}
  SELECT 'posts' AS kind, post_id AS id FROM posts WHERE community = 'en'
  UNION ALL SELECT 'comments', comment_id FROM comments WHERE community = 'en'""")
def _(spark, sf):
    both = select_harvest(b.posts(spark, sf), b.comments(spark, sf), "both", target=" r/EN ")
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return row(both.posts, "posts", "post_id").unionByName(row(both.comments, "comments", "comment_id"))


@query("harvest_random", f"""WITH {b.POSTS},
  feed AS (SELECT * FROM posts ORDER BY score DESC NULLS LAST, ord LIMIT 100)
  SELECT post_id, community, score FROM feed ORDER BY md5('7:' || post_id), ord LIMIT 1""")
def _(spark, sf):
    chosen = select_harvest(b.posts(spark, sf), b.comments(spark, sf), "post", sort="top", seed=7)
    return chosen.posts.select("post_id", "community", "score")


# --- documents and text reports -------------------------------------------------------------------

_PART = 100


@query("harvest_document", f"""WITH {b.GAPPY},
  p AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY ord) - 1 AS nth FROM gappy_posts),
  c AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY ord) - 1 AS nth FROM gappy_comments),
  pd AS (SELECT community, CAST(floor(nth / {_PART}) AS BIGINT) AS part,
                coalesce(string_agg(post_id, ',' ORDER BY ord), '') AS post_ids, count(*) AS n_posts,
                string_agg(title, chr(10) ORDER BY ord) AS titles FROM p GROUP BY 1, 2),
  cd AS (SELECT community, CAST(floor(nth / {_PART}) AS BIGINT) AS part,
                string_agg(comment_id, ',' ORDER BY ord) AS comment_ids, count(*) AS n_comments,
                string_agg(text, chr(10) ORDER BY ord) AS texts FROM c GROUP BY 1, 2),
  tp AS (SELECT community, count(*) AS n FROM gappy_posts GROUP BY 1),
  tc AS (SELECT community, count(*) AS n FROM gappy_comments GROUP BY 1)
  SELECT coalesce(pd.community, cd.community) AS community, coalesce(pd.part, cd.part) AS part,
         coalesce(pd.community, cd.community) AS subreddit, 'both' AS mode, '20240101_000000' AS timestamp,
         coalesce(tp.n, 0) AS total_posts, coalesce(tc.n, 0) AS total_comments,
         coalesce(post_ids, '') AS post_ids, coalesce(titles, '') AS titles,
         coalesce(comment_ids, '') AS comment_ids, coalesce(texts, '') AS texts
  FROM pd FULL JOIN cd ON cd.community IS NOT DISTINCT FROM pd.community AND cd.part = pd.part
  LEFT JOIN tp ON tp.community IS NOT DISTINCT FROM coalesce(pd.community, cd.community)
  LEFT JOIN tc ON tc.community IS NOT DISTINCT FROM coalesce(pd.community, cd.community)""")
def _(spark, sf):
    docs = harvest_documents(b.gappy_posts(spark, sf), b.gappy_comments(spark, sf), ["community"], "both",
                             F.lit("20240101_000000"), _PART)
    joined = lambda rows, field, sep: F.array_join(F.transform(rows, lambda r: r[field]), sep)
    return docs.select(
        "community", "part", "metadata.subreddit", "metadata.mode", "metadata.timestamp",
        "metadata.total_posts", "metadata.total_comments",
        joined("posts", "post ID", ",").alias("post_ids"), joined("posts", "title", "\n").alias("titles"),
        joined("comments", "comment ID", ",").alias("comment_ids"),
        joined("comments", "comment text", "\n").alias("texts"))


_DASHES = "-" * 50


@query("harvest_report_text", f"""WITH {b.POSTS}, {b.COMMENTS},
  keys AS (SELECT community FROM posts UNION SELECT community FROM comments)
  SELECT community, 0 AS section, CAST(0 AS BIGINT) AS ord,
         '=== HARVEST REPORT: r/' || community || ' [BOTH] - 20240101_000000 ===' || chr(10) AS line FROM keys
  UNION ALL SELECT DISTINCT community, 1, CAST(0 AS BIGINT), '--- POSTS ---' FROM posts
  UNION ALL SELECT community, 2, ord, '[' || post_id || '] ' || title || chr(10) || 'Author: ' || author
         || ' | Score: ' || score || ' | Comments: ' || num_comments || chr(10) || 'URL: ' || permalink
         || CASE WHEN body <> '' THEN chr(10) || 'Body: ' || body ELSE '' END || chr(10) || '{_DASHES}' FROM posts
  UNION ALL SELECT DISTINCT community, 3, CAST(0 AS BIGINT), chr(10) || '--- COMMENTS ---' FROM comments
  UNION ALL SELECT community, 4, ord, '[' || comment_id || '] Post: ' || post_id || ' | Author: ' || author
         || ' | Score: ' || score || chr(10) || 'Text: ' || text || chr(10) || '{_DASHES}' FROM comments""")
def _(spark, sf):
    return harvest_report(b.posts(spark, sf), b.comments(spark, sf), ["community"], F.col("community"),
                          "both", F.lit("20240101_000000"))
