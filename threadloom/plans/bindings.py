"""The given tables as posts, comments, annotations and log lines.

Each binding has the Spark frame and, next to it, the same thing as a SQL
common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions.bind import bind

EPOCH0 = 1_700_000_000
LOGS = 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(
        F.concat(F.lit("t3_"), key).alias("post_id"),
        F.col("lang").alias("community"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        F.col("source").alias("author"),
        (F.lit(EPOCH0) + F.col("doc_id") * 60).alias("created_epoch"),
        F.col("n_chars").alias("score"),
        (F.col("doc_id") % 4).alias("num_comments"),
        F.concat(F.lit("/r/"), "lang", F.lit("/comments/"), key).alias("permalink"),
        F.col("doc_id").alias("ord"),
    )


POSTS = f"""posts AS (
  SELECT 't3_' || doc_id AS post_id, lang AS community, split_part(text, chr(10), 1) AS title,
         text AS body, source AS author, {EPOCH0} + doc_id * 60 AS created_epoch,
         n_chars AS score, doc_id % 4 AS num_comments,
         '/r/' || lang || '/comments/' || doc_id AS permalink, doc_id AS ord
  FROM documents)"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as comments; the community is that of the parent post."""
    c = table(spark, sf, "conversations")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    thread = F.col("conv_id").cast("string")
    return c.join(d, "conv_id", "left").select(
        F.concat(F.lit("t1_"), thread, F.lit("_"), F.col("turn").cast("string")).alias("comment_id"),
        F.concat(F.lit("t3_"), thread).alias("post_id"),
        F.when(F.col("turn") == 0, F.concat(F.lit("t3_"), thread)).otherwise(
            F.concat(F.lit("t1_"), thread, F.lit("_"), (F.col("turn") - 1).cast("string"))
        ).alias("parent_id"),
        F.coalesce("lang", F.lit("unknown")).alias("community"),
        "text",
        F.col("role").alias("author"),
        (F.lit(EPOCH0) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_epoch"),
        F.length("text").cast("bigint").alias("score"),
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("ord"),
    )


COMMENTS = f"""comments AS (
  SELECT 't1_' || conv_id || '_' || turn AS comment_id, 't3_' || conv_id AS post_id,
         CASE WHEN turn = 0 THEN 't3_' || conv_id
              ELSE 't1_' || conv_id || '_' || (turn - 1) END AS parent_id,
         coalesce(d.lang, 'unknown') AS community, c.text AS text, c.role AS author,
         {EPOCH0} + conv_id * 3600 + turn * 60 AS created_epoch,
         length(c.text) AS score, conv_id * 1000000 + turn AS ord
  FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id)"""


def gappy_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of which some have no community and some no id."""
    k = F.col("ord")
    return posts(spark, sf).withColumns({"community": F.when(k % 11 != 0, F.col("community")),
                                         "post_id": F.when(k % 13 != 0, F.col("post_id"))})


def gappy_comments(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf).withColumn("community", F.when(F.col("ord") % 11 != 0, F.col("community")))


GAPPY = f"""{POSTS}, {COMMENTS}, gappy_posts AS (
  SELECT * REPLACE (CASE WHEN ord % 11 <> 0 THEN community END AS community,
                    CASE WHEN ord % 13 <> 0 THEN post_id END AS post_id) FROM posts),
gappy_comments AS (
  SELECT * REPLACE (CASE WHEN ord % 11 <> 0 THEN community END AS community) FROM comments)"""


def payload(spark: SparkSession, sf: str) -> DataFrame:
    from threadloom.operators.batching import comment_payload, post_payload

    return post_payload(posts(spark, sf)).unionByName(comment_payload(comments(spark, sf)))


PAYLOAD = f"""{POSTS}, {COMMENTS}, payload AS (
  SELECT community, 'posts' AS kind, post_id AS id,
         coalesce(title, '') || ' ' || coalesce(body, '') AS text, ord FROM posts
  UNION ALL
  SELECT community, 'comments', comment_id, coalesce(text, ''), ord FROM comments)"""


def gappy_payload(spark: SparkSession, sf: str) -> DataFrame:
    from threadloom.operators.batching import comment_payload, post_payload

    return post_payload(gappy_posts(spark, sf)).unionByName(comment_payload(gappy_comments(spark, sf)))


GAPPY_PAYLOAD = f"""{GAPPY}, payload AS (
  SELECT community, 'posts' AS kind, coalesce(post_id, 'nan') AS id,
         coalesce(title, '') || ' ' || coalesce(body, '') AS text, ord FROM gappy_posts
  UNION ALL
  SELECT community, 'comments', comment_id, coalesce(text, ''), ord FROM gappy_comments)"""


def _case(n: Column, *values: str | None) -> Column:
    out = F.when(n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(n == i, v)
    return out


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Rule labels of every post and comment; every word of a text is one of its topics."""
    rows, n = payload(spark, sf), F.col("n")
    return bind(rows, text=F.col("text"), n=F.length("text")).select(
        "community", "kind", "id", "ord",
        _case(n % 7, " positive ", "NEGATIVE", "Neutral", "Mixed", None, "Positive", "negative")
        .alias("sentiment"),
        _case(n % 5, "High", "Low", "Medium ", "Toxict", None).alias("toxicity"),
        F.when(n % 9 != 0, F.concat(F.lit("['"), F.replace("text", F.lit(" "), F.lit("', '")),
                                    F.lit("']"))).alias("topics"),
    )


SWEEP = f"""{PAYLOAD}, sweep AS (
  SELECT community, kind, id, ord,
         CASE length(text) % 7 WHEN 0 THEN ' positive ' WHEN 1 THEN 'NEGATIVE' WHEN 2 THEN 'Neutral'
              WHEN 3 THEN 'Mixed' WHEN 5 THEN 'Positive' WHEN 6 THEN 'negative' END AS sentiment,
         CASE length(text) % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium '
              WHEN 3 THEN 'Toxict' END AS toxicity,
         CASE WHEN length(text) % 9 <> 0
              THEN '[''' || replace(text, ' ', ''', ''') || ''']' END AS topics
  FROM payload)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The labels table as an annotator of posts; some rows carry fill labels."""
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    fill = _case(F.col("doc_id") % 10, "Skipped", "unknown")
    return lab.join(d, "doc_id").select(
        F.col("lang").alias("community"), F.lit("posts").alias("kind"),
        F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("ord"),
        F.coalesce(fill, F.when(F.col("quality") == 1, "Positive ").otherwise("negative"))
        .alias("sentiment"),
        F.when(F.col("doc_id") % 10 == 1, "Skipped")
        .when(F.col("doc_id") % 10 != 3, F.when(F.col("toxic") == 1, "High").otherwise("low"))
        .alias("toxicity"),
    )


LABELLED = """labelled AS (
  SELECT d.lang AS community, 'posts' AS kind, 't3_' || l.doc_id AS id, l.doc_id AS ord,
         CASE l.doc_id % 10 WHEN 0 THEN 'Skipped' WHEN 1 THEN 'unknown'
              ELSE CASE WHEN quality = 1 THEN 'Positive ' ELSE 'negative' END END AS sentiment,
         CASE l.doc_id % 10 WHEN 1 THEN 'Skipped' WHEN 3 THEN NULL
              ELSE CASE WHEN toxic = 1 THEN 'High' ELSE 'low' END END AS toxicity
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def two_models(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations of a slice and a sweep model, with the segments that are easily lost.

    The slice model skipped all comments, labels of the language ``es`` carry
    other ids than the sweep's, and posts of ``fr`` have no community.
    """
    columns = ["community", "kind", "id", "ord", "sentiment", "toxicity"]
    full = sweep(spark, sf).select(*columns)
    skipped = full.where("kind = 'comments'").withColumns({"sentiment": F.lit("Skipped"), "toxicity": F.lit("Skipped")})
    first = labelled(spark, sf).select(*columns).withColumn(
        "id", F.when(F.col("community") == "es", F.concat("id", F.lit("x"))).otherwise(F.col("id"))).unionByName(skipped)
    both = first.withColumn("model", F.lit("slice")).unionByName(full.withColumn("model", F.lit("sweep")))
    return both.withColumn("community", F.when((F.col("community") != "fr") | (F.col("kind") != "posts"),
                                               F.col("community")))


TWO_MODELS = """first_model AS (
  SELECT CASE WHEN community <> 'fr' THEN community END AS community, kind,
         CASE WHEN community = 'es' THEN id || 'x' ELSE id END AS id, sentiment, toxicity FROM labelled
  UNION ALL SELECT community, kind, id, 'Skipped', 'Skipped' FROM sweep WHERE kind = 'comments'),
second_model AS (
  SELECT CASE WHEN community <> 'fr' OR kind <> 'posts' THEN community END AS community, kind, id, sentiment, toxicity
  FROM sweep)"""


def feed_posts(spark: SparkSession, sf: str) -> DataFrame:
    """API-shaped posts with missing and blank fields."""
    p, k = posts(spark, sf), F.col("ord")
    return p.select(
        F.col("post_id").alias("id"),
        _case(k % 5, None, "").alias("x"), "community", "title",
        F.when(k % 6 != 0, F.col("body")).alias("body"), F.col("author").alias("authorName"),
        F.when(k % 7 != 0, F.col("created_epoch") * 1000 + 999).cast("double").alias("createdAt"),
        "score", F.col("num_comments").alias("numberOfComments"), "permalink", "ord",
    ).withColumn("subredditName", F.when(k % 5 >= 2, F.col("community")).otherwise(F.col("x"))).drop(
        "x", "community")


def feed_comments(spark: SparkSession, sf: str) -> DataFrame:
    c, k = comments(spark, sf), F.col("ord")
    return c.select(
        F.col("comment_id").alias("id"), F.col("post_id").alias("postId"),
        F.col("parent_id").alias("parentId"),
        F.when(k % 5 >= 2, F.col("community")).otherwise("").alias("subredditName"),
        F.col("text").alias("body"), F.col("author").alias("authorName"),
        F.when(k % 7 != 0, F.col("created_epoch") * 1000 + 1).cast("double").alias("createdAt"),
        "score", "ord",
    )


def noisy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines ``source, line_no, value``: posts of a source, with damaged and odd lines.

    By ``doc_id`` modulo 8: 0 plain, 1 leading blanks, 2 cut-off object, 3 text
    before the prefix, 4 text after the object, 5 an empty object, 6 a comment
    line, 7 a line without a record.
    """
    from threadloom.constants import RAW_COMMENT_FIELDS, RAW_POST_FIELDS
    from threadloom.operators.harvest import raw_json

    p = posts(spark, sf)
    post = F.concat(F.lit("POST_ROW:"), raw_json(RAW_POST_FIELDS))
    as_comment = p.withColumns({
        "comment_id": F.concat(F.lit("t1_"), "ord"), "parent_id": F.col("post_id"), "text": F.col("body")})
    comment = F.concat(F.lit("COMMENT_ROW:"), raw_json(RAW_COMMENT_FIELDS))
    value = _case_columns(
        F.col("ord") % 8, post, F.concat(F.lit("  \t "), post),
        F.concat(F.lit("POST_ROW:{\"post ID\": \""), "post_id"),
        F.concat(F.lit("[app] POST_ROW: x "), post.substr(F.lit(10), F.length(post))),
        F.concat(post, F.lit(" trailing")), F.lit("POST_ROW:{}"), comment,
        F.lit("###--- END_POSTS_EXPORT ---###"),
    )
    return as_comment.select(F.col("author").alias("source"), F.col("ord").alias("line_no"),
                             value.alias("value"), "post_id", "comment_id").drop("post_id", "comment_id")


def _case_columns(n: Column, *values: Column) -> Column:
    out = F.when(n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(n == i, v)
    return out


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All events as lines of sixteen console logs: purchases end a session, views are
    posts, clicks and signups are comments, errors are noise."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    k = F.col("event_id").cast("string")
    raw = lambda prefix, key: F.concat(
        F.lit(f'{prefix}{{"{key}":"e'), k, F.lit('","score/upvotes":'),
        F.get_json_object("props", "$.k"), F.lit("}"))
    kind = F.col("event_type")
    value = (
        F.when(kind == "purchase", "=== END STREAM HARVEST: r/demo ===")
        .when(kind == "view", raw("POST_ROW:", "post ID"))
        .when(kind.isin("click", "signup"), raw("COMMENT_ROW:", "comment ID"))
        .otherwise(F.concat(F.lit("error "), k))
    )
    log = (F.col("user_id") % LOGS).cast("string")
    return e.select(F.concat(F.lit("app"), log).alias("source"),
                    F.col("event_id").alias("line_no"), value.alias("value"))


EVENT_SESSIONS = f"""marked AS (
  SELECT 'app' || (user_id % {LOGS}) AS source, event_id AS ord, event_type, props,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_end
  FROM events),
numbered AS (
  SELECT *, coalesce(sum(is_end) OVER (PARTITION BY source ORDER BY ord
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session_no,
         sum(is_end) OVER (PARTITION BY source) AS closed
  FROM marked),
sessions AS (
  SELECT source, ord, CAST(session_no AS BIGINT) AS session_no, session_no < closed AS complete,
         CASE WHEN event_type = 'view' THEN 'post' ELSE 'comment' END AS kind,
         'e' || ord AS id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS score
  FROM numbered WHERE event_type IN ('view', 'click', 'signup'))"""


