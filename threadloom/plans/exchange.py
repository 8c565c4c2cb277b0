"""Readers, sinks and streams: data derived from the tables is written to the shared folder and
read back through the library's own sources."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from threadloom.constants import DATASET_DOCUMENT
from threadloom.functions.dates import epoch_to_text
from threadloom.operators.annotate import Model, audit_rows, call_annotator, row_requests
from threadloom.operators.clean import clean_posts
from threadloom.operators.harvest import (
    comments_from_raw, document_comments, document_posts, harvest_documents, marker_sessions, parse_log,
    posts_from_raw, project_comments, project_posts,
)
from threadloom.operators.ordering import with_ordinal
from threadloom.plans import bindings as b
from threadloom.plans import rules
from threadloom.plans.harvesting import _POST_COLUMNS
from threadloom.plans.registry import query
from threadloom.session import new_path, ship_package, stage_table
from threadloom.sources.documents import read_documents, read_feed_comments, read_feed_posts
from threadloom.sources.logs import read_lines
from threadloom.sources.sheets import read_annotations, read_comments, read_csv, read_posts
from threadloom.sources.sinks import (
    append_audit, export_log, read_sheet, sheet_headers, write_annotations, write_csv, write_documents, write_report,
)
from threadloom.sources.trail import append_stream_once, read_trail
from threadloom.sources.types import column_types
from threadloom.streaming.harvest import (
    append_stream, finished_sessions, flush_open, harvest_stream, open_sessions, stream_lines, stream_records,
    tail_harvest,
)
from threadloom.streaming.tail import file_system

_SESSION_DOCUMENT = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("session_no", T.LongType()),
    *[f for f in DATASET_DOCUMENT.fields if f.name in ("posts", "comments")]])
_AT = "strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(created_epoch), '%Y-%m-%d %H:%M:%S')"


@query("csv_round_trip", f"""WITH {b.POSTS}
  SELECT post_id, community, nullif(title, '') AS title, body, author, {_AT} AS created_at, score,
         num_comments, permalink, row_number() OVER (ORDER BY ord) - 1 AS ord FROM posts""")
def _(spark, sf):
    path = new_path(spark, "posts-csv")
    in_order = clean_posts(b.posts(spark, sf)).repartitionByRange("ord").sortWithinPartitions("ord")
    write_csv(in_order, path, sheet_headers("posts"))
    return read_posts(spark, path).drop("file")


@query("sheet_types", f"""WITH {b.POSTS}
  SELECT * FROM (VALUES ('post_id', 0, 'text'), ('community', 1, 'text'), ('title', 2, 'text'), ('body', 3, 'text'),
    ('author', 4, 'text'), ('created_at', 5, 'text'), ('score', 6, 'integer'), ('num_comments', 7, 'float'),
    ('ratio', 8, 'float'), ('pinned', 9, 'truth'), ('flair', 10, 'missing')) t("column", place, type),
  LATERAL (SELECT CASE "column" WHEN 'num_comments' THEN count_if(ord % 4 = 0) WHEN 'flair' THEN count(*)
                  WHEN 'title' THEN count_if(title = '') ELSE 0 END AS missing FROM posts)""")
def _(spark, sf):
    """A sheet with a column for each type; what is missing in it is an empty cell."""
    path, k = new_path(spark, "types-csv"), F.col("ord")
    rows = b.posts(spark, sf).select(
        "post_id", "community", "title", "body", "author", epoch_to_text(F.col("created_epoch")).alias("created_at"), "score",
        F.when(k % 4 != 0, F.col("num_comments")).alias("num_comments"), (k / 4).alias("ratio"), (k % 2 == 0).alias("pinned"),
        F.lit(None).cast("string").alias("flair"))
    write_csv(rows, path)
    return column_types(read_csv(spark, [path], rows.columns, pandas_na=False).drop("file", "seq"))


@query("optional_source", f"""WITH {b.COMMENTS} SELECT comment_id, community, text, score FROM comments""")
def _(spark, sf):
    path = new_path(spark, "comments-csv")
    c = b.comments(spark, sf).withColumn("created_at", F.lit(""))
    write_csv(c, path, sheet_headers("comments"))
    present = read_comments(spark, path)
    missing = read_comments(spark, path + "-missing")
    return present.unionByName(missing, allowMissingColumns=True).select("comment_id", "community", "text", "score")


_PLACED = """(row_number() OVER (PARTITION BY community ORDER BY ord) - 1) // 100 * 4294967296
         + (row_number() OVER (PARTITION BY community ORDER BY ord) - 1) % 100 AS ord"""


def _documents_read(spark, sf):
    path = new_path(spark, "documents")
    write_documents(harvest_documents(b.posts(spark, sf), b.comments(spark, sf), ["community"], part_rows=100), path)
    return read_documents(spark, f"{path}/*.json", multi_line=False)


@query("json_document_round_trip", f"""WITH {b.POSTS} SELECT {_POST_COLUMNS}, {_PLACED} FROM posts""")
def _(spark, sf):
    return document_posts(_documents_read(spark, sf))


@query("json_document_comments", f"""WITH {b.COMMENTS}
  SELECT comment_id, post_id, parent_id, community, text, author, created_epoch, score, {_PLACED} FROM comments""")
def _(spark, sf):
    return document_comments(_documents_read(spark, sf))


def _exported(spark, sf):
    """All posts and comments as console logs, one per community, read as numbered lines."""
    path = new_path(spark, "logs")
    lines = export_log(b.posts(spark, sf), b.comments(spark, sf), F.col("community"), ["community"])
    write_report(lines, path, ["section", "ord"], ["community"])
    return read_lines(spark, path, F.regexp_extract(F.col("_metadata.file_path"), "community=([^/]+)/", 1))


@query("log_file_round_trip", f"""WITH {b.POSTS}
  SELECT community AS source, row_number() OVER (PARTITION BY community ORDER BY ord) AS nth,
         post_id, title, body, author, created_epoch, score, num_comments, permalink FROM posts""")
def _(spark, sf):
    posts = with_ordinal(parse_log(_exported(spark, sf)).posts.drop("community"), ["source"], "ord", out="nth")
    return posts.withColumn("nth", F.col("nth") + 1).drop("ord")


@query("log_file_sessions", f"""WITH {b.POSTS}, {b.COMMENTS}, records AS (
    SELECT community, 0 AS section, ord, post_id AS id, title AS text FROM posts
    UNION ALL SELECT community, 1, ord, comment_id, text FROM comments)
  SELECT community AS source, 0 AS session_no, CASE section WHEN 0 THEN 'post' ELSE 'comment' END AS kind, id, text,
         row_number() OVER (PARTITION BY community ORDER BY section, ord) - 1 AS nth FROM records""")
def _(spark, sf):
    """Posts and comments of the export come back in order, all within one finished session."""
    rows = marker_sessions(_exported(spark, sf))
    return with_ordinal(rows, ["source"], "line_no", out="nth").select(
        "source", "session_no", "kind", F.coalesce("post.post ID", "comment.comment ID").alias("id"),
        F.coalesce("post.title", "comment.comment text").alias("text"), "nth")


def _dumped(spark, feed):
    """A feed dump: files in feed order, dealt by range, so that a file's length doesn't grow with the feed."""
    path = new_path(spark, "feed")
    feed.repartitionByRange("ord").sortWithinPartitions("ord").drop("ord").write.json(path)
    return f"{path}/*.json"


@query("feed_dump_round_trip", f"""WITH {b.POSTS}
  SELECT CASE WHEN ord % 13 <> 0 THEN post_id END AS post_id,
         CASE WHEN ord % 5 >= 2 THEN community ELSE 'demo' END AS community, title,
         CASE WHEN ord % 6 <> 0 THEN body ELSE '' END AS body, author,
         CASE WHEN ord % 7 <> 0 THEN created_epoch ELSE 0 END AS created_epoch, score, num_comments,
         'https://reddit.com' || permalink AS permalink, row_number() OVER (ORDER BY ord) - 1 AS ord FROM posts""")
def _(spark, sf):
    feed = b.feed_posts(spark, sf).withColumn("id", F.when(F.col("ord") % 13 != 0, F.col("id")))
    return project_posts(read_feed_posts(spark, _dumped(spark, feed)), "demo")


@query("feed_dump_comments", f"""WITH {b.COMMENTS}
  SELECT CASE WHEN ord % 13 <> 0 THEN 't1_' || ord % 7 END AS comment_id, post_id, parent_id,
         CASE WHEN ord % 5 >= 2 THEN community ELSE 'demo' END AS community, text, author,
         CASE WHEN ord % 7 <> 0 THEN created_epoch ELSE 0 END AS created_epoch, score,
         row_number() OVER (ORDER BY ord) - 1 AS ord FROM comments""")
def _(spark, sf):
    """Comments with NULL and repeated ids: only their place tells them apart."""
    repeated = F.concat(F.lit("t1_"), (F.col("ord") % 7).cast("string"))
    feed = b.feed_comments(spark, sf).withColumn("id", F.when(F.col("ord") % 13 != 0, repeated))
    return project_comments(read_feed_comments(spark, _dumped(spark, feed)), "demo")


_SHEETS = f"""WITH {b.SWEEP}, placed AS (
    SELECT *, CASE WHEN ord % 11 <> 0 THEN CASE WHEN ord % 13 = 0 THEN 'twice' ELSE community || ':' || id END END AS key,
           row_number() OVER (ORDER BY kind, ord, id) - 1 AS nth FROM sweep)
  SELECT kind, key AS id, sentiment, toxicity, CASE WHEN topics IS NOT NULL THEN 'len ' || length(topics) END AS topics,
         nth AS ord FROM placed"""


@query("header_drift_sheets", _SHEETS)
def _(spark, sf):
    """Posts sheets carry the usual headers, comments sheets the drifted ones; some rows have no id or share one.

    A sheet's rows lie in many files; those without an id of their own are matched by their place.
    """
    folder, k = new_path(spark, "sheets"), F.col("ord")
    key = F.when(k % 11 != 0, F.when(k % 13 == 0, "twice").otherwise(F.concat_ws(":", "community", "id")))
    rows = stage_table(b.sweep(spark, sf).select(
        "kind", "ord", F.col("id").alias("own"), key.alias("id"), "sentiment", "toxicity",
        F.concat(F.lit("len "), F.length("topics")).alias("topics")), "labels")
    names = {"sentiment": "Sentiment", "toxicity": "Toxicity", "topics": "Topic"}
    for kind, header in (("posts", "post ID"), ("comments", "comment ID")):
        in_order = rows.where(F.col("kind") == kind).repartitionByRange("ord", "own").sortWithinPartitions("ord", "own")
        for label, drifted in names.items():
            sheet = in_order.select(F.col("id").alias(header), F.col(label).alias(label if kind == "posts" else drifted))
            write_csv(sheet, f"{folder}/All_{kind.capitalize()}_Groq_{label.capitalize()}.csv")
    return read_annotations(spark, folder).select("kind", "id", "sentiment", "toxicity", "topics", "ord")


@query("segment_tables", f"""WITH {b.SWEEP}, macro AS (
    SELECT community, kind, min(id) AS summary, max(id) AS patterns FROM sweep GROUP BY community, kind)
  SELECT 'sentiment' AS sheet, community, kind, 'groq' AS model, id, sentiment AS value FROM sweep
  UNION ALL SELECT 'toxicity', community, kind, 'groq', id, toxicity FROM sweep
  UNION ALL SELECT 'topics', community, kind, 'groq', id, topics FROM sweep
  UNION ALL SELECT 'summary', community, kind, 'groq', NULL, summary FROM macro
  UNION ALL SELECT 'patterns', community, kind, 'groq', NULL, patterns FROM macro""")
def _(spark, sf):
    folder = new_path(spark, "annotations")
    ann = b.sweep(spark, sf).drop("ord").withColumn("model", F.lit("groq"))
    macro = ann.groupBy("community", "kind", "model").agg(
        F.min("id").alias("summary"), F.max("id").alias("patterns"))
    write_annotations(ann, macro, folder)
    sheets = [read_sheet(spark, folder, name) for name in ("sentiment", "toxicity", "topics", "summary", "patterns")]
    return reduce(lambda x, y: x.unionByName(y), [
        s.select(F.lit(s.columns[-1]).alias("sheet"), "community", "kind", "model",
                 (F.col("id") if "id" in s.columns else F.lit(None).cast("string")).alias("id"),
                 F.col(s.columns[-1]).alias("value")) for s in sheets])


@query("audit_append", """SELECT row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS ord, doc_id,
  lpad((doc_id % 2)::VARCHAR, 12, '0') AS batch, source AS input_text_identifiers, text AS prompt_used,
  'groq' AS model_api_used, '' AS generated_output, 'None' AS errors_encountered FROM documents""")
def _(spark, sf):
    """Two batches, each appended twice, the second one first; the trail has them once and in order."""
    path = new_path(spark, "audit")
    rows = b.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("input_text_identifiers"), F.col("text").alias("prompt_used"),
        F.lit("groq").alias("model_api_used"), F.lit("").alias("generated_output"),
        F.lit("None").alias("errors_encountered"))
    for n in (1, 0, 1, 0):
        append_audit(rows.where(F.col("doc_id") % 2 == n), path, n, ["doc_id"])
    return read_trail(spark, path)


@query("report_file_round_trip", f"""WITH {b.POSTS}
  SELECT community AS source, row_number() OVER (PARTITION BY community ORDER BY ord) AS line_no, post_id AS value
  FROM posts""")
def _(spark, sf):
    """Lines through the text report sink, one folder per community, read again with their line numbers."""
    path = new_path(spark, "report")
    write_report(b.posts(spark, sf).select("community", "ord", F.col("post_id").alias("line")), path,
                 ["ord"], ["community"])
    return read_lines(spark, path, F.regexp_extract(F.col("_metadata.file_path"), "community=([^/]+)/", 1))


# --- streams ---------------------------------------------------------------------------------------


def _write_logs(lines, path, mode="append"):
    """Lines as text files, one folder per source."""
    sort = ["source", "line_no"]
    lines.repartitionByRange(*sort).sortWithinPartitions(*sort).select(
        F.col("source").alias("log"), "value").write.mode(mode).partitionBy("log").text(path)


def _log_source():
    return F.regexp_extract(F.col("_metadata.file_path"), "log=([^/]+)/", 1)


@query("stream_log", f"""WITH {b.POSTS}
  SELECT post_id, community, title, body, author, created_epoch, score, num_comments, permalink
  FROM posts WHERE ord % 8 IN (0, 1, 3, 4)""")
def _(spark, sf):
    logs, out = new_path(spark, "logs"), new_path(spark, "records")
    _write_logs(b.noisy_lines(spark, sf), logs)
    records = stream_records(stream_lines(spark, logs, _log_source()))
    append_stream(records.select("source", "kind", "post", "comment"), out, new_path(spark, "checkpoint")).awaitTermination()
    return posts_from_raw(spark.read.parquet(out).where("kind = 'post'"), "post")


@query("stream_comments", f"""WITH {b.POSTS}
  SELECT 't1_' || ord AS comment_id, post_id, post_id AS parent_id, community, body AS text, author,
         created_epoch, score FROM posts WHERE ord % 8 = 6""")
def _(spark, sf):
    logs, out = new_path(spark, "logs"), new_path(spark, "records")
    _write_logs(b.noisy_lines(spark, sf), logs)
    records = stream_records(stream_lines(spark, logs, _log_source()))
    append_stream(records.select("source", "kind", "post", "comment"), out, new_path(spark, "checkpoint")).awaitTermination()
    return comments_from_raw(spark.read.parquet(out).where("kind = 'comment'"), "comment")


def _run_session_stream(spark, sf, documents=None):
    """Two deliveries of the same logs: sessions open at the end of the first go on in the second."""
    logs, tbl, cp = (new_path(spark, n) for n in ("logs", "sessions", "checkpoint"))
    lines = b.event_lines(spark, sf)
    middle = lines.agg(F.max("line_no")).first()[0] // 2
    for delivery in (lines.where(F.col("line_no") <= middle), lines.where(F.col("line_no") > middle)):
        _write_logs(delivery, logs)
        harvest_stream(spark, logs, tbl, cp, _log_source(), documents=documents).awaitTermination()
    return tbl


def _session_rows(posts, comments):
    row = lambda df, kind, key: df.select(
        "source", "session_no", F.lit(kind).alias("kind"), F.col(key).alias("id"), "score")
    return row(posts, "post", "post_id").unionByName(row(comments, "comment", "comment_id"))


@query("stream_sessions", f"""WITH {b.EVENT_SESSIONS}
  SELECT source, session_no, kind, id, score FROM sessions WHERE complete""")
def _(spark, sf):
    return _session_rows(*finished_sessions(spark, _run_session_stream(spark, sf)))


@query("stream_open_sessions", f"""WITH {b.EVENT_SESSIONS}
  SELECT source, session_no, kind, id, score FROM sessions WHERE NOT complete""")
def _(spark, sf):
    return _session_rows(*open_sessions(spark, _run_session_stream(spark, sf)))


def _append_share(lines, folder, n, of):
    """Let the log files of ``folder`` grow to ``n / of`` of their bytes, wherever in a line that is.

    One task per log, as one process writes a log; a task that is repeated goes on where the file ends. The window
    keeps a log in one task and in order, which a repartition does not: it is left out above a join by the same
    column, and adaptive execution may spread the join's rows anew.
    """
    size = F.octet_length("value") + 1
    sizes = lines.groupBy("source").agg(F.sum(size).alias("bytes"))
    so_far = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.join(sizes, "source").withColumn("end", F.sum(size).over(so_far))

    def append(batches):
        fs, base = file_system(folder)
        fs.create_dir(base)
        log = out = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["source"] != log:
                    if out:
                        out.close()
                    log, stop = r["source"], r["bytes"] * n // of
                    path = f"{base}/{log}.log"
                    there = fs.get_file_info(path).size or 0
                    out = fs.open_append_stream(path)
                line = r["value"].encode() + b"\n"
                at = r["end"] - len(line)
                out.write(line[max(there - at, 0):max(stop - at, 0)])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
        if out:
            out.close()

    rows.mapInArrow(append, "n bigint").agg(F.sum("n")).collect()


def _run_tail(spark, sf, documents=None, flush=False):
    """Logs that grow in three steps, each with a half line at its end; the stream starts anew after each."""
    ship_package(spark)
    logs, tbl, cp = (new_path(spark, n) for n in ("logs", "sessions", "checkpoint"))
    lines = stage_table(b.event_lines(spark, sf), "lines")
    where = dict(source=F.regexp_extract("file", r"/([^/]+)\.log$", 1), documents=documents)
    for n in (1, 2, 3):
        _append_share(lines, logs, n, 3)
        tail_harvest(spark, logs, tbl, cp, **where).awaitTermination()
    if flush:
        tail_harvest(spark, logs, tbl, cp, **where, silence_seconds=0).awaitTermination()
    return tbl


@query("stream_growing_logs", f"""WITH {b.EVENT_SESSIONS}
  SELECT source, session_no, kind, id, score FROM sessions WHERE complete""")
def _(spark, sf):
    return _session_rows(*finished_sessions(spark, _run_tail(spark, sf)))


@query("stream_silent_logs", f"""WITH {b.EVENT_SESSIONS} SELECT source, session_no, id FROM sessions""")
def _(spark, sf):
    """After their silence the logs' open records are documents like those of finished sessions."""
    out = new_path(spark, "documents")
    _run_tail(spark, sf, out, flush=True)
    return _document_rows(spark.read.schema(_SESSION_DOCUMENT).json(f"{out}/batch=*"))


def _document_rows(docs):
    at = "source", "session_no"
    rows = lambda name, key: docs.select(*at, F.explode(name).alias("r")).select(*at, F.col("r")[key].alias("id"))
    return rows("posts", "post ID").unionByName(rows("comments", "comment ID"))


@query("stream_documents", f"""WITH {b.EVENT_SESSIONS}
  SELECT source, session_no, id FROM sessions WHERE complete""")
def _(spark, sf):
    """Each session that a batch closes becomes documents of that batch, lines of earlier batches included."""
    out = new_path(spark, "documents")
    _run_session_stream(spark, sf, out)
    return _document_rows(spark.read.schema(_SESSION_DOCUMENT).json(f"{out}/batch=*"))


@query("stream_flush_open", f"""WITH {b.EVENT_SESSIONS}
  SELECT source, session_no, id FROM sessions WHERE NOT complete""")
def _(spark, sf):
    out = new_path(spark, "documents")
    flush_open(spark, _run_session_stream(spark, sf), out)
    return _document_rows(spark.read.schema(_SESSION_DOCUMENT).json(out))


@query("stream_audit", f"""WITH {b.PAYLOAD}, placed AS (
    SELECT *, row_number() OVER (PARTITION BY community, kind ORDER BY ord) - 1 AS nth FROM payload)
  SELECT '[''' || string_agg(id, ''', ''' ORDER BY nth) || ''']' AS input_text_identifiers,
         'groq' AS model_api_used, 'None' AS errors_encountered
  FROM placed GROUP BY community, kind, floor(nth / 5)""")
def _(spark, sf):
    ship_package(spark)
    model = Model("groq", rules.by_length)
    inbox, out = new_path(spark, "requests"), new_path(spark, "audit")
    requests = row_requests(b.payload(spark, sf), model)
    requests.write.parquet(inbox)
    arriving = spark.readStream.schema(requests.schema).parquet(inbox)
    for _ in range(2):  # the second stream, without a checkpoint, repeats the batch of the first
        append_stream_once(audit_rows(call_annotator(arriving, model), model.name), out,
                           new_path(spark, "checkpoint")).awaitTermination()
    return read_trail(spark, out).select("input_text_identifiers", "model_api_used", "errors_encountered")
