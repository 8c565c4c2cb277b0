"""Live harvest: log files that keep arriving or growing, sessions that span files and batches.

``stream_lines`` reads each new file once and whole; ``tail_lines`` follows
files that grow, so nothing has to be rotated.

Each line is written once, with its session number, to ``<table>/batch=<n>``.
What a batch hands on is one row per source in ``<table>/_state``: how many
sessions are closed, and the first batch with lines of the open one. A session
is finished if its number is below the closed count, which is decided when the
table is read. A source that has been silent for a given time counts as closed
too, so its records come out without a marker. A busy source is spread over tasks like any other data, and a
repeated batch overwrites its own folders with the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions.text import utrim
from threadloom.operators.harvest import (
    assign_sessions, comments_from_raw, harvest_documents, has_record, line_kinds, parse_records,
    posts_from_raw,
)
from threadloom.session import ship_package, stage_table
from threadloom.sources.logs import FILE_NAME, line_columns, number_lines
from threadloom.sources.paths import exists, matching_files
from threadloom.sources.sinks import write_documents
from threadloom.streaming.tail import NAME, GrowingLogs

# Line numbers restart in each batch; this many fit before the next batch's range.
LINES_PER_BATCH = 1 << 40
BYTES_PER_FILE = 1 << 40  # positions in a growing file, before those of the next one
SESSION = ["source", "session_no"]


def stream_lines(spark: SparkSession, folder: str, source: Column | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Streaming lines ``source, file, split, value`` of a folder of log files."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder).select(*line_columns(source))


def tail_lines(spark: SparkSession, pattern: str, positions: str, source: Column | None = None,
               tick_seconds: float = 60, piece_bytes: int | None = None) -> DataFrame:
    """Streaming whole lines ``source, line_no, value, clock`` of files that grow.

    ``line_no`` is the line's place: the file's number, in the order files came up, then its first byte. ``source``
    is an expression over ``file``, the path; by default each file name is one log. Once per batch there is a row
    with the ``clock`` (milliseconds) of the poll alone. ``positions`` is a folder where this stream notes how far it
    has read. A file that is cut or replaced starts anew; one that is renamed within ``pattern`` goes on.
    """
    ship_package(spark)
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format(NAME).option("positions", positions).option("tickSeconds", tick_seconds)
    if piece_bytes:
        reader = reader.option("pieceBytes", piece_bytes)
    name = F.regexp_extract("file", FILE_NAME, 1) if source is None else source
    return reader.load(pattern).select(
        F.when(F.col("clock").isNull(), name).alias("source"),
        (F.col("file_no") * BYTES_PER_FILE + F.col("position")).alias("line_no"), utrim(F.col("value")).alias("value"), "clock")


def stream_records(lines: DataFrame, mode: str = "loose") -> DataFrame:
    """Stateless classification of streaming lines; keeps the lines that hold a record."""
    kinds = line_kinds(lines, mode).where(F.col("kind").isin("post", "comment"))
    return parse_records(kinds, mode).where(has_record())


def append_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append a stream to a Parquet table (records, audit rows)."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)


def _batch_path(table: str, n: int) -> str:
    return f"{table}/batch={n}"


def _state_path(table: str, n: int) -> str:
    return f"{table}/_state/batch={n}"


def _last_state(spark: SparkSession, table: str) -> tuple[int, DataFrame]:
    """Number and state of the newest finished batch; for readers of the table."""
    found = (re.search(r"batch=(\d+)/_SUCCESS$", p) for p in matching_files(spark, f"{table}/_state/batch=*/_SUCCESS"))
    last = max(int(m.group(1)) for m in found if m)
    return last, spark.read.parquet(_state_path(table, last))


def harvest_batch(lines: DataFrame, batch_id: int, table: str, mode: str = "loose",
                  silence_seconds: float | None = None) -> DataFrame:
    """One micro-batch: number its lines, assign sessions, write lines and state; returns the new state.

    The numbered lines are staged, so the log files are not read again for the
    session counts, which then scan three narrow columns. Earlier lines are not
    read at all: the state of the batch before is enough. Lines that have a
    ``line_no`` keep it. With ``silence_seconds`` the batch's ``clock`` closes the
    open session of each source whose last record or marker is that much older.
    """
    spark = lines.sparkSession
    if "line_no" in lines.columns:
        kinds = line_kinds(lines, mode).where("kind is not null or clock is not null")
    else:
        numbered = number_lines(lines.withColumn("seq", F.monotonically_increasing_id()))
        place = F.col("line_no") + F.lit(batch_id * LINES_PER_BATCH)
        kinds = line_kinds(numbered, mode).where("kind is not null").withColumns(
            {"line_no": place, "clock": F.lit(None).cast("bigint")})
    # one folder, rewritten by each batch; readers of the table pass over it
    staged = stage_table(kinds, "lines", f"{table}/_lines")
    clock = F.lit(staged.agg(F.max("clock")).first()[0]).cast("bigint")
    rows = staged.where("kind is not null").drop("clock").withColumns(
        {"closed_before": F.lit(0).cast("bigint"), "open_since": F.lit(None).cast("bigint"), "seen": clock})
    if exists(spark, f"{_state_path(table, batch_id - 1)}/_SUCCESS"):
        rows = rows.unionByName(spark.read.parquet(_state_path(table, batch_id - 1)).select(
            "source", F.lit(-1).cast("bigint").alias("line_no"), F.lit("state").alias("kind"),
            F.col("closed").alias("closed_before"), "open_since", "seen"), allowMissingColumns=True)
    placed = assign_sessions(rows, closed_before=F.col("closed_before")).drop("complete")
    placed = stage_table(placed, "batch", _batch_path(table, batch_id))
    opens = F.bool_or(F.col("kind").isin("post", "comment") & (F.col("session_no") == F.col("closed")))
    state = placed.groupBy("source").agg(
        F.max("closed").alias("closed"), F.max("closed_before").alias("closed_before"),
        F.min("open_since").alias("was_open_since"), F.max("seen").alias("seen"), opens.alias("opens"))
    still = F.when(F.col("closed") == F.col("closed_before"), F.col("was_open_since"))
    since = F.coalesce(still, F.when(F.col("opens"), F.lit(batch_id).cast("bigint")))
    state = state.withColumn("open_since", since).drop("opens")
    if silence_seconds is not None:
        silent = F.coalesce(F.col("open_since").isNotNull() & (F.col("seen") < clock)
                            & (clock - F.col("seen") >= F.lit(int(silence_seconds * 1000))), F.lit(False))
        state = state.withColumns({"closed": F.col("closed") + silent.cast("bigint"),
                                   "open_since": F.when(~silent, F.col("open_since"))})
    return stage_table(state, "state", _state_path(table, batch_id))


def _lines_of(spark: SparkSession, table: str, first: int, last: int, state: DataFrame) -> DataFrame:
    """Lines of the batches ``first`` to ``last`` with the state of their source in the struct ``now``."""
    paths = [_batch_path(table, n) for n in range(first, last + 1)]
    now = state.select(F.col("source").alias("of"), F.struct(*state.columns).alias("now"))
    return spark.read.parquet(*paths).where(F.col("kind").isin("post", "comment")).join(
        now, F.col("source").eqNullSafe(F.col("of"))).select("source", "line_no", "value", "kind", "session_no", "now")


def _just_finished(spark: SparkSession, table: str, batch_id: int, state: DataFrame) -> DataFrame:
    """Lines of the sessions that this batch closed; reads back to the first batch with lines of one of them."""
    closing = state.where("closed > closed_before")
    first = closing.agg(F.min("was_open_since")).first()[0]
    rows = _lines_of(spark, table, batch_id if first is None else first, batch_id, closing)
    return rows.where("session_no >= now.closed_before and session_no < now.closed")


def _split(rows: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    records = parse_records(rows.where(F.col("kind").isin("post", "comment")), mode)
    place = F.col("line_no").alias("ord")
    posts = posts_from_raw(records.where("post is not null"), "post", *SESSION, place)
    comments = comments_from_raw(records.where("comment is not null"), "comment", *SESSION, place)
    return posts, comments


def harvest_stream(spark: SparkSession, folder: str, table: str, checkpoint: str,
                   source: Column | None = None, mode: str = "loose",
                   documents: str | None = None, files_per_trigger: int | None = None,
                   once: bool = True):
    """Start the session stream. Finished sessions appear in ``table`` and, with
    ``documents``, as JSON documents in ``<documents>/batch=<n>``."""
    w = stream_lines(spark, folder, source, files_per_trigger).writeStream.foreachBatch(
        _batch_writer(spark, table, mode, documents))
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def tail_harvest(spark: SparkSession, pattern: str, table: str, checkpoint: str, source: Column | None = None,
                 mode: str = "loose", documents: str | None = None, silence_seconds: float | None = None,
                 tick_seconds: float | None = None, once: bool = True, every: str = "10 seconds"):
    """``harvest_stream`` over growing files (see ``tail_lines``).

    A source without a record or marker for ``silence_seconds`` is flushed: its open session counts as finished, and
    its records become documents. Without new lines a batch runs every ``tick_seconds``, a third of the silence
    unless given, so a silent source is flushed after at most four thirds of it. With ``once`` the
    stream handles what is there and ends; else it polls ``every`` so often until stopped.
    """
    if tick_seconds is None:
        tick_seconds = 60 if silence_seconds is None else silence_seconds / 3
    lines = tail_lines(spark, pattern, f"{checkpoint}-positions", source, tick_seconds)
    w = lines.writeStream.foreachBatch(_batch_writer(spark, table, mode, documents, silence_seconds))
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def _batch_writer(spark: SparkSession, table: str, mode: str, documents: str | None, silence_seconds: float | None = None):
    def process(lines: DataFrame, batch_id: int) -> None:
        state = harvest_batch(lines, batch_id, table, mode, silence_seconds)
        if documents:
            posts, comments = _split(_just_finished(spark, table, batch_id, state), mode)
            write_documents(harvest_documents(posts, comments, SESSION, subreddit="community"), _batch_path(documents, batch_id))

    return process


def finished_sessions(spark: SparkSession, table: str, mode: str = "loose") -> tuple[DataFrame, DataFrame]:
    """(posts, comments) of all finished sessions, keyed by ``source, session_no``."""
    last, state = _last_state(spark, table)
    return _split(_lines_of(spark, table, 0, last, state).where("session_no < now.closed"), mode)


def open_sessions(spark: SparkSession, table: str, mode: str = "loose") -> tuple[DataFrame, DataFrame]:
    """What an interrupt would leave unsaved: records after each source's last marker."""
    last, state = _last_state(spark, table)
    first = state.agg(F.min("open_since")).first()[0]
    rows = _lines_of(spark, table, last if first is None else first, last, state)
    return _split(rows.where("session_no = now.closed"), mode)


def flush_open(spark: SparkSession, table: str, documents: str, mode: str = "loose") -> None:
    """Write what is still open as documents, as an interrupted harvest saves its buffer."""
    write_documents(harvest_documents(*open_sessions(spark, table, mode), SESSION, subreddit="community"), documents)
