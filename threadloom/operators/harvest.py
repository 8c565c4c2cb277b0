"""Console lines to records, feed projections, harvest selection and caps."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from threadloom.constants import (
    COMMENT_PREFIX, COMMENT_STOP_TOTAL, COMMENTS_PER_POST, END_MARKER, FEED_POST_LIMIT,
    FEED_SORTS, HARVEST_MODES, LONG_COLUMNS, PERMALINK_HOST, POST_PREFIX, RAW_COMMENT,
    RAW_COMMENT_FIELDS, RAW_POST, RAW_POST_FIELDS,
)
from threadloom.functions.bind import bind
from threadloom.functions.dates import millis_to_epoch, run_stamp, whole_number
from threadloom.functions.text import non_empty, target_name, utrim
from threadloom.operators.ordering import first_n, floor_div, running_total_before, with_ordinal

# --- raw records -> frames -------------------------------------------------------


def _renamed(record: Column, fields: dict[str, str]) -> list[Column]:
    out = []
    for raw, name in fields.items():
        c = record.getField(raw)
        out.append((whole_number(c) if name in LONG_COLUMNS else c).alias(name))
    return out


def posts_from_raw(df: DataFrame, record: str, *extra) -> DataFrame:
    """A column of raw post structs -> posts; ``extra`` columns come first."""
    return df.select(*extra, *_renamed(F.col(record), RAW_POST_FIELDS))


def comments_from_raw(df: DataFrame, record: str, *extra) -> DataFrame:
    return df.select(*extra, *_renamed(F.col(record), RAW_COMMENT_FIELDS))


def raw_struct(fields: dict[str, str]) -> Column:
    """The raw record of a frame row, under the raw field names."""
    return F.struct(*[F.col(name).alias(raw) for raw, name in fields.items()])


def raw_json(fields: dict[str, str]) -> Column:
    return F.to_json(raw_struct(fields), {"ignoreNullFields": "false"})


# --- line classification -----------------------------------------------------------


def _in_list(text: Column, schema: T.StructType) -> Column:
    """``text`` parsed as the only content of a list: more or less than one value shows in the
    length, and text after the object is an error (the reader alone would accept it)."""
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(schema))
    return F.when(text.startswith("{") & text.endswith("}"), parsed)


def _only(parsed: str) -> Column:
    return F.when(F.size(parsed) == 1, F.get(F.col(parsed), F.lit(0)))


def line_kinds(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """Strip ``value`` and add ``kind``: post | comment | marker | NULL. No record is parsed yet.

    ``strict``: the line starts with a prefix. ``loose``: a prefix anywhere, post
    before comment. A marker line has no prefix.
    """
    if mode not in ("strict", "loose"):
        raise ValueError(f"mode must be strict or loose, not {mode!r}")
    df = bind(lines, value=utrim(F.col("value")))
    line = F.col("value")
    found = line.startswith if mode == "strict" else line.contains
    return bind(df, kind=(
        F.when(found(POST_PREFIX), "post").when(found(COMMENT_PREFIX), "comment")
        .when(line.contains(END_MARKER), "marker")))


def parse_records(kinds: DataFrame, mode: str = "strict") -> DataFrame:
    """Lines with ``kind`` -> the same with ``post`` and ``comment`` structs instead of ``value``.

    ``strict``: everything after the prefix is the object. ``loose``: the object
    runs from the first to the last brace after the prefix, and an empty object
    is nothing. The struct is NULL when the object does not parse.
    """
    line, kind = F.col("value"), F.col("kind")
    if mode == "strict":
        rest = lambda prefix: utrim(F.substring(line, len(prefix) + 1, 2147483647))
    else:
        rest = lambda prefix: F.regexp_extract(line, rf"(?s)^.*?{prefix}[^{{]*(\{{.*\}})", 1)
    df = bind(kinds, __body=F.when(kind == "post", rest(POST_PREFIX)).when(
        kind == "comment", rest(COMMENT_PREFIX)))
    body = F.col("__body")
    if mode == "loose":
        body = F.when(~body.rlike(r"^\{\s*\}$"), body)
    df = bind(df,
              __post=F.when(kind == "post", _in_list(body, RAW_POST)),
              __comment=F.when(kind == "comment", _in_list(body, RAW_COMMENT)))
    return df.withColumns({"post": _only("__post"), "comment": _only("__comment")}).drop(
        "value", "__body", "__post", "__comment")


def classify_lines(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """Lines -> ``kind`` and parsed ``post`` / ``comment`` of each."""
    return parse_records(line_kinds(lines, mode), mode)


def has_record() -> Column:
    return F.col("post").isNotNull() | F.col("comment").isNotNull()


class ParsedLog(NamedTuple):
    posts: DataFrame
    comments: DataFrame
    quarantine: DataFrame


def parse_log(lines: DataFrame, mode: str = "strict") -> ParsedLog:
    """Numbered lines (``source, line_no, value``) -> posts, comments and rejected lines.

    ``ord`` is the line number. The loose mode drops bad lines silently in the
    original; here they are in the quarantine for both modes.
    """
    kinds = line_kinds(lines, mode).where(F.col("kind").isin("post", "comment"))
    c = parse_records(kinds, mode)
    place = F.col("line_no").alias("ord")
    rejected = c.where(~has_record()).select(
        "source", "line_no",
        F.concat(F.lit("unreadable "), F.col("kind"), F.lit(" object")).alias("reason"))
    return ParsedLog(
        posts_from_raw(c.where("post is not null"), "post", "source", place),
        comments_from_raw(c.where("comment is not null"), "comment", "source", place),
        rejected)


def parse_tally(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """Posts, comments and rejected lines per source, in one pass."""
    c = classify_lines(lines, mode)
    return c.groupBy("source").agg(
        F.count("post").alias("posts"),
        F.count("comment").alias("comments"),
        F.count_if(F.col("kind").isin("post", "comment") & ~has_record()).alias("rejected"),
    )


# --- marker sessions -----------------------------------------------------------------


def assign_sessions(kinds: DataFrame, keys: Sequence[str] = ("source",), ord_col: str = "line_no",
                    closed_before: Column | None = None) -> DataFrame:
    """Add ``session_no`` (end markers before the line), ``closed`` (end markers in all) and
    ``complete`` to lines with ``kind``.

    ``closed_before`` counts sessions that a row stands for besides its own marker.
    """
    marks = (F.col("kind") == "marker").cast("bigint")
    if closed_before is not None:
        marks = marks + closed_before
    rows = running_total_before(kinds, keys, ord_col, marks, "session_no", total="closed")
    return rows.withColumn("complete", F.col("session_no") < F.col("closed"))


def marker_sessions(lines: DataFrame, mode: str = "loose", keys: Sequence[str] = ("source",),
                    ord_col: str = "line_no", emit_incomplete: bool = False) -> DataFrame:
    """Records of lines with their ``session_no``, counted per ``keys`` by end markers.

    Rows after the last marker belong to no finished session; they are dropped
    unless ``emit_incomplete``, which keeps them with ``complete = false``.
    Sessions are assigned to raw lines; only lines that stay are parsed.
    """
    kinds = line_kinds(lines, mode).where("kind is not null")
    rows = assign_sessions(kinds, keys, ord_col).where("kind <> 'marker'").drop("closed")
    if not emit_incomplete:
        rows = rows.where("complete")
    return parse_records(rows, mode).where(has_record())


def session_counts(sessions: DataFrame, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    return sessions.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "post").alias("total_posts"),
        F.count_if(F.col("kind") == "comment").alias("total_comments"),
    )


# --- feed projections -------------------------------------------------------------------


def project_posts(feed: DataFrame, target: Column | str) -> DataFrame:
    """API post objects -> posts. Blank community or body falls back like a missing one."""
    target = F.lit(target) if isinstance(target, str) else target
    return feed.select(
        F.col("id").alias("post_id"),
        F.coalesce(non_empty(F.col("subredditName")), target).alias("community"),
        "title",
        F.coalesce(F.col("body"), F.lit("")).alias("body"),
        F.col("authorName").alias("author"),
        millis_to_epoch(F.col("createdAt")).alias("created_epoch"),
        "score",
        F.col("numberOfComments").alias("num_comments"),
        F.concat(F.lit(PERMALINK_HOST), F.col("permalink")).alias("permalink"),
        "ord",
    )


def project_comments(feed: DataFrame, target: Column | str) -> DataFrame:
    target = F.lit(target) if isinstance(target, str) else target
    return feed.select(
        F.col("id").alias("comment_id"),
        F.col("postId").alias("post_id"),
        F.col("parentId").alias("parent_id"),
        F.coalesce(non_empty(F.col("subredditName")), target).alias("community"),
        F.col("body").alias("text"),
        F.col("authorName").alias("author"),
        millis_to_epoch(F.col("createdAt")).alias("created_epoch"),
        "score",
        "ord",
    )


# --- caps and selection --------------------------------------------------------------------


def feed_order(sort: str = "hot") -> list[Column]:
    """Sort columns of a feed. ``hot`` and ``rising`` are ranks of the feed itself: its order."""
    if sort not in FEED_SORTS:
        raise ValueError(f"sort must be one of {FEED_SORTS}, not {sort!r}")
    first = {"top": [F.col("score").desc_nulls_last()],
             "new": [F.col("created_epoch").desc_nulls_last()]}.get(sort, [])
    return [*first, F.col("ord")]


def feed_posts(posts: DataFrame, sort: str = "hot", limit: int = FEED_POST_LIMIT) -> DataFrame:
    """The first ``limit`` posts of each community's feed."""
    return first_n(posts, ["community"], feed_order(sort), limit)


class Harvest(NamedTuple):
    posts: DataFrame
    comments: DataFrame


def capped_harvest(posts: DataFrame, comments: DataFrame, post_limit: int = FEED_POST_LIMIT,
                   per_post: int = COMMENTS_PER_POST, stop_total: int = COMMENT_STOP_TOTAL) -> Harvest:
    """Feed posts and their comments under the harvest limits.

    A post's comments are taken only while the posts before it brought fewer
    than ``stop_total``. Only comments of feed posts are ranked; the limit per
    post then leaves at most ``per_post`` rows of a busy one per map task.
    """
    feed = feed_posts(posts, limit=post_limit)
    asked = feed.where("num_comments > 0").select(
        F.col("community").alias("feed"), "post_id", F.col("ord").alias("post_ord"))
    gathered = first_n(comments.join(asked, "post_id"), ["feed", "post_id", "post_ord"], F.col("ord"), per_post)
    # from here on a feed has at most post_limit * per_post rows
    earlier_posts = (
        Window.partitionBy("feed").orderBy("post_ord")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    allowed = gathered.withColumn("before", F.count(F.lit(1)).over(earlier_posts)).where(
        F.col("before") < stop_total)
    return Harvest(feed, allowed.drop("feed", "post_ord", "before"))


def select_harvest(posts: DataFrame, comments: DataFrame, mode: str = "post",
                   post_id: str | None = None, sort: str = "hot",
                   include_comments: bool = False, seed: int = 0,
                   target: str | None = None, feed_limit: int = FEED_POST_LIMIT) -> Harvest:
    """The rows a harvest with these options returns, for one community.

    ``target`` picks the community by a name as a user types it (``r/Gaming``);
    without it the frames hold one community already. ``post`` without an id (or
    with ``n``) takes a random post among the first ``feed_limit`` of the feed:
    the first by a hash of ``seed`` and id, so a seed names one choice.
    """
    if target is not None:
        wanted_name = F.lower("community") == target_name(F.lit(target))
        posts, comments = posts.where(wanted_name), comments.where(wanted_name)
    mode = mode.lower().strip()
    if mode not in HARVEST_MODES:
        raise ValueError(f"mode must be one of {HARVEST_MODES}, not {mode!r}")
    none = comments.limit(0)
    if mode == "posts":
        return Harvest(posts, none)
    if mode == "comments":
        return Harvest(posts.limit(0), comments)
    if mode == "both":
        return Harvest(posts, comments)
    wanted = (post_id or "").strip()
    if wanted and wanted.lower() != "n":
        chosen = posts.where(F.col("post_id") == wanted)
    else:
        feed = posts.orderBy(*feed_order(sort)).limit(feed_limit)
        chosen = feed.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("post_id", F.lit("")))), "ord").limit(1)
    if not include_comments:
        return Harvest(chosen, none)
    return Harvest(chosen, comments.join(chosen.select("post_id"), "post_id", "left_semi"))


# --- documents and lines out ------------------------------------------------------------------

DOCUMENT_ROWS = 1_000


def harvest_documents(posts: DataFrame, comments: DataFrame, keys: Sequence[str],
                      mode: str = "both", stamp: Column | None = None,
                      part_rows: int = DOCUMENT_ROWS, subreddit: str | None = None) -> DataFrame:
    """Nested documents ``keys, part, metadata, posts, comments`` with whole totals.

    One document holds up to ``part_rows`` posts and as many comments; a larger
    group continues in further parts, so no task ever builds an unbounded
    array; a harvest under the usual limits is one document. Groups with no rows
    yield none; rows with missing keys are a group like any other. The metadata
    name the community, the first of ``keys`` unless ``subreddit`` names a column.
    """
    keys = list(keys)

    def numbered(df, fields, kind, name):
        cols = df.select(*keys, "ord", F.lit(kind).alias("kind"), raw_struct(fields).alias(name),
                         F.col(subreddit or keys[0]).cast("string").alias("__named"))
        placed = with_ordinal(cols, keys)
        return placed.withColumn("part", floor_div("ord0", part_rows)).drop("ord")

    rows = numbered(posts, RAW_POST_FIELDS, "post", "post").unionByName(
        numbered(comments, RAW_COMMENT_FIELDS, "comment", "comment"), allowMissingColumns=True)

    def records(kind):
        mine = F.when(F.col("kind") == kind, F.struct("ord0", kind))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda r: r[kind])

    def count(kind):
        return F.count_if(F.col("kind") == kind)

    # totals are added up from one narrow row per part and travel as further rows of their part
    counts = rows.groupBy(*keys, "part").agg(
        F.min("__named").alias("subreddit"), count("post").alias("posts"), count("comment").alias("comments"))
    group = Window.partitionBy(*keys)
    totals = counts.select(*keys, "part", F.lit("total").alias("kind"), F.struct(
        F.min("subreddit").over(group).alias("subreddit"), F.sum("posts").over(group).alias("posts"),
        F.sum("comments").over(group).alias("comments")).alias("total"))
    parts = rows.unionByName(totals, allowMissingColumns=True).groupBy(*keys, "part").agg(
        records("post").alias("posts"), records("comment").alias("comments"), F.max("total").alias("total"))
    stamp = run_stamp() if stamp is None else stamp
    return parts.select(
        *keys, "part",
        F.struct(
            F.col("total.subreddit").alias("subreddit"),
            F.lit(mode).alias("mode"),
            stamp.alias("timestamp"),
            F.col("total.posts").alias("total_posts"), F.col("total.comments").alias("total_comments"),
        ).alias("metadata"),
        "posts", "comments")


PART_PLACES = 1 << 32


def _place() -> Column:
    """``ord`` of a record: its part, then its place in the array."""
    return F.coalesce("part", F.lit(0)).cast("bigint") * PART_PLACES + F.col("pos")


def _with_part(documents: DataFrame) -> DataFrame:
    return documents if "part" in documents.columns else documents.withColumn("part", F.lit(0))


def document_posts(documents: DataFrame, *extra) -> DataFrame:
    """Posts of dataset documents; a missing list is an empty one. ``ord`` goes by part and array position."""
    rows = _with_part(documents).select(
        *extra, "part", F.posexplode(F.coalesce("posts", F.array())).alias("pos", "record"))
    return posts_from_raw(rows, "record", *extra, _place().alias("ord"))


def document_comments(documents: DataFrame, *extra) -> DataFrame:
    rows = _with_part(documents).select(
        *extra, "part", F.posexplode(F.coalesce("comments", F.array())).alias("pos", "record"))
    return comments_from_raw(rows, "record", *extra, _place().alias("ord"))


def export_lines(posts: DataFrame, comments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Prefixed JSON lines after their ``keys``; ``section`` 0 for posts and 1 for comments, in ``ord`` order."""
    return posts.select(
        *keys, F.lit(0).alias("section"), "ord",
        F.concat(F.lit(POST_PREFIX), raw_json(RAW_POST_FIELDS)).alias("value"),
    ).unionByName(comments.select(
        *keys, F.lit(1).alias("section"), "ord",
        F.concat(F.lit(COMMENT_PREFIX), raw_json(RAW_COMMENT_FIELDS)).alias("value"),
    ))
