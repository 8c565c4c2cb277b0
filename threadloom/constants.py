"""Fixed values that results depend on, and the schemas of the frames."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------

POST_PREFIX = "POST_ROW:"
COMMENT_PREFIX = "COMMENT_ROW:"
END_MARKER = "END STREAM HARVEST"
BANNER_RULE = "=" * 20
SECTION_START = "###--- START_{}_EXPORT ---###"
SECTION_END = "###--- END_{}_EXPORT ---###"

PERMALINK_HOST = "https://reddit.com"
DEFAULT_TARGET = "formula1"
HARVEST_MODES = ("posts", "comments", "both", "post")
FEED_SORTS = ("hot", "top", "new", "rising")

FEED_POST_LIMIT = 100
COMMENTS_PER_POST = 50
COMMENT_STOP_TOTAL = 550

PLACEHOLDERS = ("[deleted]", "[removed]")
UNKNOWN_AUTHOR = "[unknown_user]"

SWEEP_MODEL = "groq"
SLICE_MODEL = "gemini"
SWEEP_BATCH = 5
SLICE_ROWS = 45
CORPUS_ROWS = 25
MAX_ATTEMPTS = 3

UNKNOWN = "Unknown"
MISSING_ID = "nan"
SKIPPED = "Skipped"
DEFAULT_SUMMARY = "No summary generated."
DEFAULT_PATTERNS = "No patterns identified."
UNANNOTATED = ("skipped", "unknown")

SENTIMENTS = ("Positive", "Negative", "Neutral")
TOXIC_STATUSES = ("Toxic", "Non-Toxic")
AUDIT_SAFE = ("low", "non-toxic", "nontoxic", "safe")
AUDIT_TOXIC = ("medium", "high", "toxic")
CHART_TOXIC = ("high", "medium", "toxic")
TOPIC_STOP_WORDS = (
    "phone", "comment", "post", "tech", "gaming",
    "smartphone", "general", "unknown", "threads",
)
TOPIC_LIMIT = 10

# Cell texts that a pandas CSV reader takes as missing (public pandas documentation).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# --- Raw (harvest document / console line) schemas ---------------------------
# Numbers are read as text so that a bad value never voids its record; the
# projections in operators.harvest cast them.

RAW_POST_FIELDS = {
    "post ID": "post_id",
    "subreddit name": "community",
    "title": "title",
    "body/self-text": "body",
    "author": "author",
    "creation timestamp": "created_epoch",
    "score/upvotes": "score",
    "number of comments": "num_comments",
    "URL/permalink": "permalink",
}

RAW_COMMENT_FIELDS = {
    "comment ID": "comment_id",
    "parent post ID": "post_id",
    "parent comment ID": "parent_id",
    "subreddit": "community",
    "comment text": "text",
    "author": "author",
    "timestamp": "created_epoch",
    "score/upvotes": "score",
}

LONG_COLUMNS = ("created_epoch", "score", "num_comments")


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_POST = _strings(RAW_POST_FIELDS)
RAW_COMMENT = _strings(RAW_COMMENT_FIELDS)

DATASET_DOCUMENT = T.StructType([
    T.StructField("subreddit", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("metadata", T.StructType([
        T.StructField("subreddit", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("total_posts", T.LongType()),
        T.StructField("total_comments", T.LongType()),
    ])),
    T.StructField("posts", T.ArrayType(RAW_POST)),
    T.StructField("comments", T.ArrayType(RAW_COMMENT)),
])

# --- Frame schemas ------------------------------------------------------------


def _frame(fields: dict[str, str]) -> T.StructType:
    return T.StructType([
        T.StructField(n, T.LongType() if n in LONG_COLUMNS else T.StringType())
        for n in fields.values()
    ] + [T.StructField("ord", T.LongType())])


POSTS = _frame(RAW_POST_FIELDS)
COMMENTS = _frame(RAW_COMMENT_FIELDS)

SEGMENT = ("community", "kind")

ANNOTATIONS = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("community", "kind", "model", "id", "sentiment", "toxicity", "topics")
])

MACRO = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("community", "kind", "model", "summary", "patterns")
])

AUDIT = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("input_text_identifiers", "prompt_used", "model_api_used",
              "generated_output", "errors_encountered")
])

# --- API feed dump (one JSON object per line) -----------------------------------

FEED_POST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("subredditName", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("authorName", T.StringType()),
    T.StructField("createdAt", T.DoubleType()),
    T.StructField("score", T.LongType()),
    T.StructField("numberOfComments", T.LongType()),
    T.StructField("permalink", T.StringType()),
])

FEED_COMMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("postId", T.StringType()),
    T.StructField("parentId", T.StringType()),
    T.StructField("subredditName", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("authorName", T.StringType()),
    T.StructField("createdAt", T.DoubleType()),
    T.StructField("score", T.LongType()),
])
