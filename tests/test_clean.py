import datetime

from pyspark.sql import functions as F

from threadloom.operators.clean import (
    clean_comments, clean_posts, cleaning_metrics, harmonize_comments, harmonize_posts, purge_placeholders,
)

COMMENT = "community string, comment_id string, text string, author string, created_epoch bigint, score string, ord bigint"
ROWS = [
    ("g", "1", "[deleted]", "ann", 10, "3", 0),
    ("g", "1", "alive", "ann", 11, "4", 1),        # goes with its deleted first copy
    ("g", "2", "[Removed]", None, 12, None, 2),
    ("g", "3", " [deleted]", None, None, "7.9", 3),  # no trim: stays
    ("g", "4", None, "[DELETED]", 13, "1", 4),
    ("g", "5", None, "bob", 14, "bad", 5),
    ("h", "5", "other community", "bob", 0, "-2.5", 6),
]


def test_comments_dedupe_before_purge(frame):
    got = {r.comment_id + r.community: r for r in clean_comments(frame(ROWS, COMMENT)).collect()}
    assert set(got) == {"3g", "5g", "5h"}
    assert (got["3g"].author, got["3g"].score, got["3g"].created_at) == ("[unknown_user]", 7, None)
    assert (got["5g"].text, got["5g"].score) == ("", 0)
    assert got["5h"].score == -2 and got["5h"].created_at == datetime.datetime(1970, 1, 1)


def test_cleaning_is_idempotent(frame):
    once = clean_comments(frame(ROWS, COMMENT))
    twice = clean_comments(once)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_metrics_add_up(frame):
    m = {r.community: r for r in cleaning_metrics(frame(ROWS, COMMENT), "comments", "comment_id", True).collect()}
    assert (m["g"].rows_in, m["g"].duplicates_removed, m["g"].placeholders_purged, m["g"].rows_out) == (6, 1, 3, 2)
    for r in m.values():
        assert r.rows_in == r.duplicates_removed + r.placeholders_purged + r.rows_out


POST = "community string, post_id string, title string, body string, author string, created_epoch bigint, score bigint, num_comments bigint, ord bigint"


def test_posts_keep_deleted_unless_asked(frame):
    rows = [("g", "a", None, "[deleted]", None, None, None, None, 1), ("g", "a", "t", "b", "x", 5, 1, 1, 0),
            ("g", "b", None, "[removed]", "y", 5, 1, None, 2)]
    kept = {r.post_id: r for r in clean_posts(frame(rows, POST)).collect()}
    assert set(kept) == {"a", "b"} and kept["a"].body == "b"
    assert (kept["b"].title, kept["b"].num_comments) == ("", 0)
    assert {r.post_id for r in clean_posts(frame(rows, POST), purge=True).collect()} == {"a"}


def test_rules_apply_to_present_columns_only(frame):
    df = frame([("x", None)], "other string, author string")
    assert clean_posts(df).first().author == "[unknown_user]"
    assert purge_placeholders(df, ("text",)).count() == 1


def test_harmonize_merges_the_split_column(frame):
    rows = [("2026-07-03 23:08:00", "1", None), (None, "1785314403", "t"), (None, None, "u"), ("junk", "5", "v")]
    out = harmonize_posts(frame(rows, "created_at string, creationtimestamp string, title string"))
    assert out.columns == ["created_at", "title"]
    assert [tuple(r) for r in out.collect()] == [
        ("2026-07-03 23:08:00", ""), ("2026-07-29 08:40:03", "t"), (None, "u"), (None, "v")]
    again = harmonize_comments(out)
    assert again.collect() == out.collect()


def test_dedupe_does_not_promise_by_input_position(frame):
    rows = [("g", "a", "late", "b", "x", 5, 1, 1, 9), ("g", "a", "early", "b", "x", 5, 1, 1, 3)]
    df = frame(rows, POST).repartition(4, F.col("title"))
    assert clean_posts(df).first().title == "early"
