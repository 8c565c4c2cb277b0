import json
import os

from pyspark.sql import functions as F

from threadloom.operators.harvest import (
    capped_harvest, classify_lines, marker_sessions, parse_log, parse_tally, select_harvest,
)
from threadloom.sources.logs import read_lines

LINES = "source string, line_no bigint, value string"


def log(frame, *values):
    return frame([("s", i, v) for i, v in enumerate(values, 1)], LINES)


def post(i, **more):
    return "POST_ROW:" + json.dumps({"post ID": f"t3_{i}", "title": "x", "score/upvotes": 3, **more})


def comment(i, text="hi"):
    return "COMMENT_ROW:" + json.dumps({"comment ID": f"t1_{i}", "comment text": text})


def test_strict_parse_and_quarantine(frame):
    lines = log(frame, "noise", "  " + post(1), "POST_ROW:{bad", "POST_ROW:{}", comment(2), "[x] " + post(3),
                post(4) + " junk", "POST_ROW:3", "POST_ROW:" + json.dumps({"a": 1}) + "," + json.dumps({"b": 1}))
    p = parse_log(lines)
    assert {(r.post_id, r.ord) for r in p.posts.collect()} == {("t3_1", 2), (None, 4)}
    assert [(r.comment_id, r.ord) for r in p.comments.collect()] == [("t1_2", 5)]
    assert sorted(r.line_no for r in p.quarantine.collect()) == [3, 7, 8, 9]
    tally = parse_tally(lines).first()
    assert (tally.posts, tally.comments, tally.rejected) == (2, 1, 4)


def test_loose_parse_takes_first_to_last_brace(frame):
    lines = log(frame, "[app] " + post(1) + " tail", "POST_ROW: none", "POST_ROW:{ }", "x COMMENT_ROW: y " + comment(2)[12:],
                "POST_ROW:}{")
    p = parse_log(lines, "loose")
    assert [r.post_id for r in p.posts.collect()] == ["t3_1"]
    assert [r.comment_id for r in p.comments.collect()] == ["t1_2"]


def test_parsers_disagree_on_a_comment_that_quotes_a_post_prefix(frame):
    lines = log(frame, comment(1, "see POST_ROW:{}"))
    assert parse_log(lines).comments.count() == 1
    loose = parse_log(lines, "loose")
    assert loose.comments.count() == 0 and loose.posts.count() == 0


def test_parsers_agree_on_plain_lines(frame):
    lines = log(frame, *[post(i) for i in range(5)], *[comment(i) for i in range(5)])
    a, b = parse_log(lines), parse_log(lines, "loose")
    assert a.posts.collect() == b.posts.collect() and a.comments.collect() == b.comments.collect()


def test_bad_numbers_do_not_void_a_record(frame):
    row = parse_log(log(frame, post(1, **{"score/upvotes": "many", "creation timestamp": 17.9}))).posts.first()
    assert (row.post_id, row.score, row.created_epoch) == ("t3_1", None, 17)


END = "==== END STREAM HARVEST: r/demo ===="


def test_marker_sessions(frame):
    lines = log(frame, post(1), comment(1), END, END, comment(2), post(2), END, post(3), "noise")
    closed = marker_sessions(lines).collect()
    assert sorted((r.session_no, r.line_no) for r in closed) == [(0, 1), (0, 2), (2, 5), (2, 6)]
    every = marker_sessions(lines, emit_incomplete=True).collect()
    assert [(r.session_no, r.line_no) for r in every if not r.complete] == [(3, 8)]


def test_no_marker_means_no_session(frame):
    assert marker_sessions(log(frame, post(1), comment(1))).count() == 0


def test_line_numbers_of_split_and_rotated_files(spark, tmp_path):
    """Splits of a few hundred bytes; two rotated files of one log continue each other."""
    for n, name in enumerate(["a.log.1", "a.log.2", "b.log"]):
        with open(tmp_path / name, "w") as f:
            f.writelines(f"{name} line {i} {'x' * (i % 37)}\n" for i in range(400))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        source = F.regexp_extract(F.col("_metadata.file_path"), r"/([ab])\.log", 1)
        got = read_lines(spark, str(tmp_path), source).collect()
        per_file = read_lines(spark, str(tmp_path / "b.log")).collect()
        assert read_lines(spark, str(tmp_path)).count() == 1200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
    numbers = {r.value.split(" x")[0].strip(): (r.source, r.line_no) for r in got}
    assert numbers["a.log.1 line 0"] == ("a", 1) and numbers["a.log.2 line 0"] == ("a", 401)
    assert all(numbers[f"a.log.2 line {i}"] == ("a", 401 + i) for i in range(400))
    assert all(numbers[f"b.log line {i}"] == ("b", 1 + i) for i in range(400))
    assert {r.source for r in per_file} == {"b.log"}


POSTS = "post_id string, community string, score bigint, created_epoch bigint, num_comments bigint, ord bigint"
COMMENTS = "comment_id string, post_id string, ord bigint"


def brute_caps(posts, comments, limit, per_post, stop):
    out = []
    for p in sorted(posts, key=lambda r: r[5])[:limit]:
        if len(out) < stop and p[4] > 0:
            out += [c[0] for c in sorted((c for c in comments if c[1] == p[0]), key=lambda c: c[2])[:per_post]]
    return set(out)


def test_caps_match_the_loop(frame):
    """One post holds a third of all comments."""
    posts = [(f"p{i}", "c", i, i, i % 4, i) for i in range(30)]
    comments = [(f"c{i}", "p1" if i % 3 == 0 else f"p{i % 29}", 1000 - i) for i in range(900)]
    for limits in ((100, 50, 550), (10, 5, 23), (30, 7, 7), (5, 50, 1)):
        got = capped_harvest(frame(posts, POSTS), frame(comments, COMMENTS), *limits).comments.collect()
        assert {r.comment_id for r in got} == brute_caps(posts, comments, *limits)
        assert len(got) == len({r.comment_id for r in got})


def test_selection_modes(frame):
    posts = frame([(f"p{i}", "c", i, -i, 1, i) for i in range(120)], POSTS)
    comments = frame([(f"c{i}", f"p{i % 120}", i) for i in range(240)], COMMENTS)
    n = lambda h: (h.posts.count(), h.comments.count())
    assert n(select_harvest(posts, comments, "posts")) == (120, 0)
    assert n(select_harvest(posts, comments, "comments")) == (0, 240)
    assert n(select_harvest(posts, comments, " Both ")) == (120, 240)
    assert n(select_harvest(posts, comments, "post", post_id="p7", include_comments=True)) == (1, 2)
    assert n(select_harvest(posts, comments, "post", post_id="p7")) == (1, 0)
    one = select_harvest(posts, comments, "post", post_id="n", sort="top", include_comments=True, seed=1)
    row = one.posts.first()
    assert row.score >= 20  # among the hundred best
    assert {r.post_id for r in one.comments.collect()} == {row.post_id}


def test_classification_is_evaluated_once(frame):
    """One JSON parse per record kind in the plan, whatever is built on the result."""
    df = classify_lines(log(frame, post(1)), "loose").where("post is not null").select("post.`post ID`", "kind")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2
