import json
import os
import time

import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.operators.harvest import marker_sessions, posts_from_raw
from threadloom.sources.documents import read_documents
from threadloom.sources.logs import read_lines
from threadloom.streaming.harvest import (
    append_stream, finished_sessions, flush_open, harvest_batch, harvest_stream, open_sessions, stream_lines, stream_records,
)

END = "=== END STREAM HARVEST: r/demo ==="


def post(i):
    return "POST_ROW:" + json.dumps({"post ID": f"t3_{i}", "score/upvotes": i})


def comment(i):
    return "COMMENT_ROW:" + json.dumps({"comment ID": f"t1_{i}"})


def put(folder, name, *lines, age):
    path = folder / name
    path.write_text("".join(f"{l}\n" for l in lines))
    os.utime(path, (time.time() - age, time.time() - age))


def source():
    return F.regexp_extract(F.col("_metadata.file_path"), r"/([a-z]+)\.\d+\.log", 1)


DELIVERIES = [
    {"app.1.log": [post(1), comment(1), "noise"], "web.1.log": [post(10)]},
    {"app.2.log": [post(2), END, comment(2)], "web.2.log": [comment(10), post(11)]},
    {"app.3.log": [END, END, post(3)]},
    {"app.4.log": ["nothing"], "web.4.log": [END, post(12), END, comment(13)]},
]


def rows(posts, comments):
    out = {(r.source, r.session_no, r.post_id) for r in posts.collect()}
    return out | {(r.source, r.session_no, r.comment_id) for r in comments.collect()}


FINISHED = {("app", 0, "t3_1"), ("app", 0, "t1_1"), ("app", 0, "t3_2"), ("app", 1, "t1_2"),
            ("web", 0, "t3_10"), ("web", 0, "t1_10"), ("web", 0, "t3_11"), ("web", 1, "t3_12")}
OPEN = {("app", 3, "t3_3"), ("web", 2, "t1_13")}


def test_sessions_over_restarts_and_batches(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    where = dict(folder=str(logs), table=str(tmp_path / "t"), checkpoint=str(tmp_path / "cp"), source=source(),
                 documents=str(tmp_path / "docs"))
    for n, delivery in enumerate(DELIVERIES):
        for name, lines in delivery.items():
            put(logs, name, *lines, age=100 - n)
        harvest_stream(spark, **where).awaitTermination()
    assert rows(*finished_sessions(spark, where["table"])) == FINISHED
    assert rows(*open_sessions(spark, where["table"])) == OPEN
    docs = read_documents(spark, f"{where['documents']}/batch=*/*.json", multi_line=False)
    assert docs.count() == 4 and docs.select(F.sum("metadata.total_posts")).first()[0] == 5

    flush_open(spark, where["table"], str(tmp_path / "rest"))
    assert read_documents(spark, f"{tmp_path}/rest/*.json", multi_line=False).count() == 2

    batch = marker_sessions(read_lines(spark, str(logs), source()), emit_incomplete=True).collect()
    ids = lambda done: {(r.source, r.session_no, r.post["post ID"] if r.post else r.comment["comment ID"])
                        for r in batch if r.complete == done}
    assert ids(True) == FINISHED and ids(False) == OPEN


def test_one_file_per_batch_gives_the_same(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    age = 100
    for delivery in DELIVERIES:
        for name, lines in delivery.items():
            put(logs, name, *lines, age=age)
            age -= 1
    harvest_stream(spark, str(logs), str(tmp_path / "t"), str(tmp_path / "cp"), source(),
                   files_per_trigger=1).awaitTermination()
    assert len([d for d in os.listdir(tmp_path / "t") if d.startswith("batch=")]) == 7
    assert rows(*finished_sessions(spark, str(tmp_path / "t"))) == FINISHED
    assert rows(*open_sessions(spark, str(tmp_path / "t"))) == OPEN


def test_a_repeated_batch_changes_nothing(spark, frame, tmp_path):
    raw = frame([("s", "f", 0, v) for v in (post(1), END, post(2))], "source string, file string, split bigint, value string").coalesce(1)
    more = frame([("s", "g", 0, v) for v in (END,)], "source string, file string, split bigint, value string").coalesce(1)
    table = str(tmp_path / "t")
    harvest_batch(raw, 0, table)
    harvest_batch(more, 1, table)
    first = rows(*finished_sessions(spark, table))
    harvest_batch(more, 1, table)
    assert rows(*finished_sessions(spark, table)) == first == {("s", 0, "t3_1"), ("s", 1, "t3_2")}


def test_live_records(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    put(logs, "app.1.log", post(1), "x " + comment(1), "POST_ROW:{}", "POST_ROW:{bad", age=5)
    out = str(tmp_path / "out")
    append_stream(stream_records(stream_lines(spark, str(logs), source())), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.kind for r in got.collect()) == ["comment", "post"]
    assert posts_from_raw(got.where("kind = 'post'"), "post").first().score == 1


class Settings:
    """A session stand-in with given settings."""

    def __init__(self, master, **conf):
        self.conf, self.sparkContext = conf, type("Context", (), {"master": master, "applicationId": "app-1"})


def test_shared_folder_is_the_clusters_own(spark):
    key = session.CHECKPOINT_SETTING
    assert session.shared_folder(Settings("yarn", **{key: "hdfs:///shared/"})) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        session.shared_folder(Settings("yarn"))
    local = session.shared_folder(Settings("local[2]"))
    assert os.path.isdir(local) and session.shared_folder(Settings("local[2]")) == local
    staged = session.stage_table(spark.range(3), "numbers")
    assert staged.count() == 3 and session.shared_folder(spark) in staged.inputFiles()[0]
