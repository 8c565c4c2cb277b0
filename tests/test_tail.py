"""Growing log files: whole lines once, through half lines, restarts, rotation, truncation; silent sources are flushed."""

import json
import os
import random
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from test_streaming import END, comment, post, rows

from threadloom.plans.exchange import _append_share
from threadloom.session import stage_table
from threadloom.sources.documents import read_documents
from threadloom.streaming.harvest import finished_sessions, harvest_batch, open_sessions, tail_harvest, tail_lines
from threadloom.streaming.tail import LostLines, Reader, piece_lines


def reader(tmp_path, **options):
    return Reader({"path": str(tmp_path / "logs"), "positions": str(tmp_path / "positions"), "tickseconds": "1000", **options})


@pytest.fixture()
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    return folder


def append(path, data: bytes):
    with open(path, "ab") as f:
        f.write(data)


def polled(r, start):
    """The next offset and its lines as (file number, position, text)."""
    end = r.latestOffset()
    lines = []
    for piece in r.partitions(start, end):
        for batch in r.read(piece):
            lines += [(x["file_no"], x["position"], x["value"]) for x in batch.to_pylist() if x["clock"] is None]
    return end, lines


def texts(lines):
    return [t for _, _, t in sorted(lines)]


def test_half_lines_wait(tmp_path, logs):
    r, text = reader(tmp_path), "erste\nzweite ü 😀 Zeile\n\ndritte\nhalb".encode()
    at, got, offset = 0, [], r.initialOffset()
    while at < len(text):
        append(logs / "a.log", text[at:at + 3])
        at += 3
        offset, new = polled(r, offset)
        got += new
    assert texts(got) == ["erste", "zweite ü 😀 Zeile", "", "dritte"]
    assert [p for _, p, _ in got] == [0, 6, 6 + len("zweite ü 😀 Zeile\n".encode()), text.rindex(b"dritte")]
    append(logs / "a.log", b" fertig\n")
    assert texts(polled(r, offset)[1]) == ["halb fertig"]


def test_restart_goes_on_and_a_repeated_batch_is_the_same(tmp_path, logs):
    append(logs / "a.log", b"1\n2\n3")
    first, one = polled(reader(tmp_path), {"files": [], "clock": 0})
    append(logs / "a.log", b"3\n4\n")
    second, two = polled(reader(tmp_path), first)  # a new process
    append(logs / "a.log", b"5\n")
    assert (texts(one), texts(two)) == (["1", "2"], ["33", "4"])
    again = reader(tmp_path)
    assert [x["value"] for p in again.partitions(first, second) for b in again.read(p) for x in b.to_pylist()][1:] == ["33", "4"]
    assert texts(polled(again, second)[1]) == ["5"]


def test_rotation_and_truncation(tmp_path, logs):
    r = reader(tmp_path)
    append(logs / "app.log", b"banner\n1\n2\nhal")
    offset, lines = polled(r, r.initialOffset())
    append(logs / "app.log", b"f\n3\n")
    os.rename(logs / "app.log", logs / "app.log.1")
    append(logs / "app.log", b"banner\n4\n")
    offset, new = polled(r, offset)
    assert texts(new) == ["half", "3", "banner", "4"]  # the renamed file goes on, the new one has the next number
    os.rename(logs / "app.log.1", logs / "app.log.2")
    os.rename(logs / "app.log", logs / "app.log.1")
    append(logs / "app.log.1", b"5\n")
    append(logs / "app.log", b"banner\n6\n")
    offset, new = polled(reader(tmp_path), offset)  # after a restart too
    assert texts(new) == ["5", "banner", "6"]
    (logs / "app.log").write_bytes(b"new\n")  # cut and written again, shorter
    offset, new = polled(r := reader(tmp_path), offset)
    assert texts(new) == ["new"]
    (logs / "app.log").write_bytes(b"now\nlonger than before\n")  # the same, longer
    assert texts(polled(r, offset)[1]) == ["now", "longer than before"]


def test_files_with_the_same_beginning_are_two(tmp_path, logs):
    r = reader(tmp_path)
    append(logs / "a.log", b"same\nx\n")
    append(logs / "b.log", b"same\n")
    offset, lines = polled(r, r.initialOffset())
    append(logs / "b.log", b"x\n")
    append(logs / "a.log", b"y\n")
    assert sorted(lines) == [(0, 0, "same"), (0, 5, "x"), (1, 0, "same")]
    assert sorted(polled(r, offset)[1]) == [(0, 7, "y"), (1, 5, "x")]


def test_lost_lines_are_an_error(tmp_path, logs):
    r = reader(tmp_path)
    append(logs / "a.log", b"1\n2\n")
    end = r.latestOffset()
    os.rename(logs / "a.log", logs / "z.log")
    pieces = r.partitions(r.initialOffset(), end)
    assert [x["value"] for p in pieces for b in r.read(p) for x in b.to_pylist()][1:] == ["1", "2"]
    os.remove(logs / "z.log")
    with pytest.raises(LostLines):
        [b for p in pieces for b in r.read(p)]


def test_nothing_new_is_no_batch_before_the_tick(tmp_path, logs):
    r = reader(tmp_path)
    append(logs / "a.log", b"1\n")
    offset = r.latestOffset()
    append(logs / "a.log", b"half")
    assert r.latestOffset() == offset and r.partitions(offset, offset) == []
    ticking = reader(tmp_path, tickseconds="0")
    time.sleep(0.002)
    later = ticking.latestOffset()
    assert later["files"] == offset["files"] and later["clock"] > offset["clock"]
    assert len(ticking.partitions(offset, later)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=9).map(lambda b: b.replace(b"\n", b"")), min_size=1, max_size=30), st.integers(1, 12), st.integers(0, 3))
def test_pieces_share_out_the_lines(tmp_path_factory, lines, size, skip):
    path = tmp_path_factory.mktemp("p") / "x.log"
    data = b"".join(line + b"\n" for line in lines)
    path.write_bytes(data + b"rest")
    import pyarrow.fs as pafs

    skip = min(skip, len(lines))
    first = len(b"".join(line + b"\n" for line in lines[:skip]))
    got = []
    for at in range(first, len(data), size):
        got += piece_lines(pafs.LocalFileSystem(), str(path), first, at, min(at + size, len(data)), len(data))
    assert [t for _, t in got] == lines[skip:]
    assert all(data[p:p + len(t)] == t for p, t in got)


def test_patterns_and_folders(tmp_path, logs):
    (logs / "sub").mkdir()
    for name in ("a.log", "b.txt", ".c.log", "_d.log", "sub/e.log"):
        append(logs / name, b"x\n")
    names = lambda path: [k["path"].rsplit("logs/", 1)[1] for k in reader(tmp_path, path=str(path), positions=str(tmp_path / str(len(str(path))))).latestOffset()["files"]]
    assert names(logs) == ["a.log", "b.txt", "sub/e.log"]
    assert names(logs / "*.log") == ["a.log"] and names(logs / "*" / "*.log") == ["sub/e.log"]
    assert names(logs / "none" / "*.log") == []


def log_name():
    return F.regexp_extract("file", r"/([a-z]+)\.log", 1)


def test_sessions_of_growing_files(spark, tmp_path, logs):
    """Three deliveries, each with a half line at its end, each read by a new start of the stream."""
    random.seed(2)
    texts = {}
    for name in ("app", "web"):
        lines = [random.choice([post, comment])(f"{name}{i}") if random.random() < 0.9 else END for i in range(60)] + ["noise"]
        texts[name] = "".join(f"{line}\n" for line in lines).encode()
    where = dict(table=str(tmp_path / "t"), checkpoint=str(tmp_path / "cp"), source=log_name(), documents=str(tmp_path / "docs"))
    for third in range(3):
        for name, text in texts.items():
            cut = [len(text) * k // 3 for k in range(4)]
            append(logs / f"{name}.log", text[cut[third]:cut[third + 1]])
        tail_harvest(spark, str(logs), **where).awaitTermination()
    done, still = set(), set()
    for name, text in texts.items():
        number, lines = 0, text.decode().splitlines()
        last = max(i for i, line in enumerate(lines) if line == END)
        for i, line in enumerate(lines):
            number += line == END
            if "_ROW:" in line:
                record = json.loads(line.split("_ROW:")[1])
                (done if i < last else still).add((name, number, record.get("post ID") or record["comment ID"]))
    assert rows(*finished_sessions(spark, where["table"])) == done
    assert rows(*open_sessions(spark, where["table"])) == still
    written = lambda: {(r.source, r.session_no, r.id) for r in spark.read.json(f"{where['documents']}/batch=*").select(
        "source", "session_no", F.explode(F.concat(
            F.transform("posts", lambda p: p["post ID"]), F.transform("comments", lambda c: c["comment ID"]))).alias("id")).collect()}
    assert written() == done
    # nothing new comes: the silent sources are flushed once, without a call of flush_open
    for _ in range(2):
        tail_harvest(spark, str(logs), **where, silence_seconds=0).awaitTermination()
    assert written() == done | still
    assert rows(*finished_sessions(spark, where["table"])) == done | still
    append(logs / "app.log", f"{post('late')}\n".encode())
    tail_harvest(spark, str(logs), **where, silence_seconds=3600).awaitTermination()
    assert {r[2] for r in rows(*open_sessions(spark, where["table"]))} == {"t3_late"}
    assert read_documents(spark, f"{where['documents']}/batch=*/*.json", multi_line=False).count() > 2


def test_a_hot_source_does_not_keep_others_open(spark, frame, tmp_path):
    """Silence is counted per source and by the clock of the batches alone."""
    schema = "source string, line_no bigint, value string, clock bigint"
    clock = lambda seconds: (None, None, None, seconds * 1000)
    table = str(tmp_path / "t")
    harvest_batch(frame([clock(100), ("hot", 1, post(1), None), ("idle", 1, post(2), None)], schema), 0, table, silence_seconds=30)
    harvest_batch(frame([clock(120), ("hot", 2, post(3), None)], schema), 1, table, silence_seconds=30)
    assert rows(*finished_sessions(spark, table)) == set()
    batch = frame([clock(131), ("hot", 3, post(4), None)], schema)
    for _ in range(2):  # a repeated batch decides the same
        harvest_batch(batch, 2, table, silence_seconds=30)
        assert rows(*finished_sessions(spark, table)) == {("idle", 0, "t3_2")}
    harvest_batch(frame([clock(140), ("idle", 2, post(5), None)], schema), 3, table, silence_seconds=30)
    assert rows(*open_sessions(spark, table)) == {("hot", 0, f"t3_{i}") for i in (1, 3, 4)} | {("idle", 1, "t3_5")}


def test_a_growing_file_is_read_by_many_tasks(spark, tmp_path, logs):
    append(logs / "a.log", b"".join(b"line %d\n" % i for i in range(4000)))
    out = str(tmp_path / "out")
    lines = tail_lines(spark, str(logs / "*.log"), str(tmp_path / "positions"), piece_bytes=5000)
    query = lines.withColumn("part", F.spark_partition_id()).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    got = spark.read.parquet(out).where("clock is null")
    assert [r.value for r in got.orderBy("line_no").collect()] == [f"line {i}" for i in range(4000)]
    assert got.select("part").distinct().count() == -(-sum(len(b"line %d\n" % i) for i in range(4000)) // 5000)


@pytest.fixture()
def late_broadcast(spark):
    """Joins are planned with a shuffle of both sides and turned into broadcasts while they run, as with larger tables."""
    values = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
              "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in values.items():
        spark.conf.set(name, value)
    yield
    for name in values:
        spark.conf.unset(name)


def test_a_log_that_grows_is_written_by_one_task(spark, tmp_path, late_broadcast):
    """the lines of a log come from many files, yet stand in the log in their order, each once."""
    lines = spark.range(4000).repartition(6).selectExpr(
        "'app' || id % 16 as source", "id as line_no", "'line ' || id || repeat('x', cast(id % 50 as int)) as value")
    staged = stage_table(lines, "lines", str(tmp_path / "lines"))
    for n in (1, 2, 3):
        _append_share(staged, str(tmp_path / "logs"), n, 3)
    for k in range(16):
        whole = [f"line {i}{'x' * (i % 50)}" for i in range(k, 4000, 16)]
        assert (tmp_path / "logs" / f"app{k}.log").read_text().split("\n") == [*whole, ""]
