"""Append tables with manifests, feeds of many files, annotators in waves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators.annotate import Model, annotate_rows, call_in_waves
from threadloom.operators.metrics import topic_counts
from threadloom.sources.paths import csv_header
from threadloom.sources.sheets import read_posts
from threadloom.sources.sinks import read_sheet, write_annotations
from threadloom.sources.documents import read_feed_comments, read_feed_posts
from threadloom.sources.trail import append_once, append_stream_once, read_trail


def values(df):
    return [(r.batch.lstrip("0") or "0", r.n) for r in df.orderBy("ord").collect()]


def numbers(spark, *ns):
    return spark.createDataFrame([(n, "x") for n in ns], "n int, ord string").select("n")


def test_a_batch_is_there_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert append_once(numbers(spark, 3, 1, 2), path, 1, ["n"])
    assert not append_once(numbers(spark, 9), path, 1)  # whatever it holds the second time
    assert append_once(numbers(spark, 7), path, 0)
    assert append_once(numbers(spark, 5, 4), path, 10, ["n"])
    got = read_trail(spark, path)
    assert values(got) == [("0", 7), ("1", 1), ("1", 2), ("1", 3), ("10", 4), ("10", 5)]
    assert sorted(r.ord for r in got.collect()) == list(range(6))


def test_failed_attempts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    append_once(numbers(spark, 1), path, "a")
    numbers(spark, 2).write.parquet(f"{path}/data/b-{'0' * 32}")  # written, never published
    (tmp_path / "t" / "_manifest" / ".half").write_text("{")
    assert [r.n for r in read_trail(spark, path).collect()] == [1]
    assert not [f for f in os.listdir(tmp_path / "t" / "_manifest") if f.startswith(".") and "half" not in f and not f.endswith("crc")]
    with pytest.raises(Exception, match="no_such"):
        append_once(numbers(spark, 1).select(F.expr("no_such(n)")), path, "c")
    assert append_once(numbers(spark, 3), path, "c")


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    """Both find the batch missing and write; the rename lets one of them publish."""
    import threadloom.sources.trail as trail

    path = str(tmp_path / "t")
    real, calls = trail.exists, []
    monkeypatch.setattr(trail, "exists", lambda s, p: (calls.append(p), real(s, p) if len(calls) > 2 else False)[1])
    assert [append_once(numbers(spark, n), path, 5) for n in (1, 2)] == [True, False]
    assert [r.n for r in read_trail(spark, path).collect()] == [1]


def test_empty_trails_and_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        read_trail(spark, path)
    assert read_trail(spark, path, numbers(spark).schema).columns == ["n", "batch", "ord"]
    append_once(numbers(spark), path, 0)
    assert read_trail(spark, path).count() == 0
    with pytest.raises(ValueError):
        append_once(numbers(spark), path, "a/b")


def test_a_stream_without_its_checkpoint_repeats_nothing(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    numbers(spark, 1, 2, 3).coalesce(1).write.parquet(str(inbox))
    stream = lambda: spark.readStream.schema("n int").parquet(str(inbox))
    for checkpoint in ("c1", "c2"):
        append_stream_once(stream(), out, str(tmp_path / checkpoint), ["n"]).awaitTermination()
    assert values(read_trail(spark, out)) == [("0", 1), ("0", 2), ("0", 3)]


@pytest.mark.parametrize("reader,field", [(read_feed_posts, "id"), (read_feed_comments, "id")])
def test_feed_order_over_files(spark, tmp_path, reader, field):
    """Spark packs files by size: a small first file must still come first. Ids are NULL and repeated."""
    at, want = 0, []
    for k, n in enumerate((1, 3000, 2, 0, 700)):
        ids = [None if i % 5 == 0 else f"x{i % 3}" for i in range(n)]
        (tmp_path / f"part-{k}.json").write_text("".join(json.dumps({field: i, "score": at + j}) + "\n" for j, i in enumerate(ids)))
        want += [(at + j, i) for j, i in enumerate(ids)]
        at += n
    got = reader(spark, f"{tmp_path}/*.json").orderBy("ord").collect()
    assert [(r.ord, r[field]) for r in got] == want and [r.score for r in got] == list(range(at))


def test_title_case_comes_after_the_count(spark):
    """In the optimised plan the tokens are counted as written below the generator that makes the title case."""
    rows = spark.createDataFrame([("c", "posts", 1, "a, b")], "community string, kind string, ord bigint, topics string")
    plan = topic_counts(rows)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = [i for i, line in enumerate(lines) if "initcap" in line.lower()]
    counted = [i for i, line in enumerate(lines) if line.strip().lstrip("+- :").startswith("Aggregate [community#")]
    assert len(at) == 1 and len(counted) == 2 and counted[0] < at[0] < counted[1]


REQUESTS = "n int, members array<string>, prompt string"


def dying(folder, after):
    """An annotator whose quota is used up after some calls in all; files count them across processes."""
    def annotate(prompt):
        import os
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        if len(os.listdir(folder)) > after:
            raise RuntimeError("429 daily quota")
        return "{}"

    return annotate


def test_no_wave_follows_a_used_up_quota(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    requests = spark.createDataFrame([(i, [str(i)], f"prompt {i}") for i in range(200)], REQUESTS).repartition(4)
    done = call_in_waves(requests, Model("m", dying(str(calls), 9)), waves=6, path=str(tmp_path / "w"))
    rows = done.collect()
    called = len(os.listdir(calls))
    assert sorted(r.n for r in rows) == list(range(200))
    assert sum(r.status == "ok" for r in rows) == 9
    assert sum(len(r.attempts) for r in rows) == called < 100
    assert {r.status for r in rows if not r.attempts} == {"unavailable"} and called + sum(not r.attempts for r in rows) == 200
    assert len(os.listdir(calls)) == called  # reading the result calls nobody


def test_waves_without_trouble_and_without_requests(spark, tmp_path):
    requests = spark.createDataFrame([(i, [str(i)], f"prompt {i}") for i in range(50)], REQUESTS)
    done = call_in_waves(requests, Model("m", lambda p: p.upper()), waves=4)
    assert {(r.n, r.response, r.status, len(r.attempts)) for r in done.collect()} == {
        (i, f"PROMPT {i}", "ok", 1) for i in range(50)}
    assert call_in_waves(requests.limit(0), Model("m", str), waves=4).count() == 0


def test_rows_of_unsent_requests_are_skipped(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = spark.createDataFrame([(f"c{i % 40}", "posts", f"p{i}", "text", i) for i in range(400)],
                                 "community string, kind string, id string, text string, ord bigint")
    done = annotate_rows(rows, Model("m", dying(str(calls), 0), rows=5, waves=5))
    assert {r.sentiment for r in done.labels.collect()} == {"Skipped"} and done.labels.count() == 400
    assert done.audit.count() == len(os.listdir(calls)) < 40


def test_all_sheets_in_one_write(spark, tmp_path):
    """Five sheets from one scan; another run rewrites the segments it has rows of and no others."""
    folder = str(tmp_path / "sheets")
    label = "community string, kind string, model string, id string, sentiment string, toxicity string, topics string"
    macro = "community string, kind string, model string, summary string, patterns string"
    labels = lambda *rows: spark.createDataFrame([(c, "posts", "m", i, s, s, None) for c, i, s in rows], label)
    macros = lambda *rows: spark.createDataFrame([(c, "posts", "m", s, None) for c, s in rows], macro)
    tracker, before = spark.sparkContext.statusTracker(), len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    for _ in range(2):
        write_annotations(labels(("a", "1", "x"), ("a", None, "y"), ("b", "1", "z")), macros(("a", "s1"), ("b", "s2")), folder)
    write_annotations(labels(("b", "9", "new")), macros(), folder)
    assert len(tracker.getJobIdsForGroup()) - before <= 9  # a write is the shuffle's job and its own
    got = {(r.community, r.id, r.sentiment) for r in read_sheet(spark, folder, "sentiment").collect()}
    assert got == {("a", "1", "x"), ("a", None, "y"), ("b", "9", "new")}
    assert {(r.community, r.summary) for r in read_sheet(spark, folder, "summary").collect()} == {("a", "s1"), ("b", "s2")}
    assert {r.topics for r in read_sheet(spark, folder, "topics").collect()} == {None}
    plan = read_sheet(spark, folder, "topics")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sheet" in plan


def test_a_folder_whose_first_file_is_empty(spark, tmp_path):
    folder = tmp_path / "news_posts.csv"
    folder.mkdir()
    (folder / "part-00000.csv").write_text("")
    (folder / "part-00001.csv").write_text("post ID,title\nt3_1,x\n")
    assert csv_header(spark, str(folder)) == ("post ID", "title")
    assert [(r.post_id, r.ord) for r in read_posts(spark, str(folder)).collect()] == [("t3_1", 0)]
