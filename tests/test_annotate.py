import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators.annotate import Model, annotate_corpus, annotate_rows, audit_rows, call_annotator
from threadloom.operators.batching import assign_batches, corpus_prompts, gather_requests, slice_batch
from threadloom.operators.resolve import coverage, resolve_slice
from threadloom.plans import rules

ROWS = "community string, kind string, id string, text string, ord bigint"


@pytest.fixture()
def rows(frame):
    """Two segments, one with two thirds of the rows; ords have gaps."""
    data = [("hot", "posts", f"h{i}", f"text {i}\nline two" if i % 4 else "", i * 3) for i in range(120)]
    data += [("b", "comments", f"b{i}", "x" * i, 1000 - i) for i in range(47)]
    return frame(data, ROWS)


@pytest.mark.parametrize("mode,block", [("exact", 1 << 16), ("exact", 7), ("partition", 10), ("partition", 1 << 16)])
def test_every_row_is_in_one_batch(rows, mode, block):
    requests = gather_requests(assign_batches(rows, 5, mode=mode, block=block)).collect()
    members = [m for r in requests for m in r.members]
    assert len(members) == 167 and len(set(members)) == 167
    assert all(1 <= len(r.members) <= 5 for r in requests)
    assert len({(r.community, r.batch_no) for r in requests}) == len(requests)
    if mode == "exact":
        hot = sorted((r.batch_no, r.members) for r in requests if r.community == "hot")
        assert [n for n, _ in hot] == list(range(24)) and hot[0][1] == [f"h{i}" for i in range(5)]


def test_partition_mode_shuffles_text_once(rows):
    exact, partition = (
        gather_requests(assign_batches(rows, mode=m))._jdf.queryExecution().executedPlan().toString()
        for m in ("exact", "partition"))
    assert partition.count("Exchange hashpartitioning") == 1
    assert exact.count("Exchange hashpartitioning") > 1


def test_prompt_layout(rows):
    r = gather_requests(slice_batch(rows.where("community = 'hot'"), 3), header="H\n").first()
    assert r.members == ["h0", "h1", "h2"]
    assert r.prompt == "H\nID: h0 | Text: \nID: h1 | Text: text 1\nline two\nID: h2 | Text: text 2\nline two\n"
    assert rules.prompt_items(r.prompt) == [("h0", ""), ("h1", "text 1\nline two"), ("h2", "text 2\nline two")]


def test_corpus_prompt_takes_the_first_texts(rows):
    prompt = corpus_prompts(rows, 3, header="").where("community = 'b'").first().prompt
    assert prompt == "\n".join(f"Content block [{i}]: {'x' * (46 - i)}" for i in range(3))


def test_sweep_and_slice(rows):
    sweep = annotate_rows(rows, Model("sweep", rules.by_length), parallelism=3)
    got = {r.id: r for r in sweep.labels.collect()}
    assert len(got) == 167 and got["b4"].topics == "len 4" and got["b4"].model == "sweep"
    assert sweep.audit.count() == 24 + 10
    assert {r.errors_encountered for r in sweep.audit.collect()} == {"None"}
    cut = annotate_rows(rows, Model.slice("cut", rules.by_length)).labels
    c = {r.community: r for r in coverage(cut).collect()}
    assert (c["hot"].labelled, c["hot"].skipped, c["b"].labelled, c["b"].skipped) == (45, 75, 45, 2)


def test_failed_batches_are_unknown_in_a_sweep_and_skipped_in_a_slice(rows):
    def broken(prompt):
        raise ValueError("down")

    sweep = annotate_rows(rows, Model("m", broken, max_attempts=2))
    assert {r.sentiment for r in sweep.labels.collect()} == {"Unknown"}
    assert sweep.audit.count() == 2 * 34
    assert all("ValueError: down" in r.errors_encountered for r in sweep.audit.limit(3).collect())
    cut = annotate_rows(rows, Model.slice("m", broken)).labels
    assert {r.toxicity for r in cut.collect()} == {"Skipped"}


def test_flaky_annotator_is_tried_again(rows):
    seen = {}

    def flaky(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if seen[prompt] < 3:
            raise ValueError("try again")
        return rules.by_length(prompt)

    done = annotate_rows(rows, Model("m", flaky))
    assert done.labels.where("sentiment = 'Unknown'").count() == 0
    assert done.audit.count() == 3 * 34


def test_used_up_quota_is_the_outcome_of_its_request_alone(frame):
    requests = frame([(i, f"p{i}") for i in range(6)], "n int, prompt string").coalesce(1).sortWithinPartitions("n")

    def quota(prompt):
        if prompt == "p2":
            raise RuntimeError("Daily quota is used up")
        return "{}"

    got = [(r.n, r.status, len(r.attempts)) for r in call_annotator(requests, Model("m", quota)).orderBy("n").collect()]
    assert got == [(n, "unavailable" if n == 2 else "ok", 1) for n in range(6)]


def test_model_that_was_not_run(rows):
    labels = annotate_rows(rows, Model("off", None)).labels
    assert labels.count() == 167 and labels.where("topics <> 'Skipped'").count() == 0
    macro, audit = annotate_corpus(rows, Model("off", None))
    assert audit is None and {tuple(r[3:]) for r in macro.collect()} == {("Skipped", "Skipped")}


def test_corpus(rows):
    macro, audit = annotate_corpus(rows, Model("m", lambda p: json.dumps({"summary": "s", "patterns": ["a", "b"]})))
    assert {tuple(r) for r in macro.collect()} == {("hot", "posts", "m", "s", "a | b"), ("b", "comments", "m", "s", "a | b")}
    assert {r.input_text_identifiers for r in audit.collect()} == {"MACRO_CORPUS_SLICE"}
    silent, _ = annotate_corpus(rows, Model("m", lambda p: None))
    assert {r.summary for r in silent.collect()} == {"No summary generated."}
    skipped, _ = annotate_corpus(rows, Model.slice("m", lambda p: None))
    assert {r.summary for r in skipped.collect()} == {"Skipped"}


def test_row_past_the_slice_is_skipped_although_its_id_was_labelled(frame):
    base = frame([("c", "posts", "dup", i) for i in range(3)], "community string, kind string, id string, ord bigint")
    labels = frame([("c", "posts", "dup", "Neutral", "Low", "t")],
                   "community string, kind string, id string, sentiment string, toxicity string, topics string")
    got = {r.ord: r.sentiment for r in resolve_slice(base, labels, 2).collect()}
    assert got == {0: "Neutral", 1: "Neutral", 2: "Skipped"}


def test_audit_text_is_one_line(rows):
    audit = annotate_rows(rows.limit(5), Model("m", rules.by_length)).audit
    assert audit.where(F.col("prompt_used").contains("\n")).count() == 0
    called = annotate_rows(rows.limit(5), Model("m", rules.by_length)).responses
    kept = audit_rows(called, "m", flatten=False)
    assert kept.where(F.col("prompt_used").contains("\n")).count() == kept.count() > 0


def test_python_holds_few_prompts_at_a_time(spark):
    """400 MB of prompts in one task don't meet in its Python worker."""
    def memory(prompt):
        with open("/proc/self/status") as f:
            return next(line.split()[1] for line in f if line.startswith("VmRSS"))

    requests = spark.range(4000, numPartitions=1).selectExpr("id", "concat(id, repeat('x', 100000)) as prompt")
    done = call_annotator(requests, Model("m", memory)).selectExpr(
        "max(cast(response as bigint)) / 1000 as mb", "count(distinct id) as n", "sum(length(prompt)) as chars").first()
    assert done.n == 4000 and done.chars == 4000 * 100_000 + 10 + 180 + 2700 + 12_000 and done.mb < 350
