import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.constants import RAW_COMMENT_FIELDS, RAW_POST_FIELDS
from threadloom.operators.harvest import document_comments, document_posts, harvest_documents
from threadloom.operators.metrics import (
    annotator_pairs, model_agreement, pair_agreement, sentiment_distribution, top_topics, toxicity_prevalence,
)
from threadloom.operators.narrative import narrative_matrix
from threadloom.operators.reports import agreement_document, harvest_report, narrative_document
from threadloom.plans.exchange import _dumped
from threadloom.sources.documents import read_documents, read_feed_posts
from threadloom.sources.sheets import id_column, read_annotations, read_comments, read_macro, read_posts
from threadloom.sources.sinks import export_log, write_csv, write_documents, write_report, write_segments

ANN = "community string, kind string, model string, id string, sentiment string, toxicity string, topics string, ord bigint"


def annotations(frame, rows):
    return frame([(c, k, m, i, s, t, p, n) for n, (c, k, m, i, s, t, p) in enumerate(rows)], ANN)


def test_agreement_rules(frame):
    a = annotations(frame, [
        ("g", "posts", "gemini", "1", " positive", "Low", None), ("g", "posts", "groq", "1", "Positive ", "safe", None),
        ("g", "posts", "gemini", "2", "Skipped", "Skipped", None), ("g", "posts", "groq", "2", "Neutral", "Low", None),
        ("g", "posts", "gemini", "3", "Neutral", "High", None), ("g", "posts", "groq", "3", "Unknown", "Unknown", None),
        ("g", "posts", "gemini", "4", None, None, None), ("g", "posts", "groq", "4", None, None, None),
        ("g", "posts", "gemini", "5", "Mixed", "Toxict", None), ("g", "posts", "groq", "6", "Mixed", "Toxict", None),
        ("h", "posts", "gemini", "7", "Unknown", "High", None), ("h", "posts", "groq", "7", "Mixed", "Medium", None),
    ])
    got = {(r.community, r.label): (r.sample_rows, r.matches, r.agreement_pct) for r in model_agreement(a).collect()}
    # a missing sentiment agrees with nothing, two missing toxicities agree
    assert got[("g", "sentiment")] == (3, 1, pytest.approx(100 / 3))
    assert got[("g", "toxicity")] == (3, 2, pytest.approx(200 / 3))
    assert got[("h", "sentiment")] == (0, 0, None) and got[("h", "toxicity")] == (1, 1, 100.0)


def test_repeated_ids_count_every_pair_without_building_it(frame):
    """Four equal rows against three rows are twelve pairs, from three joined rows."""
    schema = "community string, kind string, id string, sentiment string, toxicity string"
    a = frame([("g", "posts", "1", "Neutral", "Low")] * 4, schema)
    b = frame([("g", "posts", "1", "neutral", "Low")] * 2 + [("g", "posts", "1", "Mixed", "High")], schema)
    pairs = annotator_pairs(a, b)
    assert pairs.count() == 3
    got = {r.label: (r.sample_rows, r.matches) for r in pair_agreement(pairs).collect()}
    assert got == {"sentiment": (12, 8), "toxicity": (12, 8)}


def test_agreement_document(frame):
    a = annotations(frame, [
        ("g", "posts", "gemini", "1", "Neutral", "Skipped", None), ("g", "posts", "groq", "1", "neutral", "Low", None)])
    lines = [r.line for r in agreement_document(model_agreement(a)).orderBy("community", "kind_no", "label_no").collect()]
    assert "\n".join(lines).split("\n") == [
        "=" * 66, "               LLM MODEL AGREEMENT AUDIT REPORT                   ", "=" * 66, "",
        "📊 g Posts -> Sentiment Agreement Rate: 100.00% (Sample Window: 1 rows)",
        "💀 g Posts -> Toxicity Agreement Rate: Insufficient valid data pairs.", ""]


def test_distribution_denominator_and_zero_fill(frame):
    a = annotations(frame, [("g", "posts", "m", str(i), s, "Low", None) for i, s in enumerate(
        ["positive", " NEGATIVE ", "Sarcastic", None, "Strongly Negative", "Positive"])])
    got = {r.sentiment: (r.n, r.total, round(r.pct, 3)) for r in sentiment_distribution(a).collect()}
    assert got == {"Positive": (2, 3, 66.667), "Negative": (1, 3, 33.333), "Neutral": (0, 3, 0.0)}
    assert sentiment_distribution(a.where("false")).count() == 0


def test_prevalence_without_toxic_rows_and_order(frame):
    a = annotations(frame, [("a", "posts", "m", "1", None, "Low", None), ("b", "posts", "m", "2", None, "high", None),
                            ("b", "comments", "m", "3", None, "Toxict", None), ("c", "posts", "m", "4", None, None, None)])
    assert [tuple(r) for r in toxicity_prevalence(a).collect()] == [("b", 1, 1, 50.0), ("a", 0, 1, 0.0)]


def test_top_topics_ties_by_first_appearance(frame):
    cells = ["ai, Phone, steam", "['Steam', \"ai\"]", None, "xbox,ps5, POST ,,", "ps5, xbox, pc"]
    a = annotations(frame, [("g", "comments" if i == 0 else "posts", "m", str(i), None, None, c)
                            for i, c in enumerate(cells)])
    counted = Counter()
    for i in (1, 3, 4, 0):  # posts first
        for t in cells[i].replace("[", "").replace("]", "").replace('"', "").replace("'", "").split(","):
            t = t.strip().title()
            if t and t.lower() not in ("phone", "post"):
                counted[t] += 1
    got = [(r.topic, r.n) for r in top_topics(a, 3).orderBy("rank").collect()]
    assert got == counted.most_common(3)


RAW_POST = {"post ID": "t3_a", "subreddit name": "demo", "title": "T", "body/self-text": "", "author": None,
            "creation timestamp": 1785314403, "score/upvotes": 4, "number of comments": 2, "URL/permalink": "u"}
RAW_COMMENT = {"comment ID": "t1_b", "parent post ID": "t3_a", "parent comment ID": "t3_a", "subreddit": "demo",
               "comment text": 'two\nlines "q"', "author": "bob", "timestamp": 1785314500, "score/upvotes": None}


def test_documents_in_and_out(spark, tmp_path):
    docs = {"d1": {"subreddit": "demo", "posts": [RAW_POST, {**RAW_POST, "post ID": "t3_c"}], "comments": [RAW_COMMENT]},
            "d2": {"metadata": {"subreddit": "demo", "mode": "post", "timestamp": "x", "total_posts": 1,
                                "total_comments": 0}, "posts": [RAW_POST]},
            "d3": {"posts": [], "comments": []}}
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=2))
    read = read_documents(spark, f"{tmp_path}/*.json")
    assert read.count() == 3
    posts, comments = document_posts(read, "file"), document_comments(read, "file")
    assert [(r.post_id, r.ord) for r in posts.where("file like '%d1.json'").orderBy("ord").collect()] == [("t3_a", 0), ("t3_c", 1)]
    assert comments.first().text == 'two\nlines "q"' and comments.count() == 1
    out = harvest_documents(posts, comments, ["file"], "both", F.lit("stamp"), part_rows=1)
    write_documents(out, str(tmp_path / "out"))
    again = read_documents(spark, f"{tmp_path}/out/*.json", multi_line=False)
    assert again.count() == 3  # d1 in two parts, d2 in one, the empty document in none
    assert again.select(F.sum("metadata.total_posts")).first()[0] == 2 + 2 + 1
    assert sorted(r.post_id for r in document_posts(again).collect()) == ["t3_a", "t3_a", "t3_c"]


def test_missing_documents_are_an_empty_frame(spark, tmp_path):
    empty = read_documents(spark, f"{tmp_path}/none/*.json")
    assert empty.count() == 0 and document_posts(empty).count() == 0
    assert read_feed_posts(spark, f"{tmp_path}/none*.json").columns[-1] == "ord"
    assert read_posts(spark, f"{tmp_path}/none*.csv").count() == 0
    assert read_annotations(spark, str(tmp_path)).count() == 0


REPORT = """\
=== HARVEST REPORT: r/demo [POST] - s ===

--- POSTS ---
[t3_a] T
Author: None | Score: 4 | Comments: 2
URL: u
{rule}
[t3_c] T
Author: None | Score: 4 | Comments: 2
URL: u
Body: body
{rule}

--- COMMENTS ---
[t1_b] Post: t3_a | Author: bob | Score: None
Text: two
lines "q"
{rule}
""".format(rule="-" * 50)


def test_harvest_report_file(spark, tmp_path):
    posts = [RAW_POST, {**RAW_POST, "post ID": "t3_c", "body/self-text": "body"}]
    (tmp_path / "d.json").write_text(json.dumps({"posts": posts, "comments": [RAW_COMMENT]}))
    read = read_documents(spark, f"{tmp_path}/d.json").withColumn("k", F.lit("k1"))
    lines = harvest_report(document_posts(read, "k"), document_comments(read, "k"), ["k"], F.lit("demo"), "post", F.lit("s"))
    write_report(lines, str(tmp_path / "out"), ["section", "ord"], ["k"])
    folder = tmp_path / "out" / "k=k1"
    text = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert text == REPORT
    nothing = harvest_report(document_posts(read.where("false"), "k"), document_comments(read.where("false"), "k"),
                             ["k"], F.lit("demo"), "post", F.lit("s"))
    assert nothing.count() == 0


def test_export_log_has_banners_around_sections(frame, spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"posts": [RAW_POST], "comments": [RAW_COMMENT]}))
    read = read_documents(spark, f"{tmp_path}/d.json")
    lines = [r.line for r in export_log(document_posts(read), document_comments(read), F.lit("demo")).orderBy("section", "ord").collect()]
    assert lines[0] == f"{'=' * 20} START STREAM HARVEST: r/demo {'=' * 20}" and "END STREAM HARVEST" in lines[-1]
    lines = lines[1:-1]
    assert [l.strip().split(":")[0] for l in lines] == [
        "###--- START_POSTS_EXPORT ---###", "POST_ROW", "###--- END_POSTS_EXPORT ---###",
        "###--- START_COMMENTS_EXPORT ---###", "COMMENT_ROW", "###--- END_COMMENTS_EXPORT ---###"]
    assert json.loads(lines[1][len("POST_ROW:"):]) == RAW_POST
    assert json.loads(lines[4][len("COMMENT_ROW:"):]) == RAW_COMMENT


def sheet(folder, name, text):
    (folder / name).write_text(text)


@pytest.fixture()
def sheets(tmp_path):
    """Usual headers for posts, drifted headers for comments, a second model with posts only."""
    sheet(tmp_path, "Demo_Posts_Groq_Sentiment.csv", "post ID,sentiment\nt3_a,Neutral\nt3_b,None\n")
    sheet(tmp_path, "Demo_Posts_Groq_Toxicity.csv", "post ID,toxicity\nt3_a,Low\nt3_b,High\n")
    sheet(tmp_path, "Demo_Posts_Groq_Topics.csv", 'post ID,topics\nt3_a,"x, ""y"""\nt3_b,\n')
    sheet(tmp_path, "Demo_Posts_Gemini_Sentiment.csv", "post ID,sentiment\nt3_a,neutral\nt3_b,Skipped\n")
    sheet(tmp_path, "Demo_Posts_Gemini_Toxicity.csv", "post ID,toxicity\nt3_a,High\nt3_b,Skipped\n")
    sheet(tmp_path, "Demo_Comments_Groq_Sentiment.csv", "comment ID,Sentiment\nt1_a,Positive\n")
    sheet(tmp_path, "Demo_Comments_Groq_Toxicity.csv", "comment ID,Toxicity\nt1_a,Toxic\n")
    sheet(tmp_path, "Demo_Comments_Groq_Topics.csv", "comment ID,Topic\nt1_a,z\n")
    sheet(tmp_path, "Demo_Posts_Groq_Summarization.csv", 'summary\n" three\nlines "\n')
    sheet(tmp_path, "Demo_Posts_Groq_Patterns.csv", "patterns\np1 | p2\n")
    sheet(tmp_path, "Demo_Comments_Groq_Patterns.csv", "Pattern Number,Discussion Pattern\n1,q1\n2,q2\n3,q3\n")
    return tmp_path


def test_annotation_sheets(spark, sheets):
    got = {(r.kind, r.model, r.id): (r.sentiment, r.toxicity, r.topics) for r in read_annotations(spark, str(sheets)).collect()}
    assert got[("posts", "groq", "t3_a")] == ("Neutral", "Low", 'x, "y"')
    assert got[("posts", "groq", "t3_b")] == (None, "High", None)
    assert got[("comments", "groq", "t1_a")] == ("Positive", "Toxic", "z")
    assert got[("posts", "gemini", "t3_b")] == ("Skipped", "Skipped", None)
    strict = {r.kind for r in read_annotations(spark, str(sheets), strict=True).collect()}
    assert strict == {"posts"}


def test_sheets_of_many_files_keep_the_order_of_their_rows(spark, tmp_path):
    """Parts of different lengths in each sheet, read in any order: rows of a NULL or repeated id stay together."""
    ids = [("", "7", "7", str(i))[i % 4] for i in range(60)]
    for sheet, label, widths in (("Sentiment", "sentiment", (1, 900, 30)), ("Toxicity", "toxicity", (900, 30, 1)),
                                 ("Topics", "topics", (30, 1, 900))):
        folder = tmp_path / f"All_Posts_Groq_{sheet}.csv"
        folder.mkdir()
        for part in range(3):
            lines = [f"{ids[i]},row {i} {'x' * widths[part]}" for i in range(part * 20, part * 20 + 20)]
            (folder / f"part-{part:05}.csv").write_text(f"post ID,{label}\n" + "\n".join(lines) + "\n")
    got = read_annotations(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.id or "", *(v.split()[1] for v in (r.sentiment, r.toxicity, r.topics))) for r in got] == [
        (ids[i], str(i), str(i), str(i)) for i in range(60)]


def test_tables_under_several_headers_share_one_order(spark, tmp_path):
    (tmp_path / "a_posts.csv").write_text("post_id,title\n" + "\n".join(f"a{i},t" for i in range(9)) + "\n")
    (tmp_path / "b_posts.csv").write_text("post_id,title,body\n" + "\n".join(f"b{i},{'t' * 500},u" for i in range(9)) + "\n")
    (tmp_path / "c_posts.csv").write_text("post_id,title\n" + "\n".join(f"c{i},{'t' * 900}" for i in range(9)) + "\n")
    got = {r.ord: r.post_id for r in read_posts(spark, f"{tmp_path}/*_posts.csv").collect()}
    assert got == {9 * k + i: f"{c}{i}" for k, c in enumerate("abc") for i in range(9)}


def test_sheet_agreement_end_to_end(spark, sheets):
    got = {r.label: (r.matches, r.sample_rows) for r in model_agreement(read_annotations(spark, str(sheets))).collect()}
    assert got == {"sentiment": (1, 1), "toxicity": (0, 1)}


def test_narrative_from_sheets(spark, sheets, frame):
    macro = read_macro(spark, str(sheets))
    m = narrative_matrix(frame([("Demo", 0), ("Other", 1)], "community string, ord bigint"), macro)
    got = {(r.community, r.kind): r for r in m.collect()}
    assert got[("Demo", "posts")].groq_summary == "three\nlines"
    assert got[("Demo", "posts")].groq_patterns == "p1<br><br>p2"
    assert got[("Demo", "comments")].groq_patterns == "q1<br><br>q2<br><br>q3"
    assert got[("Other", "posts")].groq_summary == "No data summary generated."
    assert got[("Other", "comments")].gemini_patterns == "Analysis tier skipped."
    lines = [r.line for r in narrative_document(m).orderBy("place", "ord", "community").collect()]
    assert lines.index("## 💬 1. Cross-Subreddit Analytical Matrix: POSTS") < lines.index(
        "| **r/Demo** | p1<br><br>p2 | Analysis tier skipped. |") < lines.index(
        "## 💬 1. Cross-Subreddit Analytical Matrix: COMMENTS")


def test_id_column_discovery():
    assert id_column(["sentiment", "comment ID"]) == "comment ID" and id_column(["x", "post_id"]) == "post_id"


def test_tables_with_missing_tokens_and_extra_columns(spark, tmp_path):
    sheet(tmp_path, "Demo_posts.csv", 'post ID,title,body/self-text,score/upvotes,creation timestamp,creationtimestamp\n'
          'a,None,"l1\nl2 ""q""",7.0,,1785314403\nb,,text,,2026-07-03 23:08:00,\n')
    rows = {r.post_id: r for r in read_posts(spark, f"{tmp_path}/*_posts.csv").collect()}
    assert rows["a"].title is None and rows["a"].body == 'l1\nl2 "q"' and rows["a"].score == 7
    assert rows["a"].community == "Demo" and rows["a"].creationtimestamp == "1785314403"
    kept = {r.post_id: r for r in read_posts(spark, f"{tmp_path}/*_posts.csv", pandas_na=False).collect()}
    assert kept["a"].title == "None" and kept["b"].title is None


def test_csv_sink_keeps_outer_blanks_and_quotes(spark, frame, tmp_path):
    df = frame([("a", ' padded "q"\nnext ', "demo")], "comment_id string, text string, community string")
    write_csv(df, str(tmp_path / "Demo_comments.csv"), {"comment_id": "comment ID", "text": "comment text", "community": "subreddit"})
    row = read_comments(spark, str(tmp_path / "Demo_comments.csv")).first()
    assert (row.comment_id, row.text, row.community) == ("a", ' padded "q"\nnext ', "demo")


def test_segment_tables_are_pruned_by_partition(spark, frame, tmp_path):
    df = frame([(c, k, i) for c in "ab" for k in ("posts", "comments") for i in range(5)], "community string, kind string, n int")
    write_segments(df, str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t")).where("community = 'a' and kind = 'posts'")
    assert one.count() == 5
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(community" in plan


def test_pairs_of_frames_with_one_label(frame):
    a = frame([("c", "posts", "1", "Low")], "community string, kind string, id string, toxicity string")
    assert pair_agreement(annotator_pairs(a, a, ("toxicity",))).first().agreement_pct == 100.0


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_totals_of_documents_do_not_gather_their_records(spark):
    """what meets per group is a narrow row per part, never the arrays of all its parts."""
    rows = spark.range(50).selectExpr("if(id % 7 = 0, null, 'c' || id % 2) as community", "id as ord", *[
        f"cast(id as string) as {n}" for n in {*RAW_POST_FIELDS.values(), *RAW_COMMENT_FIELDS.values()} - {"community"}])
    out = harvest_documents(rows, rows.where("ord % 3 = 0"), ["community"], part_rows=4)
    windows = [n for n in _nodes(out._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows and not any("array" in w.schema().simpleString() for w in windows)
    got = out.groupBy("community").agg(
        F.min("metadata.total_posts").alias("p"), F.max("metadata.total_posts").alias("p2"), F.sum(F.size("posts")).alias("n"),
        F.min("metadata.total_comments").alias("c"), F.max("metadata.total_comments").alias("c2"),
        F.sum(F.size("comments")).alias("m"), F.count("*").alias("parts"), F.min("metadata.subreddit").alias("name")).collect()
    assert {r.community: (r.p, r.p2, r.n, r.c, r.c2, r.m, r.parts, r.name) for r in got} == {
        None: (8, 8, 8, 3, 3, 3, 2, None), "c0": (21, 21, 21, 7, 7, 7, 6, "c0"), "c1": (21, 21, 21, 7, 7, 7, 6, "c1")}


def test_a_feed_dump_is_written_by_many_tasks(spark):
    """no file holds a fixed share of the feed, and the files still follow each other in feed order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        feed = spark.range(4000).repartition(5).selectExpr("id as ord", "cast(id as string) as id", "'t' as title")
        pattern = _dumped(spark, feed)
        lines = [r["count"] for r in spark.read.text(pattern).groupBy(F.input_file_name()).count().collect()]
        assert sum(lines) == 4000 and max(lines) < 1000
        assert read_feed_posts(spark, pattern).where("ord <> cast(id as bigint)").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
