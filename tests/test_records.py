"""CSV files cut anywhere are read like whole ones."""

import csv
import io
import random

import pytest

from threadloom.sources.records import read_records
from threadloom.sources.sheets import read_csv, read_posts

CELLS = ["", "a", "b c", 'say "hi"', '"', '""', "two\nlines", "\n", "x,y", "crlf\r\nin a cell", ',"', '",', '"\n"', "ü😀", " lead", "5\" pipe",
         "tail ", "\n\n\n", '"quoted"', "it's", "a\tb", "=1+1"]


@pytest.fixture()
def small_splits(spark):
    """Splits of a few bytes, so that most borders lie inside cells."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for key in ("maxPartitionBytes", "minPartitionNum", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def sheet(rows, terminator, quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=terminator, quoting=quoting).writerows([("id", "a", "b"), *rows])
    return out.getvalue()


@pytest.mark.parametrize("size", [7, 31, 100_000])
@pytest.mark.parametrize("terminator,quoting", [("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_ALL)])
def test_awkward_cells(spark, small_splits, tmp_path, size, terminator, quoting):
    random.seed(size)
    rows = [(str(i), random.choice(CELLS), random.choice(CELLS)) for i in range(60)]
    for k in range(2):
        (tmp_path / f"s{k}.csv").write_bytes(sheet(rows[k * 30:k * 30 + 30], terminator, quoting).encode())
    small_splits(size)
    files = [f"{tmp_path}/s{k}.csv" for k in range(2)]
    got = read_csv(spark, files, ("id", "a", "b"), pandas_na=False)
    if size == 7:
        assert spark.read.text(files).rdd.getNumPartitions() > 100
    found = sorted((r.file, r.seq, r.id, r.a or "", r.b or "") for r in got.collect())
    assert [r[1] for r in found] == [*range(30)] * 2
    assert [r[2:] for r in found] == rows


def test_equal_to_the_whole_file_reader(spark, small_splits, tmp_path):
    """Stray quotes, blank lines and short rows as Spark's own reader of whole files takes them."""
    text = 'id,a,b\n1,5" pipe,x"y\n\n2,"a"b,c\n  \n3,"multi\nline ""q"" end",z\n4,only\n5,,\n6,"",""\n7,x,"open, then closed"\n8,"a\n\n\nb",end'
    path = tmp_path / "x.csv"
    path.write_text(text)
    want = spark.read.schema("id string, a string, b string").csv(str(path), header=True, multiLine=True, quote='"', escape='"').collect()
    for size in (3, 5, 11, 1000):
        small_splits(size)
        got = read_csv(spark, [str(path)], ("id", "a", "b"), pandas_na=False).orderBy("seq").drop("file", "seq").collect()
        assert got == [r for r in want if (r.id or "").strip() or r.a], size


def test_one_file_is_read_by_many_tasks(spark, small_splits, tmp_path):
    rows = [(f"t3_{i}", f"title {i}", 'body "of"\nthree\nlines' if i % 3 else "short") for i in range(2000)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("post ID", "title", "body/self-text"), *rows])
    path = tmp_path / "news_posts.csv"
    path.write_text(out.getvalue())
    small_splits(4096)
    got = read_posts(spark, str(path))
    assert [(r.post_id, r.title, r.body) for r in got.orderBy("ord").collect()] == rows
    assert [r.ord for r in got.orderBy("ord").collect()] == list(range(2000)) and got.first().community == "news"


def test_files_without_rows(spark, tmp_path):
    for name, text in (("empty.csv", ""), ("head.csv", "id,a\n"), ("blank.csv", "id,a\n\n \n"), ("open.csv", 'id,a\n1,"never\nclosed\n')):
        (tmp_path / name).write_text(text)
    got = {r.file.rsplit("/", 1)[1]: r.record for r in read_records(spark, [f"{tmp_path}/{n}.csv" for n in ("empty", "head", "blank", "open")]).collect()}
    assert got == {"open.csv": '1,"never\nclosed'}


def _shuffled_rows(plan):
    """Rows written by the shuffles of a plan that has been run."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(_shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_lines_of_a_record_are_gathered_in_their_split(spark, small_splits, tmp_path):
    """F8: lines are shuffled once, by split; only records over a border of splits are gathered after that."""
    rows = [(f"t3_{i}", 'body "of"\nthree\nlines') for i in range(2000)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("id", "a"), *rows])
    path = tmp_path / "a.csv"
    path.write_text(out.getvalue())
    small_splits(8192)
    records = read_records(spark, [str(path)])
    assert sorted(r.seq for r in records.collect()) == list(range(2000))
    assert _shuffled_rows(records._jdf.queryExecution().executedPlan()) < 1.2 * 6001


def test_placing_rows_of_sheets_moves_none(spark, tmp_path):
    """F8: the rows' files are numbered without a shuffle of the rows."""
    for n in ("a", "b"):
        (tmp_path / f"{n}_posts.csv").write_text("post ID,title\n" + "".join(f"{n}{i},x\n" for i in range(500)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = read_posts(spark, f"{tmp_path}/*.csv")
        assert [r.post_id for r in got.orderBy("ord").collect()] == [f"{n}{i}" for n in "ab" for i in range(500)]
        got = got.select("post_id", "ord")
        got.collect()
        assert _shuffled_rows(got._jdf.queryExecution().executedPlan()) < 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
