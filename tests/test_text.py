import datetime

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from threadloom.functions import dates, labels, text

TEXTS = st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn")), max_size=12),
                 min_size=1, max_size=30)
SLOW = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


@settings(**SLOW)
@given(TEXTS)
def test_utrim_is_python_strip(spark, values):
    assert column(spark, values, text.utrim) == [v.strip() for v in values]


WORDS = ["3d gen-z iPhone o'neil ßa", "ǆabc ŉa ﬁx", "they're 1ST", "", "x", "A-b_c d", "ÉCOLE élève", "ma\tnus",
         "two  blanks", "PS5 vs xbox360s"]


def test_title_case_is_python_title(spark):
    assert column(spark, WORDS, text.title_case) == [w.title() for w in WORDS]


def test_capitalize_touches_the_first_character_only(spark):
    values = ["sTRONGLY negative", "mIXED", "", "x"]
    assert column(spark, values, text.capitalize) == [v.capitalize() for v in values]


def python_tokens(cell):
    for c in "[]\"'":
        cell = cell.replace(c, "")
    return [t.strip().title() for t in cell.split(",") if t.strip()]


def test_topic_tokens(spark):
    cells = ["['ps5', \"xbox one\"]", "a,,b , ", "", " , ", "gen-z,3d printing", "one two,　three"]
    assert column(spark, cells, text.topic_tokens) == [python_tokens(c) for c in cells]


def test_post_text_keeps_the_blank(frame):
    rows = frame([("t", None), (None, "b"), (None, None), ("t", "b")], "a string, b string")
    got = [r[0] for r in rows.select(text.post_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["t ", " b", " ", "t b"]


def test_target_name(spark):
    values = [None, "", "  ", "r/Gaming", " R/Tech ", "technology"]
    assert column(spark, values, text.target_name) == [
        "formula1", "formula1", "formula1", "gaming", "tech", "technology"]


def test_percent_rounds_ties_like_python(frame):
    values = [57.777777, 3.125, 9.375, 100.0, 0.0, 66.666666]
    rows = frame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(text.percent(F.col("v"), 2)).collect()] == [f"{v:.2f}%" for v in values]


def test_toxicity_buckets_differ_between_audit_and_chart(spark):
    values = ["Low", " HIGH ", "Toxict", "Unknown", "Non-Toxic", "safe", "medium", None]
    assert column(spark, values, labels.audit_toxicity) == [
        "safe", "toxic", "toxict", "unknown", "safe", "safe", "toxic", None]
    assert column(spark, values, labels.chart_toxicity) == [
        "Non-Toxic", "Toxic", "Non-Toxic", "Non-Toxic", "Non-Toxic", "Non-Toxic", "Toxic", "Non-Toxic"]


def test_fill_labels_are_matched_without_trimming(spark):
    assert column(spark, ["Skipped", "UNKNOWN", " skipped", None, "Low"], labels.is_annotated) == [
        False, False, True, True, True]


def test_epoch_text_in_any_session_zone(spark, frame):
    rows = frame([("1785314403",), ("1785314403.9",), ("0",), ("bad",), (None,), ("99999999999999",), ("-1",)],
                 "v string")
    expected = ["2026-07-29 08:40:03", "2026-07-29 08:40:03", "1970-01-01 00:00:00", None, None, None,
                "1969-12-31 23:59:59"]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r[0] for r in rows.select(dates.epoch_to_text(dates.whole_number(F.col("v")))).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == expected


def test_mixed_date_texts(spark):
    values = ["2026-07-03 23:08:00", "2026-07-03", "03-07-2026 23:08", "07/03/2026 23:08", "2026-07-03T23:08:01",
              "soon", "", None]
    assert column(spark, values, dates.standard_date_text) == [
        "2026-07-03 23:08:00", "2026-07-03 00:00:00", "2026-07-03 23:08:00", "2026-07-03 23:08:00",
        "2026-07-03 23:08:01", None, None, None]


def test_millis(frame):
    rows = frame([(1999,), (None,), (-1,), (0,)], "v bigint")
    assert [r[0] for r in rows.select(dates.millis_to_epoch(F.col("v"))).collect()] == [1, 0, -1, 0]


def test_run_stamp_is_injectable(frame):
    rows = frame([(datetime.datetime(2026, 7, 29, 23, 57, 1),)], "t timestamp_ntz")
    assert rows.select(dates.run_stamp(F.col("t"))).first()[0] == "20260729_235701"


def test_micros_of_naive_times(frame):
    times = [datetime.datetime(1970, 1, 1), datetime.datetime(2024, 2, 29, 23, 59, 59, 999999),
             datetime.datetime(1969, 12, 31, 23, 59, 58, 500000)]
    rows = frame([(t,) for t in times], "t timestamp_ntz")
    zero = datetime.datetime(1970, 1, 1)
    assert [r[0] for r in rows.select(dates.ts_to_micros(F.col("t"))).collect()] == [
        (t - zero) // datetime.timedelta(microseconds=1) for t in times]
