"""Column types against pandas' own reader."""

import io
import random

import pandas as pd
import pytest

from threadloom.sources.types import column_types, typed, union_types

KINDS = {"int64": "integer", "float64": "float", "bool": "truth", "object": "text", "str": "text"}
COLUMNS = {
    "whole": ["1", "-2", "+3", "007", " 4"], "gaps": ["1", "", "3", "NA", "5"], "floats": ["1", "2.5", "1e3", ".5", "-inf"],
    "texts": ["1", "x", "3", "", "5"], "truth": ["True", "False", "TRUE", "false", "true"], "truth_gaps": ["True", "", "False", "True", "True"],
    "truth_numbers": ["True", "1", "0", "1", "0"], "nothing": ["", "NA", "null", "", "N/A"], "dates": ["2024-01-01"] * 5,
    "huge": ["99999999999999999999"] * 5, "exponents": ["1E5", "2e-3", "3.", "4.0", "5"], "signs": ["+", "1", "2", "3", "4"],
    "hex": ["0x1F", "1", "2", "3", "4"], "inf": ["inf", "Infinity", "1", "2", "3"], "commas": ["1,000", "2", "3", "4", "5"],
}


def in_pandas(columns):
    frame = pd.read_csv(io.StringIO(pd.DataFrame(columns).to_csv(index=False)))
    return {c: "missing" if frame[c].isna().all() else KINDS[str(frame[c].dtype)] for c in frame}, frame


def test_types_as_pandas_reads_them(spark):
    columns = {c: v for c, v in COLUMNS.items() if c != "huge"}
    want, frame = in_pandas(columns)
    df = spark.createDataFrame([tuple(v[i] or None for v in columns.values()) for i in range(5)],
                               ", ".join(f"{c} string" for c in columns)).repartition(3)
    found = column_types(df)
    assert {r["column"]: r["type"] for r in found.collect()} == want
    assert {r["column"]: r["missing"] for r in found.collect()} == {c: int(frame[c].isna().sum()) for c in columns}
    values = typed(df, found)
    for c in ("whole", "gaps", "floats", "exponents", "truth", "inf", "nothing"):
        got = sorted((str(r[c]) for r in values.select(c).collect()))
        assert got == sorted("None" if pd.isna(v) else str(v) for v in frame[c].tolist())


@pytest.mark.parametrize("seed", range(3))
def test_random_mixtures(spark, seed):
    random.seed(seed)
    pool = ["1", "-5", "2.5", "1e9", "True", "False", "", "NA", "x", "0"]
    columns = {f"c{i}": random.choices(random.sample(pool, random.randint(1, 3)), k=8) for i in range(40)}
    df = spark.createDataFrame([tuple(v[i] or None for v in columns.values()) for i in range(8)],
                               ", ".join(f"{c} string" for c in columns))
    assert {r["column"]: r["type"] for r in column_types(df).collect()} == in_pandas(columns)[0]


def test_odd_frames(spark):
    one = spark.createDataFrame([("1", "99999999999999999999")], "`post ID` string, n string")
    other = spark.createDataFrame([("2",)], "`post ID` string")
    assert [(r["column"], r["type"], r["missing"]) for r in union_types([one, other]).orderBy("place").collect()] == [
        ("post ID", "integer", 0), ("n", "float", 1)]
    assert [r["type"] for r in column_types(one.limit(0)).collect()] == ["missing", "missing"]
    assert column_types(spark.range(2).select()).count() == 0
