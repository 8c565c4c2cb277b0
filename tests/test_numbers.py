"""Numbers in annotator answers are spelled as Python reads and prints them."""

import json
import math
import random
import struct

from pyspark.sql import functions as F

from threadloom.operators.responses import align, decode_items, decode_macro, mark_numbers, python_number

WRITTEN = ["0", "-0", "1", "1.0", "-0.0", "1.50", "1e400", "-1e400", "1E5", "1e16", "1.5e16", "123456789012345680.0", "1e15", "0.0001", "0.00001",
           "1.25e-7", "12345678901234567890123", "1e22", "1e23", "3.14", "100.0", "2e0", "5e-324", "1.7976931348623157e308", "0.1", "-12.5e-1", "0e5",
           "9007199254740993.0", "1e-400"]


def test_spelling(spark):
    random.seed(1)
    doubles = [struct.unpack("d", random.randbytes(8))[0] for _ in range(3000)]
    values = WRITTEN + [repr(d) for d in doubles if math.isfinite(d)] + [f"{random.uniform(-1, 1) * 10 ** random.randint(-8, 20):.{random.randint(0, 17)}e}" for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").repartition(2)
    got = {r.v: r.s for r in rows.select("v", python_number(rows.v).alias("s")).collect()}
    assert {v: s for v, s in got.items() if s != str(json.loads(v))} == {}


def test_marks_are_on_numbers_alone(spark):
    texts = ['{"a": 1.0, "b": "2.0, 3", "c": [4, -5e3, "x\\\\", 6], "d": {"7": 7}}', '["1", "a\\"1, 2", 01, +1, .5, 1., NaN, -Infinity, true]', "1.0", '"1"', "",
             '{"a":"' + "x\\n" * 50_000 + '", "b":12}', "a\x01b 1"]
    marked = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(mark_numbers(F.col("t")).alias("m")).collect()]
    m = lambda v: f'"#{v}"'
    assert marked[0] == f'{{"a": {m("1.0")}, "b": "2.0, 3", "c": [{m("4")}, {m("-5e3")}, "x\\\\", {m("6")}], "d": {{"7": {m("7")}}}}}'
    assert marked[1:5] == [texts[1], m("1.0"), '"1"', ""] and marked[5].endswith(f'"b":{m("12")}}}') and marked[6] == texts[6]


def test_items_and_members(spark):
    ids = ["1.0", "1e400", "-0.0", "1.50", "7", "12345678901234567890"]
    items = ", ".join(f'{{"id": {i}, "sentiment": {i}, "topics": [{i}, "x", true, null]}}' for i in ids)
    spelled = [str(json.loads(i)) for i in ids]
    df = spark.createDataFrame([(1, spelled, f'{{"results": [{items}]}}'), (2, spelled, f"[{items}]"), (3, ["2.0"], '{"id": 2.0, "toxicity": 3}')],
                               "batch int, members array<string>, response string")
    got = align(decode_items(df), ["batch"])
    for batch in (1, 2):
        rows = got.where(f"batch = {batch}").orderBy("pos").collect()
        assert [(r.id, r.sentiment, r.topics) for r in rows] == [(s, s, f"[{s}, 'x', True, None]") for s in spelled]
    assert got.where("batch = 3").first().toxicity == "3"
    macro = decode_macro(spark.createDataFrame([('{"summary": 1.50, "patterns": [1e3, "p", 2]}',)], "response string")).first()
    assert (macro.summary, macro.patterns) == ("1.5", "1000.0 | p | 2")
