import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators.ordering import first_n, keep_first, keep_last, running_total_before, with_ordinal


def hot_rows(n=400, seed=3):
    """A third of the rows share one key, another key is NULL, ords are sparse and shuffled."""
    rng = random.Random(seed)
    ords = rng.sample(range(-50, 100_000), n)
    keys = [rng.choice(["hot", "hot", "b", "c", None, "d"]) for _ in ords]
    return [(k, o, rng.randint(0, 5)) for k, o in zip(keys, ords)]


def brute(rows):
    out, totals = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        out[(k, o)] = totals.get(k, 0)
        totals[k] = totals.get(k, 0) + v
    return out, totals


@pytest.mark.parametrize("block,levels", [(1, 1), (7, 1), (1 << 16, 1), (7, 2), (3, 3)])
def test_running_total_matches_brute_force(frame, block, levels):
    rows = hot_rows()
    df = frame(rows, "k string, ord bigint, v bigint")
    got = running_total_before(df, ["k"], "ord", F.col("v"), "before", "total", block, levels).collect()
    before, totals = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.before == before[(r.k, r.ord)] and r.total == totals[r.k]


def test_ordinals_have_no_gaps(frame):
    rows = hot_rows()
    got = with_ordinal(frame(rows, "k string, ord bigint, v bigint"), ["k"], block=10).collect()
    for k in {r[0] for r in rows}:
        mine = sorted((r.ord, r.ord0) for r in got if r.k == k)
        assert [o for _, o in mine] == list(range(len(mine)))


def test_no_block_holds_more_rows_than_its_size(frame):
    """The shuffle key of the wide rows includes the block, so a hot key is spread."""
    df = frame(hot_rows(), "k string, ord bigint, v bigint")
    plan = with_ordinal(df, ["k"], block=10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__block" in plan


def test_keep_first_and_last(frame):
    df = frame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "p"), (None, 4, "q")], "id string, ord bigint, v string")
    assert {(r.id, r.v) for r in keep_first(df, ["id"]).collect()} == {("a", "y"), (None, "q")}
    assert {(r.id, r.v) for r in keep_last(df, ["id"], "ord").collect()} == {("a", "x"), (None, "p")}
    once = keep_first(df, ["id"])
    assert sorted(map(str, keep_first(once, ["id"]).collect())) == sorted(map(str, once.collect()))


def test_first_n_limits_groups_before_the_shuffle(frame):
    df = frame(hot_rows(), "k string, ord bigint, v bigint")
    plan = first_n(df, ["k"], F.col("ord"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("n", [3, 999, 1000, 2500])
def test_first_n_of_any_size(frame, n):
    df = frame([("hot" if i % 3 else "b", i) for i in range(6000)], "k string, ord bigint")
    got = first_n(df, ["k"], F.col("ord").desc(), n, rank="rank").collect()
    for k in ("hot", "b"):
        ords = sorted((i for i in range(6000) if (i % 3 != 0) == (k == "hot")), reverse=True)[:n]
        assert sorted((r.rank, r.ord) for r in got if r.k == k) == list(enumerate(ords, 1))


def test_the_first_row_of_a_key_is_shuffled_once(spark):
    """F8: de-duplication moves each row once at most, and the row that stays is whole."""
    df = spark.range(600).selectExpr("if(id % 50 = 7, null, id % 50) as k", "599 - id as ord", "concat('v', id) as v", "null as n")
    first = keep_first(df, ["k"])
    assert first._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.k: (r.ord, r.v, r.n) for r in first.collect()}
    assert first.columns == df.columns and len(got) == 50
    assert all(v == (49 - k if k is not None else 42, f"v{550 + (7 if k is None else k)}", None) for k, v in got.items())
