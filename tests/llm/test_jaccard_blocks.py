"""What the Jaccard join brings together: sets that can be similar, by few copies, and no text that is not wanted."""

import random
from collections import Counter

import pytest
from helpers import jaccard_classes
from pyspark.sql import functions as F

from threadloom.llm import jaccard_join, key_bits

ROW = "doc_id long, text string"


def found(rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows.collect()}


def near_copies(groups, size=400):
    """Groups of six near copies; one copy of each group has four phrases in common with one of the next, and no more."""
    rows = []
    for k in range(groups):
        for copy in range(6):
            w = [f"w{k}x{i}" for i in range(size)]
            if copy < 2:
                for j in range(4):
                    w[90 * j:90 * j + 4] = [f"p{k + copy}x{j}x{i}" for i in range(4)]
            else:
                w[380 + copy] = f"other{copy}"
            rows.append((6 * k + copy, " ".join(w)))
    return rows


def test_sets_that_meet_by_chance_do_not_chain(spark, monkeypatch):
    blocks, components = [], jaccard_join.components

    def seen(links, name):
        out = components(links, name)
        if name == "jaccard-blocks":
            blocks.extend(r["count"] for r in out.groupBy("component").count().collect())
        return out

    monkeypatch.setattr(jaccard_join, "components", seen)
    rows = near_copies(30)
    assert found(jaccard_join.jaccard_classes(spark.createDataFrame(rows, ROW), 4, 85)) == jaccard_classes(rows, 4, 85)
    assert blocks == [6] * 30


def test_a_block_is_cut_by_set_size(spark, monkeypatch):
    """All sets that can be similar meet in one task each, and no set goes to all parts of a large block."""
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 2000)
    random.seed(7)
    sizes = [random.randint(10, 400) for _ in range(300)] + [50] * 90
    members = spark.createDataFrame(
        [(i, n, 1, i, i, 1) for i, n in enumerate(sizes)] + [(1000 + i, 9, 1, i, i, 2) for i in range(3)],
        "rep long, n long, copies long, doc_id long, hash long, block long")
    placed = jaccard_join._placed(members, 85).collect()
    assert len(placed) == len(sizes) + 3
    assert all(r.part == 0 and r.others == [0] for r in placed if r.block == 2)
    of = {r.rep: r for r in placed if r.block == 1}
    parts = Counter()
    for r in of.values():
        parts[r.part] += r.n + jaccard_join.SET_TOKENS
        assert r.part in r.others and len(set(r.others)) == len(r.others)
    assert len(parts) > 40 and max(parts.values()) < 4000
    for a in of.values():
        for b in of.values():
            if 100 * min(a.n, b.n) >= 85 * max(a.n, b.n):
                assert b.part in a.others and a.part in b.others
    assert sum(len(r.others) for r in of.values()) < len(of) * len(parts) / 3


@pytest.mark.parametrize(("paired", "cells"), [(1, 1), (3, 64), (1000, 1 << 26)])
def test_similar_sets_meet_whatever_the_limits(spark, monkeypatch, paired, cells):
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 500)
    monkeypatch.setattr(key_bits, "CELLS", cells)
    random.seed(paired)
    base = [[f"b{k}x{i}" for i in range(70)] for k in range(6)]
    rows = []
    for i in range(200):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = f"x{random.randrange(30)}"
        low = random.randrange(40)
        w = w[low:low + random.randint(1, 70)] if i % 2 else w[random.randint(0, 3):]
        rows.append((i, " ".join(w)))
    rows += [(300 + i, t) for i, (_, t) in enumerate(rows[::4])] + [(900, ""), (901, None), (902, "one")]
    docs = spark.createDataFrame(rows, ROW).repartition(5)
    assert found(jaccard_join.jaccard_classes(docs, 3, 80)) == jaccard_classes(rows, 3, 80)


@pytest.mark.parametrize("cells", [1, 1 << 10, 1 << 16, 1 << 26])
def test_bits_lose_no_key(spark, monkeypatch, cells):
    monkeypatch.setattr(key_bits, "CELLS", cells)
    rows = spark.range(2000).select(F.col("id").alias("a"), F.col("id").cast("string").alias("b"))
    bits = key_bits.key_bits(rows.where("a % 10 = 3"), ["a", "b"], "bits-test")
    inside = {r.a for r in key_bits.by_bits(rows, bits, ["a", "b"]).collect()}
    outside = {r.a for r in key_bits.by_bits(rows, bits, ["a", "b"], "left_anti").collect()}
    assert inside | outside == set(range(2000)) and not inside & outside
    assert inside >= set(range(3, 2000, 10))
    if cells >= 1 << 16:
        assert len(inside) < 220
