"""Merkle manifest, exact de-duplication and whitening against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward, sha
from pyspark.sql import functions as F

from threadloom.llm import exact_dedup, merkle_manifest, whitening


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def equal_groups(rows):
    """Multiset of (id, keep_id, group_size, kept, sha) of (id, text) rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for nth, i in enumerate(sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)):
            out[i, best, len(ids), nth == 0, sha(text)] += 1
    return out


def dedup_rows(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_dedup(docs, rows, none):
    got = exact_dedup.equal_groups(docs)
    assert dedup_rows(got) == equal_groups([r[:2] for r in rows])
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.equal_groups(none).count() == 0


def test_exact_dedup_of_hot_groups(spark):
    """A third of all rows are copies; others share long beginnings; ids are NULL, repeated, or all NULL in a group."""
    random.seed(3)
    rows = [(i, "copy " * 30) for i in range(400)] + [(None, "copy " * 30)] * 40 + [(7, "copy " * 30)] * 3
    rows += [(i, "the same beginning " * 10 + str(i % 90)) for i in range(1000, 1400)]
    rows += [(None, "nobody")] * 150 + [(399, "copy " * 30), (399, "copy")] + [(i, f"text {i}") for i in range(2000, 2300)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert dedup_rows(exact_dedup.equal_groups(df)) == equal_groups(rows)
    upper = exact_dedup.equal_groups(df, normalise=F.upper)
    assert dedup_rows(upper) == equal_groups([(i, t.upper()) for i, t in rows])


def test_exact_dedup_does_not_trust_checksums(spark, monkeypatch):
    """With equal checksums for all texts, and all of them hot, texts are still told apart."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64",
                        lambda *c: real(F.lit(1)) if c == ("text",) or c == ("head",) else real(*c))
    rows = [(i, "x" * 70 + "ab"[i % 2] + "c" * (i % 3)) for i in range(300)]
    assert dedup_rows(exact_dedup.equal_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == equal_groups(rows)


def merkle(rows, tampered):
    """Multiset of the manifest's rows, by lists of nodes."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def climb(level):
        """The top and, per leaf, its runs of (left, right)."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for leaf_, i in enumerate(at):
                run = level[i - i % 8:i - i % 8 + 8]
                paths[leaf_].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            level = [sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
            at = [i // 8 for i in at]
        return level[0] if level else None, paths

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((leaf(r, r[1]), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below = {x: sorted(trees[x], key=lambda lr: (lr[1][0] is not None, lr[1][0] or 0, lr[0])) for x in langs}
    tops = {x: climb([leaf_ for leaf_, _ in below[x]]) for x in langs}
    root, upper = climb([tops[x][0] for x in langs])
    out = Counter()
    for x, above in zip(langs, upper, strict=True):
        for (leaf_, r), path in zip(below[x], tops[x][1], strict=True):
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None and tampered(r) else r[1]
            node = leaf(r, text)
            for left, right in path + above:
                node = sha(left + node + right)
            out[r[0], leaf_, tops[x][0], root, sha("".join(a + b for a, b in path + above)), node, node == root] += 1
    return out


def third(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0


def check_merkle(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle_manifest.manifest(df, *merkle_manifest.lowered_thirds())
    assert Counter(map(tuple, got.collect())) == merkle(rows, third)
    return got


def test_merkle_manifest(spark, rows):
    got = check_merkle(spark, rows)
    assert got.where("not verified").count() > 0
    assert merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA)).where("not verified").count() == 0


@pytest.mark.parametrize("sizes", [(1,), (65,), (1, 8), (1, 9, 130), (1,) * 9 + (3,)])
def test_merkle_shapes(spark, sizes):
    """One lone row; runs of one; trees of unlike depth; more than eight languages."""
    rows = [(100 * k + i, f"Text {i}", (None, "ü", "z", "a")[k] if k < 4 else f"l{k}", "s", 5, 1, "x", None)
            for k, n in enumerate(sizes) for i in range(n)]
    check_merkle(spark, rows)


def test_merkle_of_nothing(none):
    assert merkle_manifest.manifest(none).count() == 0


def test_merkle_plan_has_no_rows_of_text(spark, rows):
    """Only digests are joined and shuffled: no exchange above the leaves reads the documents."""
    plan = merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "Cartesian" not in plan


def whitened(spark, vectors, most=32):
    """Spark's rows by id, checked for all that does not depend on the sign or basis; returns (n, V, values by id)."""
    df = spark.createDataFrame(vectors, "id long, vector array<float>, n long, component int").repartition(3)
    got = whitening.whiten(df.select("id", "vector", "n", "component"), most).collect()
    good = [(r[0], [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]]) for r in vectors
            if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    dims = Counter(len(x) for _, x in good).most_common(1)[0][0] if good else 0
    good = [(i, x) for i, x in good if len(x) == dims]
    n = len(good)
    sums = [sum(x[d] for _, x in good) for d in range(dims)]
    exact = [[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in good) for b in range(dims)] for a in range(dims)]
    matrix = np.array([[v / n ** 3 for v in row] for row in exact])
    deviation = {}
    for i, x in good:
        deviation.setdefault(i, []).append(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
    for r in got:
        assert r.n == n and r.deviation in deviation[r.id]
    return got, n, matrix, good, sums


def test_whitening(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    vectors = [(i, v.tolist(), 1, 2) for i, v in enumerate(base)]
    vectors += [(900, None, 1, 1), (901, [], 1, 1), (902, [1.0] * 11 + [None], 1, 1), (903, [float("nan")] * 12, 1, 1),
                (904, [float("inf")] * 12, 1, 1), (905, [1.0, 2.0], 1, 1), (906, [3e38] * 12, 1, 1),
                (None, base[0].tolist(), 1, 1)] + [(5, base[5].tolist(), 1, 2)] * 100
    usable = [v for v in vectors if v[0] != 906]
    got, n, matrix, good, sums = whitened(spark, usable, 10)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes.T[::-1]
    assert len(got) == n * 10 and n == 401
    want = {i: (np.array([float(a) - s / n for a, s in zip(x, sums, strict=True)]) @ axes.T) / np.sqrt(values) for i, x in good}
    for r in got:
        assert abs(r.whitened) == pytest.approx(abs(want[r.id][r.component - 1]), abs=1e-8)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    again = whitening.whiten(spark.createDataFrame(vectors, "id long, vector array<float>, n long, component int"), 10).collect()
    assert sorted(map(str, again)) == pytest.approx(sorted(map(str, again)))
    assert {r.id for r in again} == {r.id for r in got}  # an immense entry is left out too


@pytest.mark.parametrize("case", ["none", "one", "equal", "dependent"])
def test_whitening_without_variance(spark, case):
    vectors = {"none": [(1, None, 1, 1)], "one": [(1, [1.0, 2.0], 1, 1)], "equal": [(i, [1.0, 2.0], 1, 1) for i in range(9)],
               "dependent": [(i, [float(i), 2.0 * i, 5.0], 1, 1) for i in range(9)]}[case]
    got = whitening.whiten(spark.createDataFrame(vectors, "id long, vector array<float>, n long, component int")).collect()
    assert len(got) == (9 if case == "dependent" else 0)
    assert all(r.component == 1 and r.identity_error < 1e-9 and r.explained == pytest.approx(1) for r in got)


def test_whitening_sums_are_exact():
    rng = np.random.default_rng(1)
    big = rng.integers(-2 ** 46, 2 ** 46, (50, 3))
    assert whitening._squares(big) == [sum(int(v) ** 2 for v in big[:, j]) for j in range(3)]
    assert whitening.exact_sum(big * 2 ** 16) == [sum(int(v) for v in big[:, j] * 2 ** 16) for j in range(3)]
    fitted = whitening.Fit(10 ** 8, np.array([5, 7, 11], object), np.ones(1), np.ones((1, 3)), np.ones(1))
    assert whitening._centred(fitted, big)[0, 0] == 10 ** 8 * int(big[0, 0]) - 5
