"""Whitening of embeddings. Covariances by polarisation: variances of dimensions and of sums of two, nothing else.

var(a + b) = var(a) + var(b) + 2 cov(a, b), so exact squares of single dimensions and of pair sums give every
cross-covariance as a difference. Vectors become integers first, so all sums are exact and independent of the layout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.registry import query
from threadloom.session import ship_package, stage_table

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40  # of an entry, in absolute value: beyond it floor(SCALE * c) + SHIFT is not sure to be a long
COMPONENTS = 32
SLICE_VALUES = 1 << 21  # numbers in one intermediate array
EXACT = 1 << 62


@dataclass
class Fit:
    """n vectors with ``sums`` per dimension; rows of ``axes`` are unit components, ``values`` their eigenvalues."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray


def usable(vector: Column) -> Column:
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    return F.coalesce(~bad, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")) + SHIFT)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch], values_a_row: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(SLICE_VALUES // max(values_a_row, 1), 1)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, _matrix(part.column("x"))


def exact_sum(values: np.ndarray) -> list[int]:
    """Sums over the first axis, exact for longs of any size: high and low halves are added apart."""
    low = (values & 0xFFFFFFFF).sum(axis=0)
    high = (values >> 32).sum(axis=0)
    return [(int(h) << 32) + int(lo) for h, lo in zip(high.ravel(), low.ravel(), strict=True)]


def _squares(values: np.ndarray) -> list[int]:
    """Sums of squares over the first axis, exact."""
    most = int(np.abs(values).max(initial=0))
    if most * most * max(len(values), 1) < EXACT:
        return [int(v) for v in (values * values).sum(axis=0).ravel()]
    wide = values.astype(object)
    return [int(v) for v in (wide * wide).sum(axis=0).ravel()]


def _add_up(numbers: DataFrame) -> dict[int, int]:
    """Exact totals of (slot, amount as text). Amounts are cut into 18-digit limbs: a sum of decimals can't overflow."""
    limbs = numbers.select("slot", F.explode("limbs").alias("limb")).groupBy("slot", "limb.at").agg(
        F.sum(F.col("limb.amount").cast("decimal(38,0)")).alias("amount"))
    totals: dict[int, int] = {}
    for r in limbs.collect():
        totals[r.slot] = totals.get(r.slot, 0) + int(r.amount) * 10 ** (18 * r["at"])
    return totals


SLOTS = "slot int, limbs array<struct<at:int, amount:long>>"


def _slot_batch(totals: dict[int, int]) -> pa.RecordBatch:
    def limbs(v: int) -> list[dict]:
        sign, v, out = (-1 if v < 0 else 1), abs(v), []
        while v or not out:
            out.append({"at": len(out), "amount": sign * (v % 10 ** 18)})
            v //= 10 ** 18
        return out

    kind = pa.list_(pa.struct([("at", pa.int32()), ("amount", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([limbs(v) for v in totals.values()], kind)],
                                      ["slot", "limbs"])


def _added(totals: dict[int, int], first: int, amounts: list[int]) -> None:
    for slot, amount in enumerate(amounts, first):
        totals[slot] = totals.get(slot, 0) + amount


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """Components of the covariance (divisor n) of integer vectors ``x`` of one length; None without vectors.

    First the sums, then, around the nearest whole means, the squares of each dimension and of each sum of two. A
    task sends one row per dimension and pair, whatever it reads; the driver gets dims * (dims + 3) / 2 totals. The
    rest of the centring, by less than 1, is done in whole numbers on the totals.
    """
    ship_package(vectors.sparkSession)

    def sums(batches):
        totals: dict[int, int] = {}
        for batch, x in _slices(batches, 64):
            _added(totals, 0, [batch.num_rows, *exact_sum(x)])
        yield _slot_batch(totals)

    found = _add_up(vectors.select("x").mapInArrow(sums, SLOTS))
    if not found.get(0):
        return None
    n, total = found[0], [found[i] for i in range(1, len(found))]
    dims = len(total)
    centre = [(2 * s + n) // (2 * n) for s in total]
    left, right = np.triu_indices(dims, 1)

    def squares(batches):
        totals: dict[int, int] = {}
        for _, x in _slices(batches, dims * dims):
            y = x - np.array(centre, np.int64)
            _added(totals, 0, _squares(y))
            at = dims
            for i in range(dims - 1):  # dimension i with all after it
                _added(totals, at, _squares(y[:, i + 1:] + y[:, i:i + 1]))
                at += dims - 1 - i
        yield _slot_batch(totals)

    amounts = _add_up(vectors.select("x").mapInArrow(squares, SLOTS))
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]  # sums of what was squared

    def variance(square: int, sum_: int) -> Fraction:
        return Fraction(n * square - sum_ * sum_, n * n)

    single = [variance(amounts[i], rest[i]) for i in range(dims)]
    matrix = np.diag([float(v) for v in single])
    for slot, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True), dims):
        both = variance(amounts[slot], rest[i] + rest[j])
        matrix[i, j] = matrix[j, i] = float((both - single[i] - single[j]) / 2)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes.T[::-1]
    trace = float(sum(single))
    keep = values > max(trace, 0.0) * dims * np.finfo(float).eps
    values, axes = values[keep][:most], axes[keep][:most]
    largest = np.abs(axes).argmax(axis=1)
    axes = axes * np.sign(axes[np.arange(len(axes)), largest])[:, None]
    return Fit(n, np.array(total, object), values, np.ascontiguousarray(axes), values / trace if trace else values)


def _centred(fitted: Fit, x: np.ndarray) -> np.ndarray:
    """n * x - S, exact: longs where they fit, else Python's numbers."""
    centre = (2 * fitted.sums + fitted.n) // (2 * fitted.n)
    y, rest = x - centre.astype(np.int64), fitted.sums - fitted.n * centre
    most = (int(np.abs(y).max(initial=0)) + 1) * fitted.n
    if most * most * max(x.shape[1], 1) < EXACT:
        return fitted.n * y - rest.astype(np.int64)
    return fitted.n * y.astype(object) - rest


def _scores(fitted: Fit, centred: np.ndarray) -> np.ndarray:
    return (centred / fitted.n).astype(float) @ fitted.axes.T / np.sqrt(fitted.values)


def identity_error(vectors: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, measured over all of them, minus identity."""
    k = len(fitted.values)

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _slices(batches, 64):
            w = _scores(fitted, _centred(fitted, x))
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([first.tolist()]), pa.array([second.ravel().tolist()])], ["first", "second"])

    parts = vectors.select("x").mapInArrow(moments, "first array<double>, second array<double>")

    def totals(name: str, size: int) -> np.ndarray:
        summed = parts.select(F.posexplode(name)).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        out = np.zeros(size)
        for r in summed:
            out[r.pos] = r.v
        return out / fitted.n

    parts = stage_table(parts, "whitening-moments")
    mean = totals("first", k)
    cov = totals("second", k * k).reshape(k, k) - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max(initial=0.0))


WHITENED = ("id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row per vector of ``rows`` (id, vector) and component, up to ``most`` components.

    A vector is left out if it is NULL or empty, or has a NULL, NaN, infinite or immense (over 2 ** 40) entry, or not
    the length of most of the others (of equally frequent lengths, the larger). NULL ids and repeated rows are rows
    like others. Components are numbered from 1 by falling eigenvalue, the largest entry of each positive; those
    without variance (constant or dependent dimensions, a single vector) can't be whitened and give no rows.
    ``deviation`` is NULL where it exceeds a long. An empty table gives no rows.
    """
    good = rows.where(usable(F.col("vector")) & (F.size("vector") > 0)).select("id", integers(F.col("vector")).alias("x"))
    good = stage_table(good, "whitening-integers")
    length = good.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    good = good.where(F.size("x") == (length.dims if length else 0))
    fitted = fit(good, most)
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], WHITENED)
    error, k = identity_error(good, fitted), len(fitted.values)

    def transform(batches):
        for batch, x in _slices(batches, 64):
            centred, m = _centred(fitted, x), batch.num_rows
            deviation = (centred * centred).sum(axis=1)
            if deviation.dtype == object:
                deviation = [int(v) if v < 1 << 63 else None for v in deviation]
            ids = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(ids), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, fitted.n)), pa.array(deviation, pa.int64()).take(ids),
                pa.array(_scores(fitted, centred).ravel()), pa.array(np.tile(fitted.explained, m)),
                pa.array(np.full(m * k, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(transform, WHITENED)


@query("op13_whitening")
def whitening(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).withColumnRenamed("id", "vec_id")
