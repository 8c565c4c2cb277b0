"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.registry import query
from threadloom.session import ship_package, stage_table

SEGMENT_BITS = 16
BLOCK_CODES, BLOCK_QUERIES = 1 << 18, 512  # distinct codes of the index and of the queries in one task


def sign_code(vector: Column) -> Column:
    """A '1' per positive element and a '0' per other one; NULL for a NULL or empty vector or a missing element."""
    bad = vector.isNull() | (F.size(vector) == 0) | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.when(~bad, F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), ""))


@cache
def masks(radius: int) -> np.ndarray:
    """All 16-bit numbers with ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT_BITS), radius)], np.uint16)


class SegmentIndex:
    """Codes as rows of 16-bit segments; per segment, the rows in the order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.segments = codes.shape[1]
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(self.segments)]
        self.starts = [np.searchsorted(codes[r, j], np.arange((1 << SEGMENT_BITS) + 1))
                       for j, r in enumerate(self.rows)]

    def _bucket_rows(self, j: int, values: np.ndarray) -> np.ndarray:
        low, high = self.starts[j][values], self.starts[j][values.astype(np.int64) + 1]
        full = high > low
        low, n = low[full], (high - low)[full]
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return self.rows[j][at]

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes up to the distance of the k-th, which may be more than k.

        The search radius of one segment after the other grows by 1. When the first j of m segments have radius r and
        the others r - 1, a code that was not met differs by more in each: at least m * r + j bits. So all codes
        below that distance are known, and the search ends when k of them are.
        """
        seen = np.zeros(len(self.codes), bool)
        rows, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(SEGMENT_BITS + 1):
            for j in range(self.segments):
                met = self._bucket_rows(j, masks(radius) ^ code[j])
                met = met[~seen[met]]
                seen[met] = True
                rows = np.append(rows, met)
                distances = np.append(distances, np.bitwise_count(self.codes[met] ^ code).sum(axis=1, dtype=np.int64))
                sure = self.segments * radius + j + 1  # any code below this distance has been met
                if (distances < sure).sum() >= k:
                    keep = distances <= np.partition(distances, k - 1)[k - 1]
                    return rows[keep], distances[keep]
        return rows, distances


def _packed(codes: list[str]) -> np.ndarray:
    """Bit strings of one length as rows of 16-bit numbers, padded with zeros."""
    bits = np.array([np.frombuffer(c.encode(), np.uint8) - 48 for c in codes], np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SEGMENT_BITS)))
    return np.packbits(bits, axis=1).view(np.uint16)


def _search_block(table: pa.Table, most: int) -> pa.Table:
    """One task: some query codes against some codes; per query code the nearest by distance, then smallest id."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    codes = np.array(table.column("code").to_pylist(), object)
    least = table.column("least").to_numpy(zero_copy_only=False)[~asks]
    queries, held = codes[asks], codes[~asks]
    out_query, out_code, out_distance = [], [], []
    if len(queries) and len(held):
        index = SegmentIndex(_packed(list(held)))
        for name, code in zip(queries, _packed(list(queries)), strict=True):
            rows, distances = index.search(code, most)
            best = np.lexsort((least[rows], distances))[:most]
            out_query += [name] * len(best)
            out_code += held[rows[best]].tolist()
            out_distance += distances[best].tolist()
    return pa.table({"query_code": pa.array(out_query, pa.string()), "code": pa.array(out_code, pa.string()),
                     "distance": pa.array(out_distance, pa.int32())})


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest ``rows`` of each of ``queries`` (id, code): query_id, rank, id, distance. Exact.

    Nearness is Hamming distance, then id; the row with a query's own id is left out. Equal codes are searched once,
    as one code with its k + 1 smallest ids, so a vector with a third of all rows is one code. The distinct codes are
    dealt out in blocks of about ``BLOCK_CODES``, the distinct query codes in blocks of about ``BLOCK_QUERIES``; each pair of
    blocks is a task that indexes its codes and returns, per query code, the k + 1 that come first by distance and
    smallest id: the k nearest rows, and the query's own, are among theirs.

    NULL codes are neither found nor ask; only codes of one length are compared; repeated rows are taken once per id;
    fewer than k others give fewer results; empty tables give none.
    """
    ship_package(rows.sparkSession)
    of_code = Window.partitionBy("code").orderBy("id")
    members = stage_table(rows.where("code is not null and id is not null").distinct().withColumn(
        "nth", F.row_number().over(of_code)).where(F.col("nth") <= k + 1), "hamming-members")
    held = members.where("nth = 1").select("code", F.col("id").alias("least"))
    asked = queries.where("code is not null and id is not null").distinct()
    asking = stage_table(asked.select("code").distinct(), "hamming-queries")
    sizes = held.agg(F.greatest(F.ceil(F.count("*") / BLOCK_CODES), F.lit(1)).cast("int").alias("blocks")).join(
        asking.agg(F.greatest(F.ceil(F.count("*") / BLOCK_QUERIES), F.lit(1)).cast("int").alias("parts"))).first()
    blocks, parts = sizes.blocks, sizes.parts

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    mixed = F.xxhash64("code")
    left = held.select("code", "least", F.lit(False).alias("asks"), F.pmod(mixed, F.lit(blocks)).cast("int").alias("block"),
                       numbers(parts).alias("part"))
    right = asking.select("code", F.lit(None).cast("long").alias("least"), F.lit(True).alias("asks"), numbers(blocks).alias("block"),
                          F.pmod(mixed, F.lit(parts)).cast("int").alias("part"))
    near = left.unionByName(right).withColumn("bits", F.length("code")).groupBy("bits", "block", "part").applyInArrow(
        lambda table: _search_block(table, k + 1), "query_code string, code string, distance int")
    rows_found = near.join(members.select("code", "id"), "code")
    of_code = F.row_number().over(Window.partitionBy("query_code").orderBy("distance", "id"))
    first = rows_found.withColumn("nth", of_code).where(F.col("nth") <= k + 1)
    found = first.join(asked.select(F.col("id").alias("query_id"), F.col("code").alias("query_code")),
                       "query_code").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


NEAREST_SQL = """
WITH codes AS (
  SELECT vec_id, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS code
  FROM embeddings),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, hamming(q.code, c.code)::INT AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.code, c.code), c.vec_id) AS rank
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, id, distance FROM ranked WHERE rank <= 10
"""


@query("op7_hamming_search", NEAREST_SQL)
def hamming_search(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return nearest(rows, rows.where("id % 20 = 0"), 10)
