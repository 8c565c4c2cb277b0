"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.session import stage_table

MOST_ROUNDS = 60


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for each id with a link to another.

    ``links`` has columns a and b (bigint, not NULL), in any direction, repeats allowed. Each round lets every node
    link its larger neighbours to the smallest of all (large star), then its smaller neighbours to the smallest of
    them (small star); rounds are written, and end when nothing changes: about log n of them. Minima are combined
    before each shuffle; the neighbours of a node with very many meet in a join that adaptive execution can split,
    never in one list.
    """
    edges = stage_table(_ordered(links.select("a", "b")), f"{name}-0")
    last = None
    for i in range(1, MOST_ROUNDS):
        edges = stage_table(_small_star(_large_star(edges)), f"{name}-{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stage_table(ids.union(edges.select("b", "b")).distinct(), f"{name}-found")


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller end."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _ordered(edges.join(least, "a").select("b", "m").toDF("a", "b").union(
        least.select("a", F.col("m").alias("b"))))
