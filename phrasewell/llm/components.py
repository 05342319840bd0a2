"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phrasewell.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for all nodes of ``edges`` (columns a and b, long, without nulls).

    The component is its smallest node; the smallest node itself gets no row. Each round shuffles
    the edges by node with minima summed up before the shuffle, so a hub costs no more than its
    edges, and stores them in the shared folder. Rounds grow with the logarithm of the nodes.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = stored(now, "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
