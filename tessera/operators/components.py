"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import HEAVY_ROWS, join_unique, materialise_seen


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    out, seen = materialise_seen(edges, n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("a", "b")))
    return out, (seen["n"], seen["x"])


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """One round over edges (a, b): every node's neighbours are hung below the smallest of them.

    The minimum is combined before the shuffle and joined back; where there are ``many`` edges, nodes with
    very many neighbours are joined by a broadcast of their minima, so their edges stay where they are.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    hung = join_unique(near, least.drop("n"), "a", least.filter(F.col("n") > HEAVY_ROWS)) if many else near.join(least.drop("n"), "a")
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of the links (a, b) of any ordered type.

    Self-links and repeated links are ignored; an empty table gives an empty result. Each round is
    written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    Raises if ``max_rounds`` don't suffice, rather than return an unfinished result.
    """
    edges, state = _written(edges.select("a", "b").filter("a <> b").distinct())
    for _ in range(max_rounds):
        if not state[0]:
            break
        many = state[0] > HEAVY_ROWS
        before = state
        edges, state = _written(_star(_star(edges, True, many), False, many))
        if before == state:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
