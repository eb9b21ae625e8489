"""Near copies of image files: difference hashes of the decoded pixels, Hamming search, classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import HEAVY_ROWS, broadcast_if_small, join_unique, materialise, spread
from tessera.operators.components import components
from tessera.operators.pairs import joined, near_hashes

#: Rows and columns of the grid of a hash, whose cells are compared with the cell on their left.
ROWS, COLUMNS = 8, 9
BITS = ROWS * (COLUMNS - 1)
#: Hashes that are compared in one task.
BLOCK = 1 << 15
#: Comparisons that take as long as to move a row to its bucket, and as to call the comparison of a bucket.
MOVE, CALL = 500, 200_000


def _shares(cells: int, pixels: int) -> np.ndarray:
    """cells x pixels: how much of a pixel lies in a cell, in units of 1 / (cells * pixels) of the side."""
    edge, side = np.arange(cells + 1) * pixels, np.arange(pixels + 1) * cells
    return np.maximum(0, np.minimum(edge[1:, None], side[None, 1:]) - np.maximum(edge[:-1, None], side[None, :-1]))


def difference_hash(grey: np.ndarray) -> int:
    """64 bits, row by row: whether a cell of the 8 x 9 grid is brighter than the cell on its left.

    Cells are sums over exact areas in whole numbers, so a scaled or uniformly brighter copy has the same hash.
    """
    cells = _shares(ROWS, grey.shape[0]) @ grey.astype(np.int64) @ _shares(COLUMNS, grey.shape[1]).T
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def perceptual_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path, hash of every image below ``folder`` that decodes; grey values are rounded to whole numbers first."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    rows = rows.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").filter("height > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                x = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                grey = x[:, :, :3] @ np.array([0.114, 0.587, 0.299]) if r.nChannels >= 3 else x[:, :, 0]
                out.append((r.origin, difference_hash(np.rint(grey))))
            yield pd.DataFrame(out, columns=["path", "hash"])

    return rows.mapInPandas(run, "path string, hash long")


def _dealt(m: int, radius: int) -> list[tuple[int, int, int]]:
    """``m`` tables (first bit, bits, radius); their radii plus one add up to one more than ``radius``."""
    edges = [BITS * k // m for k in range(m + 1)]
    whole, rest = divmod(radius + 1, m)
    return [(a, b - a, whole - 1 + (k < rest)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _cost(plan: list[tuple[int, int, int]], n: int) -> float:
    """Comparisons that the search of ``n`` evenly spread hashes takes, moves of rows and calls for buckets converted into them."""
    keys = [sum(math.comb(bits, r) for r in range(radius + 1)) for _, bits, radius in plan]
    buckets = [2.0**bits for _, bits, _ in plan]
    return sum(n * k * (MOVE + n / size) + min(size, n * k) * CALL for k, size in zip(keys, buckets, strict=True))


def tables(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each table: two hashes within ``radius`` are within the table's on one of them.

    Many tables with few bits have large buckets, few with many bits must look for more variants of each hash; the number
    is that which costs least for ``n`` hashes. The radius is dealt out so that the tables' radii plus one add up to one more than it.
    """
    return min((_dealt(m, radius) for m in range(1, min(radius + 1, BITS) + 1)), key=lambda plan: _cost(plan, n))


def _keys(plan: list[tuple[int, int, int]]):
    """k, t, bucket, own: for each table the hash's own bits, and all that differ from them in as many bits as the table's radius says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch["k"].to_numpy().astype(np.uint64)
            for t, (first, bits, radius) in enumerate(plan):
                own = (x >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                for n in range(radius + 1):
                    for flipped in combinations(range(bits), n):
                        yield pd.DataFrame({"k": batch["k"], "t": t, "bucket": (own ^ np.uint64(sum(1 << b for b in flipped))).astype(np.int64), "own": n == 0})

    return run


def _joined(radius: int):
    """Links (a, b) that join the hashes (k) whose own bits a bucket stands for, and the others that look for them there, into classes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group["own"].to_numpy()
        here, there = group["k"].to_numpy()[own], group["k"].to_numpy()[~own]
        x, y = here.astype(np.uint64), there.astype(np.uint64)
        links = [joined(here, None, near_hashes(x, x, radius)), joined(here, there, near_hashes(x, y, radius))]
        return pd.DataFrame({"a": np.concatenate([a for a, _ in links]), "b": np.concatenate([b for _, b in links])})

    return run


def _links(hashes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of distinct hashes (k) within ``radius``: a spanning forest of each bucket, large ones block by block."""
    keyed = hashes.select("k").mapInPandas(_keys(tables(hashes.count(), radius)), "k long, t int, bucket long, own boolean")
    hot = materialise(keyed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK))
    n_hot = hot.count()
    link = _joined(radius)
    if not n_hot:
        return spread(keyed, "t", "bucket").groupBy("t", "bucket").applyInPandas(link, "a long, b long")
    hint = broadcast_if_small(hot, n_hot, 100_000)
    few = spread(keyed.join(hint, ["t", "bucket"], "left_anti"), "t", "bucket").groupBy("t", "bucket").applyInPandas(link, "a long, b long")
    parts = F.ceil(2 * F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("k"), parts).cast("int")
    dense = keyed.join(hint, ["t", "bucket"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dense = dense.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    group = ["t", "bucket", "i", "j"]
    return few.unionByName(spread(dense, *group).groupBy(*group).applyInPandas(link, "a long, b long"))


def near_images(hashes: DataFrame, radius: int = 6, key: str = "path", hash_col: str = "hash") -> DataFrame:
    """``key``, class_id, copies for every row: the smallest key reachable over hashes that differ in ``radius`` bits or fewer.

    Equal hashes are one node that stands for ``copies`` rows. Every link is found: each table's part of the bits may
    differ in its share of the radius. A null hash (a file that didn't decode) is a class of its own. An empty
    table gives an empty result.
    """
    rows = materialise(hashes.select(F.col(key).alias("key"), F.col(hash_col).alias("k")))
    nodes = materialise(rows.filter("k IS NOT NULL").groupBy("k").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = components(_links(nodes, radius))
    owners = materialise(nodes.join(roots, F.col("k") == F.col("node"), "left").select("k", "least", "copies", F.coalesce("root", "k").alias("root")))
    named = owners.join(owners.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("k", "class_id", "copies")
    named = materialise(named)
    known = join_unique(rows, named, "k", named.filter(F.col("copies") > HEAVY_ROWS)).select("key", "class_id", "copies")
    alone = rows.filter("k IS NULL").select("key", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return known.unionByName(alone).withColumnRenamed("key", key)
