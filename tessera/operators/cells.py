"""Near copies of vectors under a loose bound: cells around k-means centres, several of which each vector visits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.functions.shared import HEAVY_ROWS, broadcast_if_small, join_unique, materialise, spread
from tessera.operators.components import components
from tessera.operators.vectors import class_of_block, element_kind, links_of_sides, packed, unpacked

#: Vectors that the centres and the number of visits are fitted on, at most, and those of them that search the others.
SAMPLE, SEARCHED = 20_000, 2_000
#: Vectors that a cell should have, and most cells: beyond that cells grow instead, so that a vector visits no more of them, since to move it
#: takes longer than to compare it with thousands. Cells are compared in blocks of BLOCK.
CELL, MOST_CELLS, BLOCK = 256, 128, 1 << 16
#: Pairs over the bound that tell how many visits are needed; where the sample has fewer, its closest pairs do.
LEAST_PAIRS = 200


@dataclass(frozen=True)
class Cells:
    """Unit centres; how many of them, nearest first, a vector visits; the share of the sample's pairs that meet so."""

    centres: np.ndarray
    visits: int
    recall: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centres(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(42)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=cells) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = _unit(sums)
    return centres


def fit_cells(sample: np.ndarray, n: int, least_cosine: float, recall: float) -> Cells:
    """Centres for ``n`` vectors, and the fewest visits with which ``recall`` of the sample's pairs over the bound meet.

    A pair meets where one visits the other's own cell. Where fewer than LEAST_PAIRS pairs of the sample are over the bound, the
    closest ones stand for them, which are no easier to find.
    """
    x = _unit(sample)
    cells = max(1, min(MOST_CELLS, len(x), round(n / CELL)))
    centres = _centres(x, cells)
    searching = x[: min(SEARCHED, len(x))]
    cosine = searching @ x.T
    cosine[np.arange(len(searching)), np.arange(len(searching))] = -2
    over = np.flatnonzero(cosine.ravel() >= least_cosine)
    if len(over) < LEAST_PAIRS:
        over = np.argsort(cosine.ravel())[-min(LEAST_PAIRS, cosine.size) :]
    elif len(over) > 50 * LEAST_PAIRS:
        over = np.random.default_rng(1).choice(over, 50 * LEAST_PAIRS, replace=False)
    a, b = np.divmod(over, len(x))
    like = x @ centres.T
    own = np.argmax(like, axis=1)
    # How many cells are nearer to one than the other's own.
    rank = lambda i, j: (like[i] > like[i, own[j]][:, None]).sum(1)
    needed = np.minimum(rank(a, b), rank(b, a)) + 1
    visits = int(np.sort(needed)[max(0, int(np.ceil(len(needed) * recall)) - 1)]) if len(needed) else 1
    return Cells(centres, visits, float((needed <= visits).mean()) if len(needed) else 1.0)


def _owned(cells: Cells, kind: str):
    """k, v, cell: each vector in the cell of the nearest centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                like = _unit(unpacked(batch["v"], kind).astype(np.float64)) @ cells.centres.T
                yield batch.assign(cell=np.argmax(like, axis=1).astype(np.int32))

    return run


def _visits(cells: Cells, kind: str):
    """v, label, cell, own: each vector in the cells that it visits; ``own`` in the nearest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                like = _unit(unpacked(batch["v"], kind).astype(np.float64)) @ cells.centres.T
                near = np.argpartition(-like, cells.visits - 1, axis=1)[:, : cells.visits]
                for v in range(cells.visits):
                    yield pd.DataFrame({"v": batch["v"], "label": batch["label"], "cell": near[:, v].astype(np.int32), "own": near[:, v] == batch["cell"]})

    return run


def cell_links(vectors: DataFrame, cells: Cells, least_cosine: float, kind: str) -> DataFrame:
    """Links (a, b) of the vectors (k, v): the members of a cell become classes first, then its visitors are compared with those of other classes.

    A cell with more than BLOCK members or visitors is compared block by block, each in a task of its own.
    """
    key = vectors.schema["k"].dataType.simpleString()
    owned = materialise(vectors.mapInPandas(_owned(cells, kind), f"k {key}, v binary, cell int"))
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int")
    member_blocks = materialise(owned.groupBy("cell").agg(blocks.alias("_m")))
    small = broadcast_if_small(member_blocks, len(cells.centres), MOST_CELLS)
    block = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    dealt = spread(owned.join(small, "cell").select("k", "v", "cell", block("_m").alias("i")), "cell", "i")
    rows = materialise(dealt.groupBy("cell", "i").applyInPandas(class_of_block(least_cosine, kind), f"k {key}, v binary, cell int, i int, label {key}"))
    inside = rows.select(F.col("k").alias("a"), F.col("label").alias("b"))
    # Visitors of their own cell have met its members already, unless it has other blocks.
    visitors = rows.select("v", "label", "cell").mapInPandas(_visits(cells, kind), f"v binary, label {key}, cell int, own boolean")
    visitors = visitors.join(small, "cell").filter("NOT own OR _m > 1")
    visitor_blocks = materialise(visitors.groupBy("cell").agg(blocks.alias("_v")))
    counts = broadcast_if_small(visitor_blocks, len(cells.centres), MOST_CELLS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.join(counts, "cell").select("v", "label", "cell", F.lit(True).alias("first"), "i", every("_v").alias("j"))
    visiting = visitors.join(counts, "cell").select("v", "label", "cell", F.lit(False).alias("first"), every("_m").alias("i"), block("_v").alias("j"))
    met = spread(members.unionByName(visiting), "cell", "i", "j").groupBy("cell", "i", "j")
    return inside.unionByName(met.applyInPandas(links_of_sides(least_cosine, kind), f"a {key}, b {key}"))


def near_copies_by_cells(df: DataFrame, key: str, features: str, least_cosine: float, recall: float = 0.97) -> DataFrame:
    """``key``, class_id, copies for every row: the smallest key reachable over pairs of at least ``least_cosine``.

    All rows are indexed; centres and visits are fitted on SAMPLE vectors at most. A cell has about CELL members up to
    CELL * MOST_CELLS vectors; from there on cells grow with the table, and what is moved, one row a visit, grows no faster than it.
    Members of a cell become classes first, so that visitors are compared only with members of other classes; every pair that meets is compared exactly. ``recall`` of the sample's pairs meet; classes join through more than one pair, so fewer are missed. Equal
    vectors are one node, null ones and those with a null or NaN are alone, an empty table gives an empty result. Keys are unique.
    """
    rows = materialise(df.select(F.col(key).alias("k"), F.col(features).cast("array<double>").alias("x")))
    usable = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    vectors = materialise(rows.filter(usable).groupBy("x").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies")))
    alone = rows.filter(~F.coalesce(usable, F.lit(False))).select("k", F.col("k").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    n = vectors.count()
    if not n:
        return alone.withColumnRenamed("k", key)
    # The lowest hashes, a few more than wanted, of which the first count: the same sample whatever the partitions.
    likely = vectors.filter(uniform(42, "k") < min(1.0, 1.2 * SAMPLE / n + 1e-3)).select("k", "x").orderBy(uniform(42, "k"), "k").limit(SAMPLE).toPandas()
    if not len(likely):
        likely = vectors.select("k", "x").limit(1).toPandas()
    cells = fit_cells(np.stack(likely["x"].to_numpy()), n, least_cosine, recall)
    kind = element_kind(df, features)
    roots = components(cell_links(packed(vectors, kind), cells, least_cosine, kind))
    owners = materialise(vectors.join(roots, F.col("k") == F.col("node"), "left").select("x", "copies", F.coalesce("root", "k").alias("class_id")))
    known = join_unique(rows, owners, "x", owners.filter(F.col("copies") > HEAVY_ROWS)).select("k", "class_id", "copies")
    return known.unionByName(alone).withColumnRenamed("k", key)
