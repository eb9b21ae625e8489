"""Linear probes on stored feature vectors, their calibration, batch scoring and near copies of vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import HEAVY_ROWS, broadcast_if_small, join_unique, materialise, spread
from tessera.operators.components import components
from tessera.operators.pairs import classes, joined, near_vectors

#: Vectors that are worth a block of their own, those that are compared in one task, and most planes of a table.
BUCKET, BLOCK, MOST_BITS = 256, 1 << 16, 48
#: Blocks of an exact comparison, at least; comparisons that take as long as to move a vector to a task; vectors that are always compared exactly.
PARTS, MOVE, ALWAYS = 16, 5000, 100_000


def fit_probe(df: DataFrame, features: str, label: str = "label", c: float = 1.0, steps: int = 200) -> PipelineModel:
    """Standardise, then a balanced ridge logistic curve; ``c`` weighs the loss against half the squared norm."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.lit(0.0)
    for value, k in counts.items():
        weight = F.when(F.col(label) == value, n / (len(counts) * k)).otherwise(weight)
    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("_raw"), F.col(label).cast("double").alias("_y"), weight.alias("_w"))
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(rows)
    curve = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=steps, tol=1e-10, probabilityCol="_p", predictionCol="_pred", rawPredictionCol="_z")
    return PipelineModel([scaler, curve.fit(scaler.transform(rows))])


def probe_scores(model: PipelineModel, df: DataFrame, features: str) -> DataFrame:
    """``df`` with prob (of class 1) and pred."""
    rows = df.withColumn("_raw", array_to_vector(F.col(features).cast("array<double>")))
    out = model.transform(rows).withColumn("prob", vector_to_array("_p")[1]).withColumn("pred", F.col("_pred").cast("int"))
    return out.drop("_raw", "_x", "_z", "_p", "_pred")


def temperature(df: DataFrame, score: str, label: str = "label", grid: tuple[float, ...] = tuple(i / 20 for i in range(4, 101)), cells: int = 2000) -> DataFrame:
    """temperature, nll: the grid value of least negative log likelihood of scores whose logits are divided by it.

    Scores are counted in logit cells first, so the grid meets at most 2 x ``cells`` rows.
    """
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    cell = F.round(F.log(p / (1 - p)) * (cells / 28.0)).cast("int")
    counts = df.groupBy(cell.alias("cell"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    values = F.explode(F.array(*(F.lit(float(t)) for t in grid))).alias("temperature")
    z = F.col("cell") * (28.0 / cells) / F.col("temperature") * F.when(F.col("y") == 1, 1.0).otherwise(-1.0)
    loss = F.sum(F.col("n") * F.log1p(F.exp(-z))) / F.sum("n")
    each = counts.select("cell", "y", "n", values).groupBy("temperature").agg(loss.alias("nll"))
    return each.orderBy("nll", "temperature").limit(1)


def score_batches(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], key: str, features: str) -> DataFrame:
    """key, prob: a user's batch function (n x d array to n scores), called on each Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "prob": np.asarray(predict(np.stack(batch["x"].to_numpy())), dtype=float)})

    rows = df.select(key, F.col(features).cast("array<double>").alias("x")).filter("x IS NOT NULL")
    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, prob double")


def packed(vectors: DataFrame, kind: str) -> DataFrame:
    """k, v: the vectors (k, x) as bytes, single floats where they came as such."""
    width = "<f4" if kind == "float" else "<f8"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "v": [np.asarray(x).astype(width).tobytes() for x in batch["x"]]})

    return vectors.select("k", "x").mapInPandas(run, f"k {vectors.schema['k'].dataType.simpleString()}, v binary")


def unpacked(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4" if kind == "float" else "<f8").reshape(len(column), -1)


def element_kind(df: DataFrame, features: str) -> str:
    return df.schema[features].dataType.elementType.simpleString()


def _sign_keys(bits: int, tables: int, seed: int, kind: str):
    """k, v, t, bucket for each vector and table: the sides of ``bits`` random planes on which it lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            x = unpacked(batch["v"], kind).astype(np.float64)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
            sides = (x @ planes > 0).reshape(len(x), tables, bits)
            buckets = sides.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
            for t in range(tables):
                yield pd.DataFrame({"k": batch["k"], "v": batch["v"], "t": t, "bucket": buckets[:, t]})

    return run


def _joined(least_cosine: float, kind: str):
    """Links (a, b) that join the vectors of a bucket into classes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = unpacked(group["v"], kind)
        a, b = joined(group["k"].to_numpy(), None, near_vectors(x, x, least_cosine))
        return pd.DataFrame({"a": a, "b": b})

    return run


def class_of_block(least_cosine: float, kind: str):
    """The rows of a block, with the smallest key that each reaches inside it as ``label``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = unpacked(group["v"], kind)
        return group.assign(label=classes(group["k"].to_numpy(), near_vectors(x, x, least_cosine)))

    return run


def links_of_sides(least_cosine: float, kind: str):
    """Links (a, b) that join the classes (label) of the rows of two sides (``first``: whether of the first)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, label, first = unpacked(group["v"], kind), group["label"].to_numpy(), group["first"].to_numpy()
        a, b = joined(label[first], label[~first], near_vectors(x[first], x[~first], least_cosine))
        return pd.DataFrame({"a": a, "b": b})

    return run


def _all_links(vectors: DataFrame, n: int, least_cosine: float, kind: str) -> DataFrame:
    """Links (a, b) over all pairs of the ``n`` vectors (k, v), block by block.

    Each of the blocks, PARTS or as many as BLOCK asks for, becomes classes first; then each two blocks meet, and
    only rows of different classes are compared.
    """
    key = vectors.schema["k"].dataType.simpleString()
    parts = max(min(PARTS, math.ceil(n / BUCKET)), math.ceil(n / BLOCK), 1)
    dealt = spread(vectors.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")), "block")
    rows = materialise(dealt.groupBy("block").applyInPandas(class_of_block(least_cosine, kind), f"k {key}, v binary, block int, label {key}"))
    inside = rows.select(F.col("k").alias("a"), F.col("label").alias("b"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p != F.col("block"))).alias("other")
    met = rows.select("v", "label", "block", other).select("v", "label", (F.col("block") < F.col("other")).alias("first"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return inside.unionByName(spread(met, "i", "j").groupBy("i", "j").applyInPandas(links_of_sides(least_cosine, kind), f"a {key}, b {key}"))


def n_tables(bits: int, least_cosine: float, recall: float) -> int:
    """Tables of ``bits`` planes that a pair just at the bound needs to meet with probability ``recall``."""
    meets = (1 - math.acos(min(1.0, least_cosine)) / math.pi) ** bits
    return 1 if meets >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meets))


def n_planes(n: int, least_cosine: float, recall: float) -> int:
    """Planes of a table that cost least for ``n`` vectors; 0 where to compare all of them, each two blocks once, costs less than any.

    Up to ALWAYS vectors are compared so. Under a loose bound a pair needs so many tables to meet that moving the rows takes longer than comparing all.
    """
    cost = {bits: n_tables(bits, least_cosine, recall) * (MOVE + n / 2**bits) for bits in range(1, MOST_BITS + 1)}
    cost[0] = max(PARTS, n / BLOCK) * MOVE + n / 2
    return 0 if n <= ALWAYS else min(cost, key=cost.get)


def _links(vectors: DataFrame, least_cosine: float, recall: float, kind: str) -> DataFrame:
    """Links (a, b) of distinct vectors (k, v): of all pairs in blocks, or where two lie on the same side of several random planes.

    The number of planes is that which costs least for the number of vectors; the number of tables follows from ``recall`` for a pair
    just at the bound. Vectors in buckets of over BLOCK go on to the next level with more planes, or, where that costs no more,
    they are compared whole, block by block.
    """
    key, out, level, least_bits = vectors.schema["k"].dataType.simpleString(), None, 0, 0
    while True:
        n = vectors.count()
        bits = n_planes(n, least_cosine, recall)
        if bits <= least_bits:
            found = _all_links(vectors, n, least_cosine, kind)
            return found if out is None else out.unionByName(found)
        keyed = vectors.mapInPandas(_sign_keys(bits, n_tables(bits, least_cosine, recall), 42 + level, kind), f"k {key}, v binary, t int, bucket long")
        hot = materialise(keyed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK))
        n_hot = hot.count()
        hint = broadcast_if_small(hot, n_hot, 100_000)
        few = keyed.join(hint, ["t", "bucket"], "left_anti") if n_hot else keyed
        found = spread(few, "t", "bucket").groupBy("t", "bucket").applyInPandas(_joined(least_cosine, kind), f"a {key}, b {key}")
        out = found if out is None else out.unionByName(found)
        if not n_hot:
            return out
        vectors = materialise(keyed.join(hint, ["t", "bucket"]).select("k", "v").dropDuplicates(["k"]))
        level, least_bits = level + 1, bits


def near_copies(df: DataFrame, key: str, features: str, least_cosine: float, recall: float = 0.95) -> DataFrame:
    """``key``, class_id, copies for every row: the smallest key reachable over pairs of at least ``least_cosine``.

    Equal vectors are one node, which stands for ``copies`` rows, so they are never paired. Where all pairs are compared
    (``n_planes``) none is missed; else a pair just at the bound is found with probability ``recall`` or more, a closer one almost surely. Vectors have one
    length; null vectors, and those with a null or NaN in them, are alone. Keys are unique and not null. An
    empty table gives an empty result.
    """
    rows = materialise(df.select(F.col(key).alias("k"), F.col(features).cast("array<double>").alias("x")))
    usable = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    vectors = materialise(rows.filter(usable).groupBy("x").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies")))
    kind = element_kind(df, features)
    roots = components(_links(materialise(packed(vectors, kind)), least_cosine, recall, kind))
    owners = vectors.join(roots, F.col("k") == F.col("node"), "left").select("x", "copies", F.coalesce("root", "k").alias("class_id"))
    owners = materialise(owners)
    known = join_unique(rows, owners, "x", owners.filter(F.col("copies") > HEAVY_ROWS)).select("k", "class_id", "copies")
    alone = rows.filter(~F.coalesce(usable, F.lit(False))).select("k", F.col("k").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return known.unionByName(alone).withColumnRenamed("k", key)
