"""Deterministic pseudo-random order and global ranks that don't gather rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Stands for a null key in a seeded hash.
NO_KEY = "\\N"


def seeded(seed: int | str, *keys: Column | str) -> Column:
    """md5 of "<seed>:<key>"; several keys are joined by ":", nulls as NO_KEY. The order of these texts is the shuffle."""
    texts = ((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(t, F.lit(NO_KEY)) for t in texts)))


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` that keeps rows with nulls in them: a null matches a null. The left side's keys stay."""
    names = {k: f"_match{i}" for i, k in enumerate(keys)}
    right = right.select(*(F.col(k).alias(names[k]) for k in keys), *(c for c in right.columns if c not in names))
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, on, how).drop(*names.values())


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the seeded hash."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def ranked(df: DataFrame, order: Sequence[Column | str], bucket: Column, by: Sequence[str] = (), name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the 1-based rank of each row within ``by``, in ``order``, which must end in a unique key.

    ``bucket`` must not decrease along the order and should have a few thousand values: rows are ranked
    inside each bucket, and the buckets before it are counted, so neither a global order nor a group of
    any size meets in one task. ``total`` names a column for the group's number of rows. Nulls in ``by``
    are a group of their own.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    before = F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_total"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    out = match(rows.withColumn(name, inside), counts, [*by, "_bucket"])
    out = out.withColumn(name, F.col(name) + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_before", "_total")


def hash_ranked(df: DataFrame, seed: int | str, keys: Sequence[str], by: Sequence[str] = (), name: str = "rank", total: str | None = None, digits: int = 3) -> DataFrame:
    """Ranks in seeded hash order of ``keys`` (unique within ``by``)."""
    rows = df.withColumn("_hash", seeded(seed, *keys))
    return ranked(rows, ["_hash", *keys], F.substring("_hash", 1, digits), by, name, total).drop("_hash")
