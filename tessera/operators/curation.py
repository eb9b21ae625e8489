"""Joins, filters and set operations that turn raw sources into one manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import broadcast_if_small, dealt

#: Members of an ensemble whose weights are broadcast.
MOST_MEMBERS = 100_000


def merge_sources(first: DataFrame, second: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Union by name; columns that one side lacks, and nulls, take their default."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def exclude(df: DataFrame, held_out: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the held-out tables (each has the column ``key``)."""
    keys = held_out[0].select(key)
    for other in held_out[1:]:
        keys = keys.union(other.select(key))
    return df.join(keys.distinct(), key, "left_anti")


def exclude_components(df: DataFrame, ids: DataFrame, key: str, pattern: str = r"\d+") -> DataFrame:
    """Rows of which no part of ``key`` that matches ``pattern`` is in ``ids`` (column component)."""
    parts = df.select(key).distinct().select(key, F.explode(F.regexp_extract_all(F.col(key), F.lit(pattern), F.lit(0))).alias("component"))
    return df.join(parts.join(ids.select("component").distinct(), "component", "left_semi").select(key).distinct(), key, "left_anti")


def assign_domain(df: DataFrame, identity: str, paired: Column, own: Column, label: str = "label") -> DataFrame:
    """Adds ``pair_domain``: ``paired`` for fakes whose identity is among the reals, else ``own``."""
    reals = df.filter(F.col(label) == 0).select(identity).distinct().withColumn("_real", F.lit(True))
    out = df.join(reals, identity, "left")
    return out.withColumn("pair_domain", F.when((F.col(label) == 1) & F.col("_real").isNotNull(), paired).otherwise(own)).drop("_real")


def matched_frame(fakes: DataFrame, reals: DataFrame, identity: str, frame: str) -> DataFrame:
    """One frame for each fake identity: the smallest that the reals have as well, else its first."""
    own = fakes.select(identity, frame).distinct()
    real = reals.select(identity, frame).distinct().withColumn("_met", F.lit(1))
    both = own.join(real, [identity, frame], "left").groupBy(identity)
    return both.agg(F.min(F.when(F.col("_met") == 1, F.col(frame))).alias("_m"), F.min(frame).alias("_f")).select(identity, F.coalesce("_m", "_f").alias(frame), F.col("_m").isNotNull().alias("matched"))


def label_exists(images: DataFrame, annotations: DataFrame, key: str, category: Column) -> DataFrame:
    """Adds ``has_label``: whether any annotation of the image meets ``category``."""
    hits = annotations.filter(category).select(key).distinct().withColumn("_hit", F.lit(1))
    return images.join(hits, key, "left").withColumn("has_label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def existing_only(df: DataFrame, listing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a listed key, and one row with how many were kept and dropped."""
    kept = df.join(listing.select(key).distinct(), key, "left_semi")
    flag = df.join(listing.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return kept, flag.agg(F.count("_in").alias("kept"), F.count_if(F.col("_in").isNull()).alias("dropped"))


def alignment_audit(features: DataFrame, manifest: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Counts of keys in both, only in either, and with another label."""
    a, b = features.select(key, F.col(label).alias("_a"), F.lit(1).alias("_x")), manifest.select(key, F.col(label).alias("_b"), F.lit(1).alias("_y"))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("both"), F.count_if(F.col("_y").isNull()).alias("only_features"),
        F.count_if(F.col("_x").isNull()).alias("only_manifest"), F.count_if(F.col("_a") != F.col("_b")).alias("label_mismatch"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def exact_dedup(df: DataFrame, content: str, key: str) -> DataFrame:
    """key, content_sha256, copies: the row of the smallest key of each distinct content; null contents are one, apart from empty ones."""
    hashed = df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("content_sha256"))
    return hashed.groupBy("content_sha256").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def label_sanity(df: DataFrame, label: Column, implied: Column, by: Sequence[str]) -> DataFrame:
    """by, n, contradictions: rows whose label differs from what another column implies (reported only)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(label != implied).alias("contradictions"))


def ensemble(scores: DataFrame, weights: DataFrame, key: str, member: str = "model", score: str = "prob") -> DataFrame:
    """key, prob: weighted mean over the members that scored the sample."""
    weights = broadcast_if_small(weights.select(member, "weight"), weights.count(), MOST_MEMBERS)
    rows = dealt(scores.join(weights, member).select(key, "weight", score), scores.count(), key)
    return rows.groupBy(key).agg((F.sum(F.col("weight") * F.col(score)) / F.sum("weight")).alias("prob"))


def compare_models(reports: DataFrame, keys: Sequence[str], models: Sequence[str], value: str, model: str = "model") -> DataFrame:
    """keys, one column a model, delta (first minus second); keys that a model lacks stay with null, of repeated rows the highest counts."""
    wide = reports.groupBy(*keys).pivot(model, list(models)).agg(F.max(value))
    return wide.withColumn("delta", F.col(models[0]) - F.col(models[1]))


def agreement(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """n, agree: share of rows where two predictions are equal."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(first) == F.col(second)).cast("double")).alias("agree"))


def top(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
