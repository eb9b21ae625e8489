"""Training histories: best and last epochs of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def improvements(df: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "acc") -> DataFrame:
    """Adds best_before (largest value of earlier epochs) and improved (strictly larger than it)."""
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("best_before", F.max(value).over(before))
    return out.withColumn("improved", F.col("best_before").isNull() | (F.col(value) > F.col("best_before")))


def best_epoch(df: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "acc") -> DataFrame:
    """run, best_epoch (first of equal ones), best_value."""
    best = df.groupBy(run).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))).alias("b"))
    return best.select(run, (-F.col("b.e")).alias("best_epoch"), F.col("b.v").alias("best_value"))


def early_stop(df: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", value: str = "acc") -> DataFrame:
    """run, stop_epoch: first epoch that ends ``patience`` epochs in a row without improvement (null: none)."""
    along = Window.partitionBy(run).orderBy(epoch)
    rows = improvements(df, run, epoch, value).withColumn("_island", F.sum(F.col("improved").cast("int")).over(along))
    since = F.row_number().over(Window.partitionBy(run, "_island").orderBy(epoch)) - 1
    return rows.withColumn("_since", since).groupBy(run).agg(F.min(F.when(F.col("_since") >= patience, F.col(epoch))).alias("stop_epoch"))


def latest_run(df: DataFrame, name: str, run: str, started: str) -> DataFrame:
    """All rows of the run of each name that started last (of equal ones the largest run)."""
    last = df.groupBy(name).agg(F.max(F.struct(started, run)).alias("l")).select(name, F.col(f"l.{run}").alias(run))
    return df.join(last, [name, run], "left_semi")
