"""Running metrics: counts by score cell are the state, and every metric follows from them at any time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shared import path_exists
from tessera.streaming.incremental import rocksdb_state


def score_cells(rows: DataFrame, by: Sequence[str], score: str, label: str = "label", cells: int = 1000) -> DataFrame:
    """``by``, cell, real, fake, total: rows of each class and the sum of their scores in each of ``cells`` + 1 score cells.

    Cell k holds the scores that round to k / ``cells``. The counts of two sets of rows add up to those of both, so a stream keeps
    them as state, at most ``cells`` + 1 rows a group whatever the number of samples. Rows without score or label are left out.
    """
    kept = rows.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    cell = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))) * cells).cast("int")
    return kept.groupBy(*by, cell.alias("cell")).agg(F.count_if(F.col(label) == 0).alias("real"), F.count_if(F.col(label) == 1).alias("fake"), F.sum(score).alias("total"))


def class_mix(rows: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """``by``, n, fakes, share."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("fakes"), F.avg(label).alias("share"))


def run_keyed(changes: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is available, in update mode, into the keyed table ``folder``: each batch writes the groups that it changed.

    A batch has a folder of its own, which a repeated batch overwrites, so nothing counts twice. No row passes the driver.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    with rocksdb_state(changes.sparkSession):
        changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, schema, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key of a keyed table; an empty table where no batch has come yet."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(folder)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def compact(spark: SparkSession, folder: str, schema, keys: Sequence[str], target: str) -> None:
    """Write the newest rows of a keyed table as batch 0 of another, so that old batches need not be read any more."""
    latest(spark, folder, schema, keys).write.mode("overwrite").parquet(f"{target}/batch=0")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def live_auc(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, n, auc from score cells: ties within a cell count half; null where a class is missing.

    Exact where scores lie on the grid of the cells; otherwise off by at most half the share of pairs that share a cell.
    """
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("real").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = cells.withColumn("won", F.col("fake") * (before + F.col("real") / 2))
    sums = won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("real").alias("real"), F.sum("fake").alias("fake"))
    return sums.select(*by, (F.col("real") + F.col("fake")).alias("n"), _ratio(F.col("won"), F.col("real") * F.col("fake")).alias("auc"))


def live_calibration(cells: DataFrame, by: Sequence[str], cells_a_bin: int) -> DataFrame:
    """``by``, bin, n, mean_score, share of fakes in bins of ``cells_a_bin`` cells, left open but for the first; empty bins are absent."""
    bin_ = F.greatest(F.lit(0), F.ceil(F.col("cell") / cells_a_bin) - 1).cast("int")
    n = F.sum(F.col("real") + F.col("fake"))
    return cells.groupBy(*by, bin_.alias("bin")).agg(n.alias("n"), (F.sum("total") / n).alias("mean_score"), (F.sum("fake") / n).alias("share"))
