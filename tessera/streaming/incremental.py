"""Incremental manifests with Structured Streaming: the keys seen so far are state, not files to be read again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.shared import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: on disk, with changes written to the checkpoint."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def grow_manifest(spark: SparkSession, incoming: str, schema, manifest: str, checkpoint: str, key: str, ts: str | None = None, late: str | None = None) -> StreamingQuery:
    """Append the rows of the Parquet folder ``incoming`` whose ``key`` is new to the Parquet folder ``manifest``; gives the ended query.

    A run with the same checkpoint reads the files that came since, and neither the old ones nor the manifest: known keys
    are state in RocksDB, spread over the shuffle partitions. Files become part of the manifest when their batch is committed, so
    a batch that was killed leaves nothing and is done again. Of rows that share a key one stays; null is a key as well.

    State holds every key there ever was. With ``ts`` and ``late`` it is bounded: a key is forgotten when the newest time is ``late``
    beyond its row, and rows that come later than that are dropped.
    """
    stream = spark.readStream.schema(schema).parquet(incoming)
    new = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if ts else stream.dropDuplicates([key])
    with rocksdb_state(spark):
        query = new.writeStream.format("parquet").outputMode("append").option("path", manifest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def windowed_class_mix(stream: DataFrame, ts: str, length: str, late: str, by: str, label: str = "label") -> DataFrame:
    """n and fakes in each time window and group; for append mode.

    A window is given once, when the newest row is ``late`` beyond its end; its state goes then, and rows
    for it that come in a later batch are dropped.
    """
    w = F.window(ts, length)
    out = stream.withWatermark(ts, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("fakes"))
    return out.select(F.col("window.start").alias("start"), by, "n", "fakes")


def run_to_files(df: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Append the groups that the watermark has closed to Parquet files in ``folder``; gives what is there."""
    df.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name below spark.checkpoint.dir; in local mode without it (tests) below a temporary folder."""
    return f"{shared_dir(spark)}-{kind}"
