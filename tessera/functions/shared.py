"""Tables written to the shared folder between steps, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of one key beyond which ``join_unique`` takes the key out of the shuffle, and most such keys.
HEAVY_ROWS, MOST_HEAVY = 10_000, 100_000


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing in local mode (as in tests) a temporary folder of the application;
    on a cluster its executors would not see that folder, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or _own_folder(spark.sparkContext.applicationId)).rstrip('/')}/tessera-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


#: Spark deletes a query's shuffle files at its end, instead of when the driver happens to collect garbage.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, options: dict | None = None, settings: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    What was shuffled for it is not needed any more once it is written, so its files go at once.
    ``options`` are the writer's; ``settings`` of the session hold while ``df`` is computed.
    """
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    settings = {RELEASE_SHUFFLES: "true"} | (settings or {})
    before = {k: conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_seen(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and ``aggregates`` over the rows, taken while they are written: no second job reads them again."""
    seen = Observation()
    out = materialise(df.observe(seen, *(a.alias(name) for name, a in aggregates.items())))
    return out, seen.get


def materialise_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialise``, and the number of rows."""
    out, seen = materialise_seen(df, n=F.count(F.lit(1)))
    return out, seen["n"]


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialised ``df`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_unique(rows: DataFrame, unique: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Inner join on ``key``, which is unique in ``unique`` and may be that of very many ``rows``.

    ``heavy`` has the keys of more than HEAVY_ROWS rows. There is at most one such key for HEAVY_ROWS
    rows; as long as they are few enough to be broadcast, their rows are joined where they are.
    """
    n = heavy.limit(MOST_HEAVY + 1).count()
    if not n or n > MOST_HEAVY:
        return rows.join(unique, key)
    keys = F.broadcast(heavy.select(key))
    few = F.broadcast(unique.join(keys, key, "left_semi"))
    return rows.join(keys, key, "left_anti").join(unique, key).unionByName(rows.join(few, key))


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only when the counted rows stay within ``limit``; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


#: Rows that a task should sort or group at once.
ROWS_A_TASK = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``rows`` rows dealt by ``keys`` to tasks of about ROWS_A_TASK, so that the memory of a task does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to four tasks a core, for work that is large by the row: adaptive execution would merge few bytes into few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
