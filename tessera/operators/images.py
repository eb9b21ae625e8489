"""Audits of image files: what decodes, and simple pixel statistics, as distributed jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import match
from tessera.operators.metrics import quantiles


def decode_audit(spark: SparkSession, folder: str, expected: DataFrame | None = None) -> DataFrame:
    """path, status (ok, corrupt, absent), width, height for every image file below ``folder``.

    Spark's file sources leave out files without content, so missing and empty files are both found as
    ``absent``, by the paths in ``expected`` (column path).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.filter(F.lower("path").rlike(r"\.(png|jpe?g|bmp)$") & (F.col("length") > 0)).select(_plain("path").alias("path"), F.lit(True).alias("_there"))
    seen = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    seen = seen.select(_plain("image.origin").alias("path"), "image.width", "image.height")
    both = files.join(seen, "path", "left")
    if expected is not None:
        both = expected.select(_plain("path").alias("path")).distinct().join(both, "path", "full")
    status = F.when(F.col("_there").isNull(), "absent").when(F.coalesce("height", F.lit(-1)) < 0, "corrupt").otherwise("ok")
    return both.select("path", status.alias("status"), "width", "height")


def _plain(path: str) -> Column:
    """A local path without scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def image_stats(spark: SparkSession, folder: str) -> DataFrame:
    """path, mean, std of the grey image, sharpness (variance of second differences), red, green, blue, blank."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    rows = rows.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").filter("height > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                x = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                bgr = x[:, :, :3] if r.nChannels >= 3 else np.repeat(x[:, :, :1], 3, axis=2)
                grey = bgr @ np.array([0.114, 0.587, 0.299])
                bend = -4 * grey[1:-1, 1:-1] + grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:]
                blue, green, red = bgr.reshape(-1, 3).mean(0)
                out.append((r.origin, grey.mean(), grey.std(), bend.var() if bend.size else 0.0, red, green, blue, bool(grey.var() < 1e-6)))
            yield pd.DataFrame(out, columns=["path", "mean", "std", "sharpness", "red", "green", "blue", "blank"])

    return rows.mapInPandas(run, "path string, mean double, std double, sharpness double, red double, green double, blue double, blank boolean")


def domain_gap(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """by, value, n, mean, p10, p50, p90: the same statistics for each domain or split."""
    long = df.select(by, F.inline(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("x")) for v in values))))
    means = long.groupBy(by, "value").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return match(means, quantiles(long, "x", [by, "value"], [0.1, 0.5, 0.9]).toDF(by, "value", "p10", "p50", "p90"), [by, "value"], "left")
