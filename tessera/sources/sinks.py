"""Writers of splits, suites, summaries and predictions."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import match
from tessera.functions.shared import materialise
from tessera.sources import snapshots

STANDARD = ("path", "label")
DETAILED = ("path", "label", "method", "identity", "domain", "video")


def write_split(df: DataFrame, folder: str, detailed: bool = False, form: str = "parquet") -> None:
    """One partition a split, with the standard or the detailed columns, as the newest version of the table ``folder``."""
    snapshots.commit(df.select(*(DETAILED if detailed else STANDARD), "split"), folder, replace=True, partition_by=["split"], form=form)


#: Variants of a method's suite, with their columns: balanced and full, of the test split and of the whole benchmark.
VARIANTS = {"test_balanced": STANDARD, "test_full": STANDARD, "test_detailed": DETAILED, "benchmark_balanced": STANDARD, "benchmark_full": STANDARD}


def write_suites(suites: DataFrame, folder: str) -> None:
    """Rows with suite and variant (of VARIANTS), partitioned by both, as the newest version of the table ``folder``.

    Columns that a variant doesn't have are null in its rows.
    """
    own = lambda c: F.when(F.col("variant").isin([v for v, names in VARIANTS.items() if c in names]), F.col(c)).alias(c)
    snapshots.commit(suites.select(*map(own, DETAILED), "suite", "variant"), folder, replace=True, partition_by=["suite", "variant"])


def append_manifest(df: DataFrame, folder: str, key: str) -> None:
    """Commit the rows whose key isn't in the table ``folder`` yet (one row of each new key)."""
    snapshots.commit(df, folder, [key])


def write_summary(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def predictions_wide(df: DataFrame, key: str, models: Sequence[str], model: str = "model") -> DataFrame:
    """key and, for each model, <model>_prob and <model>_pred; of repeated rows the one with the highest prob counts."""
    row = F.max(F.struct("prob", "pred"))
    wide = df.groupBy(key).pivot(model, list(models)).agg(row)
    return wide.select(key, *(F.col(f"`{m}`.{c}").alias(f"{m}_{c}") for m in models for c in ("prob", "pred")))


def submission(df: DataFrame, key: str, pred: str = "pred") -> DataFrame:
    """key, answer: "fake" or "real"."""
    return df.select(key, F.when(F.col(pred) == 1, "fake").otherwise("real").alias("answer"))


def _json_text(value: Column | str) -> Column:
    """A string as JSON, with quotes; null as null."""
    listed = F.to_json(F.array(F.col(value) if isinstance(value, str) else value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


#: Rows of a JSON document, about, so that the sort of a document fits a task.
DOCUMENT_ROWS = 1 << 18


def _documents(df: DataFrame, by: str, *keys: str) -> DataFrame:
    """Adds ``_doc``: a group of more than DOCUMENT_ROWS rows is dealt to several documents by the hash of ``keys``."""
    sizes = materialise(df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / DOCUMENT_ROWS).alias("_docs")))
    return match(df, sizes, [by]).withColumn("_doc", F.pmod(F.xxhash64(*keys), F.col("_docs"))).drop("_docs")


def write_nested_index(df: DataFrame, folder: str) -> None:
    """JSON documents {source: {side: {split: {video: {"frames": [...]}}}}}, from rows source, side, split, video, frames.

    A source has one document, or several with other videos each where it has more than DOCUMENT_ROWS. A row knows from its neighbours what it has to open and to close, so a task holds one video at a time.
    A video is expected once in its split; the documents of sources that are null or empty are left to a folder of their own.
    """
    df, along = _documents(df, "source", "side", "split", "video"), Window.partitionBy("source", "_doc").orderBy("side", "split", "video")
    before = F.lag(F.struct("side", "split")).over(along)
    inner = F.concat(_json_text("split"), F.lit(":{"))
    side = F.concat(_json_text("side"), F.lit(":{"), inner)
    opening = (
        F.when(before.isNull(), F.concat(F.lit("{"), _json_text("source"), F.lit(":{"), side))
        .when(~before["side"].eqNullSafe(F.col("side")), F.concat(F.lit("}},"), side))
        .when(~before["split"].eqNullSafe(F.col("split")), F.concat(F.lit("},"), inner))
        .otherwise(F.lit(","))
    )
    closing = F.when(F.lead(F.lit(1)).over(along).isNull(), "}}}}").otherwise("")
    line = F.concat(opening, _json_text("video"), F.lit(":"), F.to_json(F.struct("frames")), closing)
    df.select("source", line.alias("value")).write.partitionBy("source").text(folder)


def write_json_arrays(df: DataFrame, folder: str, by: str) -> None:
    """JSON documents {part: [value, ...], ...} for each value of ``by``, from rows ``by``, part, place, value (JSON text).

    Parts and, within them, places ascend. Beyond DOCUMENT_ROWS rows there are several documents, dealt out by place. A task
    holds one value at a time.
    """
    df, along = _documents(df, by, "place"), Window.partitionBy(by, "_doc").orderBy("part", "place")
    before = F.lag("part").over(along)
    named = F.concat(_json_text("part"), F.lit(":["))
    opening = F.when(before.isNull(), F.concat(F.lit("{"), named)).when(before != F.col("part"), F.concat(F.lit("],"), named)).otherwise(F.lit(","))
    closing = F.when(F.lead(F.lit(1)).over(along).isNull(), "]}").otherwise("")
    df.select(by, F.concat(opening, "value", closing).alias("value")).write.partitionBy(by).text(folder)


def _png(pixels: np.ndarray, width: int) -> bytes:
    """A grey image of 8 bits a pixel."""
    rows = pixels.astype(np.uint8).reshape(-1, width)
    raw = b"".join(b"\0" + row.tobytes() for row in rows)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)) for kind, data in parts)


def write_grey_images(df: DataFrame, folder: str, path: str, pixels: str, width: int) -> DataFrame:
    """path: what was written, one PNG file a row at ``folder``/path, from arrays of grey values of full rows.

    The files are written by the tasks, a retried task writes the same ones again. A null array gives a file
    that no reader decodes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for name, values in zip(batch["path"], batch["pixels"], strict=True):
                place = f"{root}/{name}"
                if (parent := os.path.dirname(place)) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(place) as out:
                    out.write(b"\x89PNG broken" if values is None else _png(np.asarray(values), width))
            yield batch[["path"]]

    return df.select(F.col(path).alias("path"), F.col(pixels).cast("array<int>").alias("pixels")).mapInPandas(run, "path string")
