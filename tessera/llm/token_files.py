"""Token-id output: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

Layout of one part (a range of doc_id, in ascending order):

* ``<part>.ids``  - unsigned little-endian token ids of 16 bits (vocabularies of up to 65,536) or 32 bits,
  nothing else; the manifest names the type;
* ``<part>.off``  - signed 64-bit little-endian: offsets of the documents' first ids within the part,
  then the part's number of ids (documents + 1 numbers);
* ``<part>.doc``  - signed 64-bit little-endian document ids, in the same order;
* ``<part>.nul``  - one byte a document, 1 where the document id is null.

The manifest has one entry for each part; the place of a part in the whole corpus is the prefix sum of
the parts before it. Names hold the task attempt, and only parts that their task reported belong to the
manifest, so that lost executors and second attempts leave no trace in the result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from tessera.functions.shared import shared_dir

from .common import SLICE_ROWS

KINDS = ("ids", "off", "doc", "nul")


def _store(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[dict]:
    """Encode every row of ``docs``, append ``end_id``, write the files; returns the manifest.

    Documents are range-partitioned by id once (null ids first). Ties, also one id on a third of all
    rows, are split between parts by the text's hash and the row's place in the input; they keep that
    order. Null and empty texts give just the end id. The manifest holds one small entry a part, so its
    size is bounded by the number of partitions, not by the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, store, root = encoder(tokenizer_path), *_store(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        end, kind = np.array([end_id], dtype="<u4").tobytes(), id_type(own, end_id)
        store.create_dir(root, recursive=True)
        n_docs = n_ids = 0
        files = {k: store.open_output_stream(f"{root}/{name}.{k}") for k in KINDS}
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    rows = batch.slice(at, SLICE_ROWS)
                    coded = [own.encode(x) + end for x in rows.column(1).to_pylist()]
                    sizes = np.array([len(x) // 4 for x in coded], dtype=np.int64)
                    files["ids"].write(np.frombuffer(b"".join(coded), dtype="<u4").astype(kind).tobytes())
                    files["off"].write((n_ids + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                    files["doc"].write(rows.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    files["nul"].write(rows.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                    n_docs += len(coded)
                    n_ids += int(sizes.sum())
            files["off"].write(np.array([n_ids], dtype="<i8").tobytes())
        finally:
            for f in files.values():
                f.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [n_docs], "ids": [n_ids], "type": [kind]}, schema=made)

    made = pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("type", pa.string())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = ("id", "tie", "place")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    parts = sorted((r.asDict() for r in rows.mapInArrow(run, "part int, name string, docs long, ids long, type string").collect()), key=lambda p: p["part"])
    parts = [p for p in parts if p["docs"]]
    for key in ("docs", "ids"):
        for p, base in zip(parts, accumulate((q[key] for q in parts), initial=0), strict=False):
            p[f"{key}_before"] = base
    return parts


def id_type(own, end_id: int) -> str:
    return "<u2" if max(len(own.tokens) - 1, end_id) < 1 << 16 else "<u4"


def slices(folder: str, part: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A part's documents in slices: ids of documents, which of them are null, offsets in the part, token ids.

    Local and mounted folders are mapped into memory; from other stores one slice's range is read at a time.
    """
    store, root = _store(folder)
    local, wide = store.type_name == "local", int(part["type"][-1])
    names = {k: f"{root}/{part['name']}.{k}" for k in KINDS}

    def mapped(kind: str, dtype: str) -> np.ndarray:
        return np.memmap(names[kind], dtype=dtype, mode="r") if local else np.frombuffer(store.open_input_file(names[kind]).read(), dtype=dtype)

    off, doc, nul = mapped("off", "<i8"), mapped("doc", "<i8"), mapped("nul", "u1")
    ids = mapped("ids", part["type"]) if local else store.open_input_file(names["ids"])
    for at in range(0, part["docs"], SLICE_ROWS):
        ends = np.array(off[at : at + SLICE_ROWS + 1])
        if local:
            flat = np.array(ids[ends[0] : ends[-1]])
        else:
            ids.seek(int(ends[0]) * wide)
            flat = np.frombuffer(ids.read(int(ends[-1] - ends[0]) * wide), dtype=part["type"])
        n = len(ends) - 1
        yield np.array(doc[at : at + n]), np.array(nul[at : at + n], dtype=bool), ends, flat


def _each_part(spark: SparkSession, folder: str, parts: list[dict], last, last_type: str) -> DataFrame:
    name = last_type.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (parts[i] for i in batch.column(0).to_pylist()):
                for doc, null, ends, flat in slices(folder, part):
                    columns = [pa.array(doc, mask=null), pa.array(part["ids_before"] + ends[:-1]), pa.array(np.diff(ends)), last(ends - ends[0], flat)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", name])

    one_each = spark.range(0, len(parts), 1, max(1, len(parts)))
    return one_each.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last_type}")


def read(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids (array of int). A part is a task."""
    return _each_part(spark, folder, parts, lambda ends, flat: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))), "ids array<int>")


def checksums(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """Like ``read``, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""

    def crc(ends: np.ndarray, flat: np.ndarray) -> pa.Array:
        data = memoryview(flat.astype("<u4").tobytes())
        return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], type=pa.int64())

    return _each_part(spark, folder, parts, crc, "ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    """A folder for token files below spark.checkpoint.dir."""
    return f"{shared_dir(spark)}/tokens"
