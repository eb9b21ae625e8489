"""Versioned tables of files: what a writer stages becomes visible all at once, and two writers never both win.

A table is a folder with ``data``, where every write stages files of its own, and ``versions``, where version n is a small file
that lists the staged folders that make up the table. A commit claims the next number: the file is made under
another name and moved there only if nothing is there yet. Who loses the claim drops what the winner has already added and
tries the next number. A job that dies before its claim has changed nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import match


class Conflict(RuntimeError):
    """The table was replaced since it was read, or too many writers were faster."""


@dataclass
class Version:
    number: int
    parts: list[str] = field(default_factory=list)
    schema: str | None = None
    form: str = "parquet"
    #: Names of writes that are in the table, so that a repeated one is left out.
    tokens: list[str] = field(default_factory=list)
    replaced: int = 0


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    system, place = _system(spark, f"{folder}/versions")
    if not system.exists(place):
        return []
    names = (f.getPath().getName() for f in system.listStatus(place))
    return sorted(int(n) for n in names if n.isdigit())


def _read_text(spark: SparkSession, path: str) -> str:
    system, place = _system(spark, path)
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def version(spark: SparkSession, folder: str, number: int | None = None) -> Version | None:
    """A version of the table, by default the newest; None where the table has none."""
    if number is None:
        numbers = _numbers(spark, folder)
        if not numbers:
            return None
        number = numbers[-1]
    return Version(**json.loads(_read_text(spark, f"{folder}/versions/{number}")))


def _claim(spark: SparkSession, folder: str, new: Version) -> bool:
    """Whether the version file could be put in place, whole and by nobody else."""
    target, staged = f"{folder}/versions/{new.number}", f"{folder}/versions/.{uuid.uuid4().hex}"
    system, place = _system(spark, staged)
    out = system.create(place, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    _, goal = _system(spark, target)
    try:
        if system.getScheme() == "file":
            # Hadoop's local rename looks first and moves then; a hard link does both at once.
            os.link(place.toUri().getPath(), goal.toUri().getPath())
            return True
        return not system.exists(goal) and bool(system.rename(place, goal))  # atomic, and fails if the file exists, on HDFS
    except FileExistsError:
        return False
    finally:
        system.delete(place, False)


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    known = version(spark, folder, number)
    if known is None:
        raise FileNotFoundError(f"{folder} has no version yet")
    return _rows(spark, folder, known, known.parts)


def _rows(spark: SparkSession, folder: str, known: Version, parts: Sequence[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(known.schema))
    if not parts:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).format(known.form).option("header", "true")
    # Partition values are read from the folders below each part.
    return reader.load([f"{folder}/data/{p}" for p in parts]) if len(parts) == 1 else _union([reader.load(f"{folder}/data/{p}") for p in parts])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def commit(df: DataFrame, folder: str, key: Sequence[str] = (), replace: bool = False, partition_by: Sequence[str] = (), form: str = "parquet", token: str | None = None, tries: int = 20) -> Version:
    """Add ``df`` to the table, or put it in the place of all rows with ``replace``; gives the version that holds it.

    With ``key`` (nulls are values) only rows of new keys are added, one of each. Another writer's commit in between is seen, and
    its keys are left out; a ``replace`` that meets one raises Conflict, since it has not seen what it would remove. A write with
    a ``token`` that the table already has adds nothing. Rows are staged first, so nobody sees half of a write.
    """
    spark, key = df.sparkSession, list(key)
    rows, base = (df.dropDuplicates(key) if key else df), version(spark, folder)
    if base and token and token in base.tokens:
        return base
    if base and not replace and (base.form != form or T.StructType.fromJson(json.loads(base.schema)).fieldNames() != df.schema.fieldNames()):
        raise ValueError(f"{folder} has other columns or another format")
    if base and key and not replace:
        rows = match(rows, _rows(spark, folder, base, base.parts).select(*key), key, "left_anti")
    part = _stage(rows, folder, partition_by, form)
    for _ in range(tries):
        now = base or Version(0)
        schema = now.schema if base and not replace else df.schema.json()
        parts = [part] if replace else [*now.parts, part]
        new = Version(now.number + 1, parts, schema, form, [*(() if replace else now.tokens), *([token] if token else [])], now.number + 1 if replace else now.replaced)
        if _claim(spark, folder, new):
            return new
        won = version(spark, folder)
        if replace or won.replaced > now.number:
            raise Conflict(f"version {won.number} of {folder} came in between")
        if token and token in won.tokens:
            return won
        if key:
            added = _rows(spark, folder, won, [p for p in won.parts if p not in now.parts]).select(*key)
            part = _stage(match(_rows(spark, folder, Version(0, schema=schema, form=form), [part]), added, key, "left_anti"), folder, partition_by, form)
        base = won
    raise Conflict(f"{folder}: {tries} other writers were faster")


def _stage(rows: DataFrame, folder: str, partition_by: Sequence[str], form: str) -> str:
    part = uuid.uuid4().hex
    rows.write.partitionBy(*partition_by).format(form).option("header", "true").save(f"{folder}/data/{part}")
    return part


def compacted(spark: SparkSession, folder: str, partition_by: Sequence[str] = ()) -> Version:
    """Put all rows into one staged folder; Conflict if somebody commits meanwhile."""
    known = version(spark, folder)
    rows = _rows(spark, folder, known, known.parts)
    part = _stage(rows, folder, partition_by, known.form)
    new = Version(known.number + 1, [part], known.schema, known.form, known.tokens, known.number + 1)
    if not _claim(spark, folder, new):
        raise Conflict(f"{folder} changed while it was compacted")
    return new


def history(spark: SparkSession, folder: str) -> list[Version]:
    return [version(spark, folder, n) for n in _numbers(spark, folder)]


def changes(spark: SparkSession, folder: str, since: int) -> DataFrame:
    """The rows that were added after version ``since``; raises Conflict where the table was replaced since."""
    old, new = version(spark, folder, since), version(spark, folder)
    if new.replaced > since:
        raise Conflict(f"{folder} was replaced after version {since}")
    return _rows(spark, folder, new, [p for p in new.parts if p not in old.parts])


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions and the staged folders that none of these lists; gives how many folders went.

    Not to be run beside a writer: what it has staged is not listed yet.
    """
    numbers = _numbers(spark, folder)
    used = {p for n in numbers[-keep:] for p in version(spark, folder, n).parts}
    for n in numbers[:-keep]:
        system, place = _system(spark, f"{folder}/versions/{n}")
        system.delete(place, False)
    system, place = _system(spark, f"{folder}/data")
    gone = [f.getPath() for f in system.listStatus(place) if f.getPath().getName() not in used] if system.exists(place) else []
    for path in gone:
        system.delete(path, True)
    return len(gone)
