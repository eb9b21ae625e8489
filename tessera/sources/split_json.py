"""JSON documents of any size, read in byte ranges by many tasks.

A range alone doesn't tell whether it begins inside a string, nor which objects are open. So ranges are read
three times: first for the parity of their quotes, then, now that strings are known, for how they change the
stack of open objects and arrays, and last for their values. Between the reads the driver combines one small row a range.
A value belongs to the range that holds the comma or bracket before it, and is read to its end beyond a cut.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at once behind a range, to complete a value, or before it, to find a key.
SLACK = 1 << 16
#: Values of one Arrow batch.
BATCH = 8192

_TURN = np.zeros(256, np.int64)
_TURN[[ord("{"), ord("[")]], _TURN[[ord("}"), ord("]")]] = 1, -1
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "{}[],:"]] = True

SCHEMAS = {
    "quotes": "path string, start long, quotes long",
    "shape": "path string, start long, shape string",
    "values": "path string, keys array<string>, value string",
}


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    size: int
    in_string: bool = False
    #: Open objects and arrays from the outermost: bracket, key in its parent (None: an array's), commas so far.
    stack: tuple = ()


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges that one task reads."""

    ranges: list[ByteRange]


class _File:
    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)

    def read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(end - start)


def _escaped(file: _File, start: int) -> bool:
    """Whether a backslash before ``start`` escapes the byte there."""
    n, at = 0, start
    while at:
        before = file.read(max(0, at - SLACK), at)
        run = len(before) - len(before.rstrip(b"\\"))
        n, at = n + run, at - len(before)
        if run < len(before):
            break
    return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that begin or end a string."""
    quotes, backs = np.flatnonzero(data == ord('"')), np.flatnonzero(data == ord("\\"))
    if len(backs):
        first = np.flatnonzero(np.diff(backs, prepend=-2) != 1)
        last = np.append(first[1:], len(backs)) - 1
        odd = (last - first + 1 + (escaped & (backs[first] == 0))) % 2 == 1
        quotes = np.setdiff1d(quotes, backs[last[odd]] + 1, assume_unique=True)
    return quotes[1:] if escaped and len(quotes) and quotes[0] == 0 else quotes


def _signs(data: np.ndarray, in_string: bool, escaped: bool) -> np.ndarray:
    """Places of brackets, commas and colons outside strings."""
    at = np.flatnonzero(_SIGNS[data])
    return at[(np.searchsorted(_quotes(data, escaped), at) + in_string) % 2 == 0]


def _key_before(file: _File, at: int) -> str | None:
    """The key of the value that begins at ``at``, None in an array."""
    reach = SLACK
    while True:
        start = max(0, at - reach)
        before = file.read(start, at).rstrip()
        if before and before[-1:] != b":":
            return None
        before = before[:-1].rstrip()
        quote = len(before) - 1
        while quote > 0:
            quote = before.rfind(b'"', 0, quote)
            if quote < 0 or (quote - len(before[:quote].rstrip(b"\\"))) % 2 == 0:
                break
        # A run of backslashes that reaches the start of what was read may go on before it.
        if quote > 0 and before[:quote].rstrip(b"\\"):
            return json.loads(before[quote:])
        if not start:
            return json.loads(before[quote:]) if quote >= 0 else None
        reach *= 8


def _shape(part: ByteRange) -> dict:
    """What a range does to the stack: how many it closes, the commas of the innermost that stays, and what it opens."""
    file = _File(part.path)
    data = np.frombuffer(file.read(part.start, part.end), np.uint8)
    at = _signs(data, part.in_string, _escaped(file, part.start))
    sign = data[at]
    turn = _TURN[sign]
    depth = np.cumsum(turn)
    low = int(min(0, depth.min(initial=0)))
    comma = sign == ord(",")
    opened = []
    for level in range(low + 1, int(depth[-1]) + 1 if len(depth) else low + 1):
        k = int(np.flatnonzero((turn == 1) & (depth == level))[-1])
        opened.append([chr(sign[k]), _key_before(file, part.start + int(at[k])), int((comma[k:] & (depth[k:] == level)).sum())])
    return {"closed": -low, "commas": int((comma & (depth == low)).sum()), "opened": opened}


def _labels(stack: list) -> list[str]:
    """Keys of the open objects and arrays below the outermost; in an array, the place from 0."""
    return [key if key is not None else str(parent[2]) for parent, (_, key, _) in zip(stack, stack[1:], strict=False)]


def _values(part: ByteRange, depth: int) -> Iterator[tuple[list[str], str]]:
    """(keys, text) of the values at ``depth`` that begin behind a sign of the range."""
    file, reach = _File(part.path), SLACK
    escaped = _escaped(file, part.start)
    while True:
        data = file.read(part.start, min(part.size, part.end + reach))
        bytes_ = np.frombuffer(data, np.uint8)
        at = _signs(bytes_, part.in_string, escaped)
        sign = bytes_[at]
        turn = _TURN[sign]
        level = len(part.stack) + np.cumsum(turn)
        own = at < part.end - part.start
        # Signs at which a value of the wanted depth begins, and those at which one ends.
        begins = own & (level == depth) & ((turn == 1) | (sign == ord(",")))
        ends = ((level == depth) & (sign == ord(","))) | ((level == depth - 1) & (turn == -1))
        last = np.flatnonzero(begins)
        if not len(last) or ends[last[-1] + 1 :].any() or part.start + len(data) >= part.size:
            break
        reach *= 8
    wanted = ((turn == 1) & (level <= depth)) | ((turn == -1) & (level < depth)) | ((sign == ord(",")) & (level <= depth)) | ((sign == ord(":")) & (level == depth))
    stack, open_at, colon = [list(x) for x in part.stack[:depth]], -1, -1
    for k in np.flatnonzero(wanted).tolist():
        p, kind = int(at[k]), chr(sign[k])
        if kind == ":":
            colon = p
            continue
        if open_at >= 0 and ends[k]:
            text = data[(colon if colon > open_at else open_at) + 1 : p].strip()
            if text:
                key = json.loads(data[open_at + 1 : colon]) if colon > open_at else str(stack[-1][2])
                yield [*_labels(stack), key], text.decode("utf-8", "replace")
            open_at = -1
        if kind == ",":
            stack[-1][2] += 1
        elif kind in "{[":
            stack.append([kind, _key_before(file, part.start + p) if stack else None, 0])
        else:
            stack.pop()
        if begins[k]:
            open_at = p
        elif not own[k] and open_at < 0:
            break


class JsonReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.step, self.depth = options.get("step", "quotes"), int(options.get("depth", "1"))
        # Every task gets a copy of the reader, so it holds the list as text, and only the planning reads it.
        self.listed, self.tasks, self.most = options["ranges"], int(options.get("tasks", "0")), int(options.get("most", "0"))

    def partitions(self) -> list[InputPartition]:
        """As many tasks as asked for, with about the same number of bytes, or more where they would have over ``most``."""
        ranges = [ByteRange(*x) for x in json.loads(self.listed)]
        total = sum(r.end - r.start for r in ranges)
        tasks = max(self.tasks, -(-total // self.most) if self.most else 0) or len(ranges)
        share, out, at = total / tasks, {}, 0
        for r in ranges:
            out.setdefault(int(at // share) if share else 0, []).append(r)
            at += r.end - r.start
        return [Ranges(x) for x in out.values()]

    def read(self, part: Ranges) -> Iterator:
        for each in part.ranges:
            yield from self._read(each)

    def _read(self, part: ByteRange) -> Iterator:
        if self.step == "quotes":
            file = _File(part.path)
            data = np.frombuffer(file.read(part.start, part.end), np.uint8)
            yield part.path, part.start, len(_quotes(data, _escaped(file, part.start)))
        elif self.step == "shape":
            yield part.path, part.start, json.dumps(_shape(part))
        else:
            rows = []
            for row in _values(part, self.depth):
                rows.append(row)
                if len(rows) == BATCH:
                    yield self._batch(part.path, rows)
                    rows = []
            if rows:
                yield self._batch(part.path, rows)

    @staticmethod
    def _batch(path: str, rows: list) -> pa.RecordBatch:
        columns = [pa.array([path] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.list_(pa.string())), pa.array([v for _, v in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "keys", "value"])


class JsonSource(DataSource):
    """``split_json``: a step of reading the byte ranges in the option ``ranges``; use ``scan_json_values``."""

    @classmethod
    def name(cls) -> str:
        return "split_json"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("step", "quotes")]

    def reader(self, schema) -> JsonReader:
        return JsonReader(dict(self.options), schema)


def _step(spark: SparkSession, ranges: list[ByteRange], step: str, depth: int = 1) -> DataFrame:
    listed = json.dumps([[r.path, r.start, r.end, r.size, r.in_string, r.stack] for r in ranges])
    tasks, most = 4 * spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return spark.read.format("split_json").options(ranges=listed, step=step, depth=depth, tasks=tasks, most=most).load()


def _after(stack: list, shape: dict, path: str) -> list:
    if shape["closed"] > len(stack):
        raise ValueError(f"{path} closes more brackets than it opens")
    stack = [list(x) for x in stack[: len(stack) - shape["closed"]]]
    if stack:
        stack[-1][2] += shape["commas"]
    return stack + shape["opened"]


def with_states(ranges: list[ByteRange], run: Callable[[list[ByteRange], str], Iterable[tuple]]) -> list[ByteRange]:
    """The ranges with the state at their starts; ``run`` gives the rows of a step."""
    quotes = {tuple(r)[:2]: r[2] for r in run(ranges, "quotes")}
    inside = False
    for r in ranges:
        r.in_string = inside and r.start > 0
        inside = (r.in_string + quotes[r.path, r.start]) % 2 == 1
        if inside and r.end == r.size:
            raise ValueError(f"{r.path} ends inside a string")
    shapes = {tuple(r)[:2]: json.loads(r[2]) for r in run(ranges, "shape")}
    stack: list = []
    for r in ranges:
        r.stack = tuple(map(tuple, stack)) if r.start else ()
        stack = _after(list(r.stack), shapes[r.path, r.start], r.path)
        if stack and r.end == r.size:
            raise ValueError(f"{r.path} ends before its brackets are closed")
    return ranges


def byte_ranges(spark: SparkSession, path: str, split_bytes: int | None = None) -> list[ByteRange]:
    """Ranges of the files at ``path``, a file or a folder, with the state at the start of each."""
    size = split_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()
    ranges = [ByteRange(f["path"], at, min(at + size, f["length"]), f["length"]) for f in sorted(files) for at in range(0, f["length"], size)]
    spark.dataSource.register(JsonSource)
    return with_states(ranges, lambda ranges, step: _step(spark, ranges, step).collect()) if ranges else []  # a row a range


def scan_json_values(spark: SparkSession, path: str, depth: int, split_bytes: int | None = None) -> DataFrame:
    """path, keys, value: the values ``depth`` levels below the outermost object or array of each document, as JSON text.

    ``keys`` are the ``depth`` keys on the way there, in arrays the place from 0. Values that end above that depth
    have no row. A file may hold several documents, one behind the other. Ranges have ``split_bytes``, by
    default as many as Spark's own readers take; a value is held whole by one task, a document or an array of values
    never. Empty files and folders give no rows; a file that ends inside a document raises ValueError.
    """
    ranges = byte_ranges(spark, path, split_bytes)
    if not ranges:
        return spark.createDataFrame([], SCHEMAS["values"])
    return _step(spark, ranges, "values", depth)
