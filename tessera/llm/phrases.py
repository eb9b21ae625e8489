"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases, the phrases into longer phrases, and so on. In each round runs of one
symbol count as one; deterministic coin tossing turns every other symbol into a small label (twice the lowest
bit in which it differs from its predecessor, plus that bit), a few times over; phrases start at local
maxima of the labels. A phrase's name is a hash of its symbols, so no dictionary is shared. Labels depend on a few
symbols to the left and one to the right: equal substrings get the same phrases but for their edges,
wherever they stand. A fingerprint holds a sketch of the phrase names of each level.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS

#: Levels of phrases, of about 3, 9 and 27 bytes, and the sketch of each: one least name in every bin, 16 bits of it.
LEVELS, BINS = 3, 64
#: Two fingerprints are compared on the highest level where both have so many bins filled, else on the lowest.
ENOUGH = 16
#: Bytes of texts that are parsed together; a longer text is parsed alone, in about 40 times its size of memory.
PARSE_BYTES = 1 << 17
#: Bytes of text of a range of ids, and most ranges.
RANGE_BYTES, MOST_RANGES = 8 << 20, 4096

_MARK = 255  # before, between and behind texts; no byte of UTF-8
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ROUNDS = 3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coin(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a and b differ, plus a's value of it."""
    differ = a ^ b
    place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    place &= np.uint64(63)
    return (2 * place + ((a >> place) & np.uint64(1))).astype(np.uint8)


_PAIRS = _coin(np.arange(65536, dtype=np.uint64) >> np.uint64(8), np.arange(65536, dtype=np.uint64) & np.uint64(255))
#: Symbols of a phrase are the coefficients of a polynomial in this odd number; its powers and their inverses, for
#: texts parsed together (a longer text takes the powers by place; phrases are far shorter than 256 symbols).
_BASE = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(PARSE_BYTES * 2, _BASE, np.uint64)])
_INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(PARSE_BYTES * 2, pow(_BASE, -1, 1 << 64), np.uint64)])


class Level(NamedTuple):
    """Symbols (names, a mark before each text and behind the last), the marks, and, if wanted, where each begins in the bytes."""

    names: np.ndarray
    marks: np.ndarray
    begins: np.ndarray | None


def _tossed(labels: np.ndarray, marks: np.ndarray) -> np.ndarray:
    out = np.empty_like(labels)
    out[1:] = _PAIRS[(labels[1:].astype(np.uint16) << np.uint16(8)) | labels[:-1]]
    out[marks] = _MARK
    return out


def _polynomials(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of value * _BASE^place in each phrase, places from 0."""
    if len(values) <= len(_POWERS):
        return np.add.reduceat(values * _POWERS[: len(values)], at) * _INVERSES[at]
    place = np.arange(len(values)) - np.repeat(at, size)
    return np.add.reduceat(values * _POWERS[place], at)


def _cut(level: Level) -> Level:
    """The next level: phrases of the symbols of ``level``."""
    symbols, marks, begins = level
    same = symbols[1:] == symbols[:-1]
    same[marks[1:] - 1] = False
    runs = None
    if same.any():
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        runs = np.diff(first, append=len(symbols))
        symbols, marks = symbols[first], np.searchsorted(first, marks)
        begins = None if begins is None else begins[first]
    if symbols.dtype == np.uint8:
        labels, values = _tossed(symbols, marks), symbols.astype(np.uint64)
    else:
        labels, values = np.empty(len(symbols), np.uint8), symbols.copy()
        labels[1:] = _coin(symbols[1:], symbols[:-1])
        labels[marks] = _MARK
        labels = _tossed(labels, marks)
    for _ in range(_ROUNDS - 1):
        labels = _tossed(labels, marks)
    labels += np.uint8(1)  # marks are lowest now
    rise = labels[1:] > labels[:-1]
    start = np.zeros(len(symbols), bool)
    start[1:-1] = rise[:-1] & ~rise[1:]
    start[marks], start[marks[:-1] + 1] = True, True
    at = np.flatnonzero(start)
    if runs is not None:
        values += (runs - 1).astype(np.uint64) * _GOLD
    size = np.diff(at, append=len(symbols))
    names = mix(_polynomials(values, at, size) + size.astype(np.uint64) * _GOLD)
    marks = np.searchsorted(at, marks)
    names[marks] = 0
    return Level(names, marks, None if begins is None else begins[at])


def parse(texts: list[bytes], levels: int = LEVELS, begins: bool = False) -> Iterator[Level]:
    """The levels of phrases of the texts, shortest phrases first; no phrase crosses texts."""
    mark = bytes([_MARK])
    symbols = np.frombuffer(mark + b"".join(x + mark for x in texts), np.uint8)
    ends = np.cumsum([0, *(len(x) + 1 for x in texts)])
    level = Level(symbols, ends, np.arange(len(symbols)) if begins else None)
    for _ in range(levels):
        level = _cut(level)
        yield level


def _sketch(level: Level) -> np.ndarray:
    """texts x BINS of one level; the second and later phrases of one name in a text count as names of their own."""
    counts = np.diff(level.marks) - 1
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    # The text, then 48 bits of the name: sorted, equal names of a text stand together.
    key = np.sort((text << np.uint64(48)) | (np.delete(level.names, level.marks) >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    again = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
    names = mix((key & np.uint64((1 << 48) - 1)) + again.astype(np.uint64) * _GOLD)
    least = np.full(len(counts) * BINS, 65536, np.int64)
    np.minimum.at(least, (text * np.uint64(BINS) + (names & np.uint64(BINS - 1))).astype(np.int64), np.maximum(names >> np.uint64(48), np.uint64(1)).astype(np.int64))
    least[least == 65536] = 0
    return least.reshape(-1, BINS)


def sketches(texts: list[bytes]) -> np.ndarray:
    """texts x LEVELS x BINS: of the names in each bin the least upper 16 bits, at least 1; 0 in an empty bin."""
    out = np.zeros((len(texts), LEVELS, BINS), np.uint16)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and to - at < 65536 and (to == at or size + len(texts[to]) <= PARSE_BYTES):
            size, to = size + len(texts[to]), to + 1
        for k, level in enumerate(parse(texts[at:to])):
            out[at:to, k] = _sketch(level)
        at = to
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common phrases (twice the common ones over the sum of both) of rows of sketches, 0 to 1.

    Equal fingerprints, those of two empty texts among them, have likeness 1; an empty text has 0 with any other.
    """
    filled = lambda x: (x > 0).sum(2)
    good = (filled(a) >= ENOUGH) & (filled(b) >= ENOUGH)
    k = np.where(good.any(1), LEVELS - 1 - np.argmax(good[:, ::-1], axis=1), 0)
    row = np.arange(len(a))
    x, y = a[row, k], b[row, k]
    either = ((x > 0) | (y > 0)).sum(1)
    share = ((x == y) & (x > 0)).sum(1) / np.maximum(either, 1)
    return np.where((a == b).all((1, 2)), 1.0, 2 * share / (1 + share))


def as_text(sketch: np.ndarray) -> list[str]:
    return [base64.b64encode(x.astype("<u2").tobytes()).decode() for x in sketch]


def from_text(fingerprints: list[str]) -> np.ndarray:
    return np.array([np.frombuffer(base64.b64decode(x), "<u2") for x in fingerprints], np.uint16).reshape(-1, LEVELS, BINS)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, fingerprint for every row of ``docs``, without a shuffle.

    Equal texts have equal fingerprints; null texts are empty, empty texts have a fingerprint of empty bins. Texts of
    any length are parsed whole; null ids and repeated rows stay; other columns, whatever their names, are not
    read; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                own = sketches([x.encode() for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(as_text(own), pa.string())], names=["id", "n_chars", "fingerprint"])

    rows = _rows(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    return rows.mapInArrow(run, f"id {id_type}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def phrases(docs: DataFrame, level: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, name, start, size (bytes) of every phrase of a level (from 1) of every text; null and empty texts have none."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = list(parse([batch.column(1)[at].as_py().encode()], level, begins=True))[-1]
                index = np.delete(np.arange(len(found.names)), found.marks)
                ids = pa.array([batch.column(0)[at].as_py()] * len(index), batch.schema.field(0).type)
                sizes = np.diff(found.begins)[index]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.names[index].astype(np.int64)), pa.array(found.begins[index] - 1), pa.array(sizes)], names=["id", "name", "start", "size"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, name long, start long, size long").withColumnRenamed("id", id_col)


def _range(value: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at most ``value`` (null: none), by binary search."""
    if not cuts:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(known, n + step - 1) <= value, n + step).otherwise(n))


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, last, id, text: rows in id order within their partition, each bucket closed by a copy of the row behind it.

    Buckets are ranges of ids of about equal numbers of rows. Of each only the first row is known to all, so the texts
    move once. Behind the last bucket comes the first row of all.
    """
    rows = _rows(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = int(max(1, min(MOST_RANGES, (size or 0) // RANGE_BYTES, n)))
    cuts = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 20_000)).first()[0] if parts > 1 else []
    rows = rows.withColumn("bucket", _range(F.col("id"), sorted(set(cuts or []))))
    firsts = sorted(rows.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("f")).collect())  # a row a bucket
    behind = [(b["bucket"], firsts[(k + 1) % len(firsts)]["f"]["id"], firsts[(k + 1) % len(firsts)]["f"]["h"]) for k, b in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    behind = docs.sparkSession.createDataFrame(behind, f"own int, first_id {kind}, first_h long")
    closing = rows.join(F.broadcast(behind), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))  # MOST_RANGES rows at most
    closing = closing.dropDuplicates(["own"]).select(F.col("own").alias("bucket"), F.lit(1).alias("last"), "id", "h", "text")
    both = rows.select("bucket", F.lit(0).alias("last"), "id", "h", "text").unionByName(closing)
    return both.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "last", "id", "h").select("bucket", "last", "id", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Every text against an edited copy and against the next document.

    ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has
    the last n_chars div ``part`` code points replaced by the first as many of the next document, or all it has. Documents
    ascend by ``id_col`` (an integer), null ids first, rows of one id by the hash of their text, and behind the last comes the
    first; a lone document follows itself. Null texts are empty; repeated rows follow each other; an empty table
    gives an empty result. Texts of any length are compared whole; other columns, whatever their names, are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, last, own = [], [], [], np.zeros((0, LEVELS, BINS), np.uint16)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                added = rows.column(3).to_pylist()
                ids, texts, last = ids + rows.column(2).to_pylist(), texts + added, last + rows.column(1).to_pylist()
                own = np.concatenate([own, sketches([x.encode() for x in added])])
                done = [k for k in range(len(texts) - 1) if not last[k]]
                cut = [len(texts[k]) - len(texts[k]) // part for k in done]
                edited = [(texts[k][:c] + texts[k + 1][: len(texts[k]) - c]).encode() for k, c in zip(done, cut, strict=True)]
                new, k = sketches(edited), np.array(done, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in done], batch.schema.field(2).type),
                        pa.array([len(texts[k]) for k in done], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                        pa.array(as_text(own[k]), pa.string()),
                        pa.array(as_text(new), pa.string()),
                        pa.array(likeness(own[k], new), pa.float64()),
                        pa.array(likeness(own[k], own[k + 1]), pa.float64()),
                    ],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                ids, texts, last, own = ids[-1:], texts[-1:], last[-1:], own[-1:]

    schema = f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
