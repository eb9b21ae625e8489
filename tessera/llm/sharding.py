"""Shards of near equal bytes by histogram sort, with DataFrame operations only.

Rows are ordered by integer keys. The bytes below candidate boundaries are counted exactly over all
partitions, the interval that holds each wanted splitter is divided again, until every splitter meets
the tolerance or no finer boundary exists; then the rows move once, already sorted by range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialise

#: Boundaries tried at once within an interval.
BINS = 256
#: Keys are below this, so that differences of two keys fit a long.
KEY_LIMIT = 1 << 62


def hash_key(col: Column | str) -> Column:
    """A key in [0, KEY_LIMIT) that spreads any column; equal values share it, null has its own."""
    return F.shiftrightunsigned(F.xxhash64(col), 2)


@dataclass
class _Splitter:
    target: float
    below: int = 0
    fixed: list[int] = field(default_factory=list)
    low: int = 0
    high: int = KEY_LIMIT
    cut: list[int] | None = None

    @property
    def interval(self) -> tuple:
        return (*self.fixed, self.low, self.high)


def _histograms(rows: DataFrame, keys: list[str], open_: list[_Splitter]) -> dict[tuple, dict[int, int]]:
    """Bytes in each bin of each open interval; at most BINS numbers an interval reach the driver."""
    intervals = list(dict.fromkeys(s.interval for s in open_))
    number, offset = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (*fixed, low, high) in enumerate(intervals):
        level = keys[len(fixed)]
        inside = (F.col(level) >= low) & (F.col(level) < high)
        for k, v in zip(keys, fixed, strict=False):
            inside = inside & (F.col(k) == v)
        step = max(1, -(-(high - low) // BINS))
        number = F.when(inside, i).otherwise(number)
        offset = F.when(inside, F.expr(f"({level} - {low}L) div {step}L")).otherwise(offset)
    found = rows.select(number.alias("i"), offset.alias("bin"), "size").filter("i IS NOT NULL").groupBy("i", "bin").agg(F.sum("size").alias("size"))
    out: dict[tuple, dict[int, int]] = {x: {} for x in intervals}
    for r in found.collect():
        out[intervals[r["i"]]][r["bin"]] = r["size"]
    return out


def splitters(rows: DataFrame, keys: list[str], shards: int, tolerance: float) -> list[list[int]]:
    """Composite boundaries (prefixes of the keys); shard i holds rows from boundary i-1 to before i.

    ``rows`` has ``size`` and the long columns ``keys``, each in [0, KEY_LIMIT), whose combination is
    unique. A boundary between different first keys is taken when it is within ``tolerance`` (a share of
    a shard's mean bytes) of the ideal place; else the group at that place is divided by the next key.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    allowed = tolerance * total / shards
    wanted = [_Splitter(total * (i + 1) / shards) for i in range(shards - 1)]
    while open_ := [s for s in wanted if s.cut is None]:
        found = _histograms(rows, keys, open_)
        for s in open_:
            step = max(1, -(-(s.high - s.low) // BINS))
            edge, below = s.low, s.below
            for b in sorted(found[s.interval]):
                size = found[s.interval][b]
                if below + size >= s.target:
                    edge = s.low + b * step
                    break
                below += size
            else:  # nothing is left at or beyond the target
                s.cut = [*s.fixed, s.high]
                continue
            end = min(edge + step, s.high)
            near, miss = min((([*s.fixed, edge], s.target - below), ([*s.fixed, end], below + size - s.target)), key=lambda x: x[1])
            if miss <= allowed or (step == 1 and len(s.fixed) + 1 == len(keys)):
                s.cut = near
            elif step == 1:
                s.fixed, s.low, s.high, s.below = [*s.fixed, edge], 0, KEY_LIMIT, below
            else:
                s.low, s.high, s.below = edge, end, below
    return [s.cut for s in wanted]


def _at_or_beyond(keys: list[str], cut: list[int]) -> Column:
    out = F.lit(True)
    for k, v in reversed(list(zip(keys, cut, strict=False))):
        out = (F.col(k) > v) | ((F.col(k) == v) & out)
    return out


def byte_balanced(docs: DataFrame, shards: int, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, shard, slot for every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1 (null: 1); a null text has checksum 0 like an empty one. Rows
    are ordered by the hash of the text, so that equal texts stay in one shard wherever the tolerance
    allows it, then by the hash of the id, then by place in the input; a text on a third of all rows is
    divided by the later keys. ``slot`` counts from 0 without gaps within each shard, in that order.
    Repeated rows each get a slot of their own; an empty table gives an empty result.
    """
    keys = ["k_text", "k_id", "k_row"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            hash_key(text).alias("k_text"),
            hash_key(F.col(id_col)).alias("k_id"),
            F.monotonically_increasing_id().alias("k_row"),
        )
    )
    shard = F.lit(0)
    for cut in splitters(rows, keys, shards, tolerance):
        shard = shard + _at_or_beyond(keys, cut).cast("int")
    order = ["shard", *keys]
    dealt = rows.withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id's upper bits are the partition, its lower 33 bits count the partition's rows.
    dealt = materialise(dealt.select("id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("place")))
    part = F.shiftright("place", 33).alias("part")
    pieces = dealt.groupBy("shard", part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # A piece is one shard's rows in one partition: at most partitions + shards of them.
    known, before, starts = pieces.orderBy("shard", "part").collect(), {}, []
    for p in known:
        starts.append((p["shard"], p["part"], p["first"] - before.get(p["shard"], 0)))
        before[p["shard"]] = before.get(p["shard"], 0) + p["n"]
    base = docs.sparkSession.createDataFrame(starts, "shard int, part long, base long")
    return (
        dealt.withColumn("part", part)
        .join(F.broadcast(base), ["shard", "part"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("base")).alias("slot"))
    )
