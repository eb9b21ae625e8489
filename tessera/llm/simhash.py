"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that go together are grouped into partitions; each partition p gets a threshold t_p so that the
sum of (t_p + 1) is radius + 1. Two fingerprints within the radius then differ by at most t_p bits in
some partition p. The thresholds are chosen by dynamic programming on estimated candidate counts;
they only decide the cost, every choice finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shared import HEAVY_ROWS, broadcast_if_small, join_unique, materialise, materialise_counted
from tessera.operators.components import components

from .common import SLICE_ROWS

BITS, SEED = 64, 42
#: Fingerprints in the sample from which candidate counts are estimated.
SAMPLE = 2048
#: Keys with more fingerprints are compared in blocks of this many by this many.
BLOCK = 1024


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash of the ``width``-word shingles (repeats included) of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[:-width], starts[width:], strict=True)]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``fp`` (64 bits in a signed long); null or wordless texts give 0."""
    rows = docs.withColumn("fp", F.col(text_col).cast("string"))
    rows = rows.select(*(c for c in docs.columns if c != text_col), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                fps = np.array([fingerprint(x, width) for x in part.column(part.num_columns - 1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps.view(np.int64))], names=part.schema.names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def partition_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into ``m`` equal partitions so that correlated bits meet."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    with np.errstate(all="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(float)))) if len(sample) > 2 else np.zeros((BITS, BITS))
    left, out = list(range(BITS)), []
    for p in range(m):
        size = BITS // m + (p < BITS % m)
        own = [max(left, key=lambda b: (corr[b][left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (corr[b][own].mean(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def allocate(sample: np.ndarray, rows: int, radius: int) -> list[tuple[list[int], int]]:
    """Partitions (their bits) with thresholds of least estimated cost; -1 leaves a partition unused.

    The cost of a threshold is the number of probes it makes plus the candidate pairs that it is
    expected to give, from pairs of the sample and, where those are too few to tell, from the share of
    all keys that the probes cover.
    """
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, radius + 2):
        parts = partition_bits(sample, m)
        cost = []
        for bits in parts:
            mask = np.uint64(sum(1 << b for b in bits))
            near = np.bitwise_count((sample[:, None] ^ sample[None, :]) & mask)
            counts = (np.bincount(near.ravel(), minlength=BITS + 1).cumsum() - len(sample)) / max(1, len(sample) * (len(sample) - 1))
            row = [0.0]
            for t in range(radius + 1):
                ball = sum(comb(len(bits), k) for k in range(t + 1))
                share = max(float(counts[t]), ball / 2.0 ** len(bits))
                row.append(rows * ball + share * rows * rows / 2)
            cost.append(row)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, chosen) in table.items():
                for more in range(radius + 2 - used):
                    if used + more not in step or c + row[more] < step[used + more][0]:
                        step[used + more] = (c + row[more], [*chosen, more - 1])
            table = step
        if table[radius + 1][0] < best[0]:
            best = (table[radius + 1][0], list(zip(parts, table[radius + 1][1], strict=True)))
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(bits: list[int], t: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]


def _flipped(p: int, own: Column):
    return lambda mask: F.struct(F.lit(p).alias("p"), own.bitwiseXOR(mask).alias("key"))


def _keys(fps: DataFrame, plan: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    keys = []
    for p, (bits, t) in enumerate(plan):
        if t < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        if probe and t:
            flips = F.array(*(F.lit(m) for m in _masks(bits, t)))
            keys.append(F.transform(flips, _flipped(p, own)))
        else:
            keys.append(F.array(F.struct(F.lit(p).alias("p"), own.alias("key"))))
    return fps.select("fp", F.inline(F.concat(*keys)))


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a block's links as (row, column) pairs."""
    rows, cols = pairs.shape
    new_row, new_col, out = np.ones(rows, bool), np.ones(cols, bool), []
    for start in range(rows):
        if not new_row[start]:
            continue
        new_row[start] = False
        todo = [(True, start)]
        while todo:
            is_row, k = todo.pop()
            if is_row:
                found = np.flatnonzero(pairs[k] & new_col)
                new_col[found] = False
                out += [(k, int(x)) for x in found]
            else:
                found = np.flatnonzero(pairs[:, k] & new_row)
                new_row[found] = False
                out += [(int(x), k) for x in found]
            todo += [(not is_row, int(x)) for x in found]
    return out


def _block_links(radius: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = (x["fp"].drop_duplicates().to_numpy().astype(np.int64).view(np.uint64) for x in (left, right))
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        out = _forest(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        return pd.DataFrame({"a": [a[i] for i, _ in out], "b": [b[j] for _, j in out]}, dtype=np.uint64).astype(np.int64)

    return run


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius``.

    Keys shared by few fingerprints are joined. A key with more than BLOCK of them (a dense group of
    near copies) is compared block by block, and a block gives only a spanning forest of its links, so
    no group is gathered in one task and no group gives all its pairs.
    """
    count = fps.count()
    sample = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    plan = allocate(sample, max(1, count), radius)
    data, probes = _keys(fps, plan, False), _keys(fps, plan, True)
    sizes, n_hot = materialise_counted(data.groupBy("p", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK))
    close = F.expr(f"bit_count(l.fp ^ r.fp) <= {radius} AND l.fp < r.fp")

    def near(data: DataFrame) -> DataFrame:
        # Hinted: Spark takes the probes for as small as the fingerprints they are made of, and would broadcast them.
        both = data.alias("l").hint("merge").join(probes.alias("r"), ["p", "key"])
        return both.filter(close).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))

    if not n_hot:
        return near(data)
    hot = broadcast_if_small(sizes, n_hot, 100_000)
    few = data.join(hot, ["p", "key"], "left_anti")
    out = near(few)
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    wide = F.greatest(F.lit(1), F.ceil(F.col("n") * max(len(_masks(b, t)) for b, t in plan if t >= 0) / BLOCK)).cast("int")
    both = {"x": chunks, "y": F.least(wide, chunks * 64)}
    spread = lambda df, own, other: (
        df.join(hot, ["p", "key"])
        .withColumns(both)
        .withColumn(own, F.pmod(F.xxhash64("fp"), F.col(own)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    )
    group = ["p", "key", "x", "y"]
    left, right = (spread(df, *at).select(*group, "fp").toDF(*group, "fp").groupBy(*group) for df, at in ((data, ("x", "y")), (probes, ("y", "x"))))
    return out.unionByName(left.cogroup(right).applyInPandas(_block_links(radius), "a long, b long"))


def _roots(nodes: DataFrame, radius: int) -> DataFrame:
    """fp, root: the smallest ``node`` of each fingerprint's component; ``nodes`` has fp and node, both unique."""
    pairs = links(nodes.select("fp"), radius)
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("fp").alias(side), F.col("node").alias(f"{side}_node")), side)
    roots = components(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return nodes.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, width: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``fp``, ``component_id`` (smallest id linked to it, itself included).

    Equal fingerprints are one node, so copies are never paired, and a fingerprint of very many rows stays
    where its rows are. Null and empty texts have fingerprint 0 and are linked like any other; texts of any
    length are read whole. Repeated rows are kept; a component of null ids only has a null component_id.
    Other columns are not read. An empty table gives an empty result.
    """
    found = materialise(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), width))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
    nodes = materialise(found.groupBy("fp").agg(F.min(first).alias("node"), F.count(F.lit(1)).alias("n")))
    owner = materialise(_roots(nodes, radius).select("fp", "n", F.col("root.id").alias("component_id")))
    out = join_unique(found, owner.drop("n"), "fp", owner.filter(F.col("n") > HEAVY_ROWS))
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, width: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, of each component: that with the smallest id, null ids last.

    Rows count one by one, so different texts under one id each stand for their own component; of rows that
    repeat an id in a component the first written stays. Null and empty texts are one component. Columns
    of any name stay as they are; texts of any length are read whole; an empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = materialise(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    id_, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    found = materialise(fingerprints(rows.select("row", F.col(id_).alias("id"), F.col(text).alias("text")), width))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = materialise(found.groupBy("fp").agg(F.min(first).alias("node"), F.count(F.lit(1)).alias("n")))
    stay = _roots(nodes, radius).select(F.col("root.row").alias("row")).distinct()
    return rows.join(stay, "row", "left_semi").select(*names).toDF(*docs.columns)
