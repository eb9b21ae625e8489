"""Removal of long repeats by run-length indexes over content-defined blocks.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.

1. Every string of LENGTH bytes has an anchor: the KMER bytes of least hash among its own, the first of
   them in a tie. Equal strings have equal anchors, so only strings whose anchor stands in two documents
   can repeat. The strings in a row with one anchor make a piece of LENGTH to LENGTH + SPAN - 1 bytes.
   Batches of rows exchange the hashes of their anchors, packed by range of hashes, and each is told
   which of its own stand elsewhere as well. This is a filter only.
2. Each batch sends its distinct pieces with such anchors, with the least id that holds them, to the block
   of the anchor. An anchor of more than HOT_PIECES documents would gather them in one block: its pieces
   are cut into single strings, and each string has an anchor and a block of its own.
3. In a block the first piece (least id) of each anchor goes into a run-length index (``RunIndex``).
   The other pieces are streamed against it; a matching statistic of LENGTH or more marks a string as
   one that a smaller id holds. Strings that no first piece holds are indexed together, and the places of
   equal ones are found from the samples at the heads of the runs.
4. Each batch gets the marks of its pieces and cuts the bytes that they cover.

Nothing is broadcast, every message is bounded by a batch's or a block's own text, and no message is
addressed to a text, a passage or an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import discard, materialise
from .run_index import FINISH, FIRST, STOP, RunIndex

LENGTH = 50
KMER = 24
#: Anchor candidates in a string of LENGTH bytes, and so the most strings in a piece.
SPAN = LENGTH - KMER + 1
#: Rows of a batch are two to the power of this.
BATCH_BITS = 9
#: String starts that are searched for anchors at once; their numbers must fit in 16 bits.
SEGMENT = (1 << 16) - 2 * LENGTH
#: Bytes of text whose anchors meet in one range of hashes, bytes of pieces in a block, bytes indexed together.
RANGE_BYTES, BLOCK_BYTES, INDEX_BYTES = 1 << 23, 1 << 22, 1 << 19
#: Anchors of more documents than this are cut into their strings.
HOT_PIECES = 1 << 14
#: Partitions of an exchange between batches and blocks; each takes several blocks one after another.
MOST_PARTITIONS = 20_000
_HASH_BITS = 48
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MASK16 = np.uint64(0xFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - KMER + 1
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.zeros(n, np.uint64)
    for at in range(0, KMER, 8):
        out += eight[at : at + n]
        out *= _MULTIPLIER
        out ^= out >> np.uint64(29)
    return _mixed(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of strings, anchor (48 bits) and digest (64 bits) of the pieces of concatenated texts.

    ``ends`` are the ends of the texts in ``data``. A piece is the longest run of strings of LENGTH bytes
    with one anchor; at the borders of the segments that are searched at once it may be cut in two.
    """
    found = []
    for lo in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[lo : lo + SEGMENT + LENGTH - 1]
        n = len(part) - LENGTH + 1
        hashes = _kmer_hashes(part)
        marked = (hashes & ~_MASK16) | np.arange(len(hashes), dtype=np.uint64)
        anchor = _least(marked, SPAN)[:n]
        near = ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, lo + n + LENGTH)] - lo
        over = np.zeros(n + 1, np.int32)
        np.add.at(over, np.clip(near - LENGTH + 1, 0, n), 1)
        np.add.at(over, np.clip(near, 0, n), -1)
        label = np.where(np.cumsum(over[:n]) > 0, np.int64(-1), (anchor & _MASK16).astype(np.int64))
        starts = np.flatnonzero(np.diff(label, prepend=-2) != 0)
        count = np.diff(starts, append=n)
        inside = label[starts] >= 0
        starts, count = starts[inside], count[inside]
        # Anchors are least hashes, so small; hashed once more they are spread evenly over the ranges.
        key = _mixed((anchor[starts] | _MASK16) * _MULTIPLIER) >> np.uint64(64 - _HASH_BITS)
        found.append((lo + starts, count, key, _digests(hashes, starts, count)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _digests(hashes: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64 bits of each piece, from the hashes of KMER bytes that cover it."""
    last = starts + count - 1 + LENGTH - KMER
    out = count.astype(np.uint64)
    for at in (starts, starts + KMER, np.minimum(starts + 2 * KMER, last), last):
        out = _mixed((out ^ hashes[at]) * _MULTIPLIER)
    return out


def _planes(values: np.ndarray, width: int = 8) -> bytes:
    """The ``width`` low bytes of numbers, byte place by byte place, so that equal high bytes compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes one after another, and the ends of its texts in them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    edges = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (data[edges[0] : edges[-1]], edges[1:] - edges[0]) if len(column) else (np.zeros(0, np.uint8), np.zeros(0, np.int64))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, written: batch, seq (in the batch), size in bytes, id, text, nothing (it was null), c0, c1, ... for the other columns."""
    number = F.monotonically_increasing_id()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(number.alias("number"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.col(text_col).isNull().alias("nothing"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col))
    batch, seq = F.shiftright("number", BATCH_BITS), F.col("number").bitwiseAND((1 << BATCH_BITS) - 1).cast("int")
    return materialise(rows.select(batch.alias("batch"), seq.alias("seq"), F.octet_length("text").cast("long").alias("size"), *rows.columns[1:]))


def _ranges(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that ascending keys fall into, and the places where each of these begins and ends."""
    bucket = (((keys >> np.uint64(_HASH_BITS - 32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=n_buckets))
    return bucket[edges[:-1]], edges


def _n_buckets(size: int | None, each: int) -> int:
    return int(min((size or 0) // each + 1, (1 << 31) - 1))


def _in_order(df: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of a bucket together in one partition, whose buckets follow each other."""
    parts = min(n_buckets, MOST_PARTITIONS)
    return df.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _heard(rows: DataFrame, hot_pieces: int) -> DataFrame:
    """batch, keys, hot, n: for each batch its anchors that stand in two documents, and which of them are hot; n rows in all documents."""
    n_buckets = _n_buckets(rows.agg(F.sum("size")).first()[0], RANGE_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            numbers = whole.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                data, ends = _texts(whole.column(1).slice(lo, hi - lo))
                start, _, key, _ = pieces(data, ends)
                both = np.unique((key << np.uint64(16)) | np.searchsorted(ends, start, side="right").astype(np.uint64))
                keys, docs = np.unique(both >> np.uint64(16), return_counts=True)
                if len(keys):
                    bucket, edges = _ranges(keys, n_buckets)
                    parts = list(zip(edges[:-1], edges[1:], strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "batch": pa.array(np.full(len(bucket), numbers[lo])),
                            "bucket": pa.array(bucket.astype(np.int32)),
                            "keys": pa.array([_planes(np.diff(keys[a:b], prepend=np.uint64(0)), 6) for a, b in parts], pa.binary()),
                            "docs": pa.array([_planes(docs[a:b], 2) for a, b in parts], pa.binary()),
                        }
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            each = [np.cumsum(_numbers(r["keys"], 6)) for r in held]
            all_keys, inverse = np.unique(np.concatenate(each), return_inverse=True)
            docs = np.bincount(inverse, np.concatenate([_numbers(r["docs"], 2) for r in held]), len(all_keys))
            out, at = [], 0
            for row, keys in zip(held, each, strict=True):
                total = docs[inverse[at : at + len(keys)]]
                at += len(keys)
                again = total > 1
                if again.any():
                    out.append((row["batch"], keys[again].tobytes(), np.packbits(total[again] > hot_pieces).tobytes(), int(_numbers(row["docs"], 2)[again].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["batch", "keys", "hot", "n"])

    sent = rows.select("batch", "text").mapInArrow(send, "batch long, bucket int, keys binary, docs binary")
    return materialise(_in_order(sent, n_buckets).mapInArrow(meet, "batch long, keys binary, hot binary, n long"))


def _cut(data: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, digest: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces, those that are hot as single strings with the digest of the string as their key."""
    if not hot.any():
        return start, count, key, digest
    places = np.repeat(start[hot], count[hot]) + _along(count[hot])
    ones = np.ones(len(places), np.int64)
    out = []
    for lo in range(0, len(places), SEGMENT):
        strings = data[places[lo : lo + SEGMENT, None] + np.arange(LENGTH)].ravel()
        out.append(_digests(_kmer_hashes(strings), np.arange(len(strings) // LENGTH) * LENGTH, ones[lo : lo + SEGMENT]))
    own = np.concatenate(out)
    cold = ~hot
    return tuple(np.concatenate([x[cold], y]) for x, y in ((start, places), (count, ones), (key, own >> np.uint64(64 - _HASH_BITS)), (digest, own)))


def _along(count: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _sent(rows: DataFrame, heard: DataFrame, n_buckets: int) -> DataFrame:
    """What each batch sends to each block (bucket >= 0), and what it notes for itself (bucket -1).

    To a block: keys, owners (least id, above ``base``), places (in the batch's text) and counts of the
    batch's distinct pieces, and their text. For itself: places and counts of strings that a smaller id of
    the same batch holds; keys and owners are then places of a piece and of another one of the same id that is equal.
    """
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("text", pa.binary())])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("seq").combine_chunks()
        if not right.num_rows or not left.num_rows:
            return schema.empty_table()
        data, ends = _texts(left.column("text"))
        ids = left.column("id").to_numpy()
        start, count, key, digest = pieces(data, ends)
        known = np.concatenate([np.frombuffer(x, "<u8") for x in right.column("keys").to_pylist()])
        hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=len(k) // 8) for k, h in zip(right.column("keys").to_pylist(), right.column("hot").to_pylist(), strict=True)])
        by = np.argsort(known)
        known, hot = known[by], hot[by]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        near = known[at] == key
        start, count, key, digest = _cut(data, start[near], count[near], key[near], digest[near], hot[at[near]] == 1)
        own = ids[np.searchsorted(ends, start, side="right")]
        # Equal pieces: the first place of the least id goes out; a larger id is settled here.
        by = np.lexsort((start, own, digest))
        start, count, key, digest, own = (x[by] for x in (start, count, key, digest, own))
        first = np.flatnonzero(np.diff(digest, prepend=~digest[:1]) != 0)
        least = np.repeat(first, np.diff(first, append=len(digest)))
        later, alias = own > own[least], (own == own[least]) & (np.arange(len(own)) != least)
        hits = np.zeros(len(data) + 1, np.int32)
        np.add.at(hits, start[later], 1)
        np.add.at(hits, start[later] + count[later], -1)
        edges = np.flatnonzero(np.diff(np.cumsum(hits) > 0, prepend=False))
        out = [{"batch": left.column("batch")[0].as_py(), "bucket": -1, "base": 0, "places": edges[::2].tobytes(), "counts": (edges[1::2] - edges[::2]).tobytes(), "keys": start[least[alias]].tobytes(), "owners": start[alias].tobytes(), "text": None}]
        by = first[np.argsort(key[first], kind="stable")]
        bucket, edges = _ranges(key[by], n_buckets)
        base = int(ids.min())
        for b, lo, hi in zip(bucket.tolist(), edges[:-1], edges[1:], strict=True):
            k = by[lo:hi]
            size = count[k] + LENGTH - 1
            text = data[np.repeat(start[k], size) + _along(size)]
            more = {"keys": _planes(np.diff(key[k], prepend=np.uint64(0)), 6), "owners": _planes(own[k] - base), "places": _planes(start[k], 6), "counts": _planes(count[k], 1), "text": text.tobytes()}
            out.append({"batch": out[0]["batch"], "bucket": b, "base": base} | more)
        return pa.Table.from_pylist(out, schema)

    texts = rows.select("batch", "seq", "id", "text")
    told = texts.groupBy("batch").cogroup(heard.select("batch", "keys", "hot").groupBy("batch"))
    return materialise(told.applyInArrow(send, "batch long, bucket int, base long, keys binary, owners binary, places binary, counts binary, text binary"))


def _polynomials(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each string: a polynomial of its bytes modulo 2**64, from the sums of all bytes before."""
    base = int(_MULTIPLIER)
    powers = np.cumprod(np.full(len(text) + 1, base, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text + np.uint64(1)) * powers[:-1])])
    inverse = np.uint64(pow(base, -1, 1 << 64))
    back = np.cumprod(np.full(len(text) + 1, inverse, np.uint64))
    return _mixed((sums[start + size] - sums[start]) * back[start])


def _joined(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the strings, each followed by STOP, with FINISH behind the last, and the strings' ends in them."""
    ends = np.cumsum(size + 1) - 1
    out = np.full(int(ends[-1]) + 2 if len(ends) else 1, STOP, np.uint16)
    out[-1] = FINISH
    out[np.repeat(ends - size, size) + _along(size)] = text[np.repeat(start, size) + _along(size)].astype(np.uint16) + FIRST
    return out, ends


def _blocks(group: np.ndarray, size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ascending groups, cut between groups as soon as a slice has ``most`` bytes."""
    lo, total = 0, np.cumsum(size)
    edges = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    while lo < len(group):
        hi = edges[np.searchsorted(edges, np.searchsorted(total, (total[lo - 1] if lo else 0) + most) + 1).clip(max=len(edges) - 1)]
        yield slice(lo, int(hi))
        lo = int(hi)


def marked(key: np.ndarray, owner: np.ndarray, text: np.ndarray, count: np.ndarray, index_bytes: int) -> np.ndarray:
    """For each piece a mask of its strings (bit i: the i-th) that also stand in a piece of a smaller owner.

    Pieces lie in ``text`` one after another; equal strings are in pieces with equal keys.
    """
    size = count + LENGTH - 1
    start = np.cumsum(size) - size
    # Distinct pieces, in order of key, digest and owner; each is indexed or streamed once, for its least owner.
    digest = _polynomials(text, start, size)
    by = np.lexsort((owner, digest, key))
    new = (np.diff(key[by], prepend=~key[by[:1]]) != 0) | (np.diff(digest[by], prepend=~digest[by[:1]]) != 0)
    first = by[np.flatnonzero(new)]
    own = first[np.cumsum(new) - 1]  # of by, the first piece that is equal
    full = (np.uint32(1) << count.astype(np.uint32)) - np.uint32(1)
    # Of each key with several distinct pieces: the one with the least owner, and the others.
    some = first[np.lexsort((owner[first], key[first]))]
    leads = np.diff(key[some], prepend=~key[some[:1]]) != 0
    several = np.bincount(np.cumsum(leads) - 1, minlength=1)[np.cumsum(leads) - 1] > 1
    some, leads = some[several], leads[several]
    group = np.cumsum(leads)
    settled, smaller = np.zeros(len(key), np.uint32), np.zeros(len(key), np.uint32)
    for block in _blocks(group, size[some], 2 * index_bytes):
        head, rest = some[block][leads[block]], some[block][~leads[block]]
        indexed, ends = _joined(text, start[head], size[head])
        index = RunIndex(indexed)
        streamed, rest_ends = _joined(text, start[rest], size[rest])
        for which, back, place in index.matches(streamed, rest_ends, size[rest], LENGTH):
            hit = rest[which]
            bit = np.uint32(1) << (size[hit] - back).astype(np.uint32)
            settled[hit] |= bit
            smaller[hit] |= np.where(owner[head[np.searchsorted(ends, place, side="right")]] < owner[hit], bit, np.uint32(0))
    # What no first piece holds: runs of strings, indexed together where their key has two or more.
    rest = some[~leads]
    left = (full[rest] & ~settled[rest])[:, None] >> np.arange(SPAN + 1, dtype=np.uint32) & np.uint32(1)
    step = np.diff(left.astype(np.int8), axis=1, prepend=0)
    which, at = np.nonzero(step == 1)
    length = np.nonzero(step == -1)[1] - at
    part = rest[which]
    grouped = np.unique(key[part], return_inverse=True)[1]
    again = np.bincount(grouped, minlength=1)[grouped] > 1
    part, at, length = part[again], at[again], length[again]
    for block in _blocks(grouped[again], length + LENGTH - 1, index_bytes):
        piece, shift, n = part[block], at[block], length[block]
        indexed, ends = _joined(text, start[piece] + shift, n + LENGTH - 1)
        place, same = RunIndex(indexed).classes(LENGTH)
        which = np.searchsorted(ends, place, side="right")
        inside = which < len(piece)
        place, same, which = place[inside], same[inside], which[inside]
        inside = ends[which] - place >= LENGTH
        place, same, which = place[inside], same[inside], which[inside]
        holder = owner[piece[which]]
        least = np.full(len(indexed), np.iinfo(np.int64).max)
        np.minimum.at(least, same, holder)
        hit = least[same] < holder
        bit = np.uint32(1) << (shift[which] + place - (ends[which] - n[which] - LENGTH + 1))[hit].astype(np.uint32)
        np.bitwise_or.at(smaller, piece[which[hit]], bit)
    out = np.zeros(len(key), np.uint32)
    out[by] = np.where(owner[by] > owner[own], full[by], smaller[own])
    return out


def _told(sent: DataFrame, n_buckets: int, index_bytes: int) -> DataFrame:
    """batch, places, masks: the pieces of each batch with strings that a smaller id holds."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            key = np.concatenate([np.cumsum(_numbers(r["keys"], 6)) for r in held])
            owner = np.concatenate([_numbers(r["owners"]).view(np.int64) + r["base"] for r in held])
            count = np.concatenate([_numbers(r["counts"], 1) for r in held]).astype(np.int64)
            text = np.frombuffer(b"".join(r["text"] for r in held), np.uint8)
            mask = marked(key, owner, text, count, index_bytes)
            ends = np.cumsum([len(r["counts"]) for r in held])
            out: list[list] = [[], [], []]
            for row, own in zip(held, np.split(mask, ends[:-1]), strict=True):
                if own.any():
                    for column, value in zip(out, (row["batch"], _numbers(row["places"], 6)[own > 0].tobytes(), own[own > 0].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["batch", "places", "masks"])

    to_blocks = _in_order(sent.filter("bucket >= 0"), n_buckets)
    return to_blocks.mapInArrow(settle, "batch long, places binary, masks binary")


def _notes(docs: DataFrame, id_col: str, text_col: str, hot_pieces: int, block_bytes: int, index_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and all that was found for each batch of them."""
    rows = _numbered(docs, id_col, text_col)
    known = rows.filter("id IS NOT NULL")
    heard = _heard(known, hot_pieces)
    n_buckets = _n_buckets((heard.agg(F.sum("n")).first()[0] or 0) * (LENGTH + SPAN // 2), block_bytes)
    sent = _sent(known, heard, n_buckets)
    discard(heard)
    local = sent.filter("bucket < 0").select("batch", "places", "counts", "keys", "owners", F.lit(None).cast("binary").alias("masks"))
    notes = materialise(local.unionByName(_told(sent, n_buckets, index_bytes), allowMissingColumns=True))
    discard(sent)
    return rows, notes


def _covered(notes: pa.Table, size: int) -> np.ndarray | None:
    """Which of a batch's bytes go."""
    if not notes.num_rows:
        return None
    hit = np.zeros(size + 2 * LENGTH, bool)
    masks, alias = [], []
    for row in notes.to_pylist():
        places = np.frombuffer(row["places"], np.int64)
        if row["masks"] is None:
            count = np.frombuffer(row["counts"], np.int64)
            hit[np.repeat(places, count) + _along(count)] = True
            alias.append((np.frombuffer(row["keys"], np.int64), np.frombuffer(row["owners"], np.int64)))
        else:
            masks.append((places, np.frombuffer(row["masks"], np.uint32)))
    if masks:
        places, mask = (np.concatenate(x) for x in zip(*masks, strict=True))
        by = np.argsort(places)
        places, mask = places[by], mask[by]
        for one, other in alias:
            at = np.minimum(np.searchsorted(places, one), len(places) - 1)
            same = places[at] == one
            masks.append((other[same], mask[at[same]]))
        places, mask = (np.concatenate(x) for x in zip(*masks, strict=True))
        for i in range(SPAN):
            hit[places[mask >> np.uint32(i) & np.uint32(1) == 1] + i] = True
    starts = np.flatnonzero(hit)
    if not len(starts):
        return None
    change = np.zeros(size + 2 * LENGTH, np.int32)
    change[starts] += 1
    change[starts + LENGTH] -= 1
    return np.cumsum(change)[:size] > 0


def _spans(rows: pa.Table, notes: pa.Table) -> list[tuple[bytes, np.ndarray]]:
    """text and the edges of its removed runs (start, end, start, ...) of every row, in order of ``seq``."""
    known = rows.filter(rows.column("id").is_valid())
    data, ends = _texts(known.column("text"))
    gone = _covered(notes, len(data)) if known.num_rows else None
    out, at, none = [], 0, np.zeros(0, np.int64)
    for id_, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), strict=True):
        edges = none
        if id_ is not None:
            own = None if gone is None else gone[at : at + len(text)]
            at += len(text)
            if own is not None and own.any():
                edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
        out.append((text, edges))
    return out


def _kept(text: bytes, edges: np.ndarray) -> list[bytes]:
    all_ = [0, *edges.tolist(), len(text)]
    return [text[a:b] for a, b in zip(all_[::2], all_[1::2], strict=True)]


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_pieces: int = HOT_PIECES, block_bytes: int = BLOCK_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` with all its columns and rows, the repeats cut out of the text.

    Characters of which a part was cut go as a whole; null texts stay null. Rows without an id are
    neither sources nor changed; rows that repeat an id are no sources for each other. Other columns,
    whatever their names, stay as they are. Texts of any length are searched in segments. An empty
    table gives an empty result.
    """
    rows, notes = _notes(docs, id_col, text_col, hot_pieces, block_bytes, index_bytes)
    names = [f"c{i}" for i, c in enumerate(docs.columns) if c != text_col]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("seq").combine_chunks()
        new = [b"".join(p.decode("utf-8", "ignore").encode() for p in _kept(t, e)) if len(e) else t for t, e in _spans(left, right)]
        return left.select(["nothing", *names]).append_column("text", pa.array(new, pa.binary()))

    types = ", ".join(["nothing boolean", *(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema) if f.name != text_col), "text binary"])
    out = rows.groupBy("batch").cogroup(notes.groupBy("batch")).applyInArrow(cut, types)
    text = F.when(~F.col("nothing"), F.col("text").cast("string")).cast(docs.schema[text_col].dataType)
    return out.select(*(text.alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_pieces: int = HOT_PIECES, block_bytes: int = BLOCK_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row a document: ``id_col``, n_bytes, spans (maximal removed byte ranges), kept (binary).

    ``kept`` is the remaining bytes in order, null where nothing is removed, and may end or begin inside
    a character; ``kept_sha256`` is their SHA-256. Null texts count as empty. Rows that repeat an id are
    no sources for each other (only smaller ids are). Rows with a null id are neither sources nor
    changed. Other columns are not read. Texts of any length are searched in segments. An empty table
    gives an empty result.
    """
    rows, notes = _notes(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, hot_pieces, block_bytes, index_bytes)
    type_ = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("seq").combine_chunks()
        found = _spans(left, right)
        kept = [b"".join(_kept(t, e)) if len(e) else None for t, e in found]
        digest = [hashlib.sha256(t if k is None else k).hexdigest() for (t, _), k in zip(found, kept, strict=True)]
        spans = [[{"a": a, "b": b} for a, b in zip(e[::2].tolist(), e[1::2].tolist(), strict=True)] for _, e in found]
        return pa.table(
            [left.column("id"), left.column("size"), pa.array(spans, type_), pa.array(kept, pa.binary()), pa.array(digest, pa.string())],
            names=["id", "n_bytes", "spans", "kept", "kept_sha256"],
        )

    texts = rows.select("batch", "seq", "id", "size", "text")
    out = texts.groupBy("batch").cogroup(notes.groupBy("batch")).applyInArrow(cut, "id long, n_bytes long, spans array<struct<a: bigint, b: bigint>>, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
