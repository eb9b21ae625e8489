"""Phrases whose words stand together more often than chance, mined with an index over word ids in each shard.

A shard is a run of documents that one task reads. Its words become numbers, and a bidirectional index (the
Burrows-Wheeler transforms of the numbers and of their reverse, suffixes in order of their first few words) gives
every phrase as an interval: one step extends all intervals by each word in front of them or behind them, and keeps
the interval of the other direction in step. Counts are summed across shards. A phrase is at most as frequent
as its parts, so words, then pairs, that are too rare in all shards together end the pieces of the next round;
shards know them by a bitmap of bounded size, whose false hits cost time but change no count. Intervals are extended,
and phrases become strings, a block at a time: a shard's memory follows its words, however many of its phrases are frequent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import match
from tessera.functions.shared import broadcast_if_small, discard, materialise

#: Words of a shard; a document that goes beyond is not divided.
SHARD_WORDS = 1 << 21
#: Rows of an index that are extended, and phrases that are written out, at once.
BLOCK_ROWS = 1 << 17
#: A shard is a large row: each is a row group of its own, and goes to Python alone.
ROW_GROUPS = {"parquet.block.row.count.limit": 1}
ALONE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: Bits of a bitmap for each entry, and at most.
BITS_EACH, MOST_BITS = 32, 1 << 28
#: Counted rows up to which the languages' sizes are broadcast.
BROADCAST_ROWS = 100_000
#: Buckets of phrases: classes of the first word, and of the last.
FIRST_PARTS, LAST_PARTS = 256, 16
#: Parts that a language's phrases are ranked in first.
RANK_PARTS = 64
UNKNOWN = "und"

_END = b"\n"
_FOLD = bytes(ord("\n") if c in b".,;:!?\x0a\x0b\x0c\x0d" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, lower-cased in A-Z, with _END between pieces; empty tokens come from adjacent blanks."""
    return text.translate(_FOLD).replace(_END, b" \n ").split(b" ")


def shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = SHARD_WORDS) -> DataFrame:
    """totals (lang, n), words (lang, word, n) and ids (32-bit numbers of words from 1, 0 between pieces) of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, size, number = {}, [], 0, count(2)

        def vocabulary(lang: str) -> dict:
            words = defaultdict(number.__next__)
            words[b""], words[_END] = 0, 1
            return words

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            parts.clear()
            ids = ids[ids > 0]
            times = np.bincount(ids, minlength=next(number))
            words, own_lang = [""] * len(times), np.zeros(len(times), np.int32)
            for k, own in enumerate(known.values()):
                own_lang[np.fromiter(own.values(), np.int32, len(own))] = k
                for w, i in own.items():
                    words[i] = w.decode("utf-8", "replace")
            words, own_lang, times = pa.array(words[2:], pa.string()), own_lang[2:], times[2:]  # ids from 2 without gaps
            langs = pa.array(list(known), pa.string())
            one = lambda **columns: pa.ListArray.from_arrays(pa.array([0, len(columns["lang"])], pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))
            totals = np.zeros(len(known), np.int64)
            np.add.at(totals, own_lang, times)
            some = np.flatnonzero(totals)
            return pa.RecordBatch.from_arrays(
                [one(lang=langs.take(pa.array(some)), n=pa.array(totals[some])), one(lang=langs.take(pa.array(own_lang)), word=words, n=pa.array(times)), pa.array([(ids - 1).astype("<i4").tobytes()], pa.binary())],
                names=["totals", "words", "ids"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens(text.as_py())
                own = known.get(lang) or known.setdefault(lang, vocabulary(lang))
                parts.append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
                parts.append(np.ones(1, np.int32))
                size += len(found)
                if size >= most:
                    yield shard()
                    known, parts, size, number = {}, [], 0, count(2)
        if parts:
            yield shard()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = "totals array<struct<lang: string, n: long>>, words array<struct<lang: string, word: string, n: long>>, ids binary"
    return rows.filter(F.octet_length("text") > 0).mapInArrow(run, schema)


class Side:
    """One direction of the index: suffixes of ``text`` in order of their first ``depth`` symbols at least."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = len(text)
        wide = max(1, 63 // max(1, int(symbols).bit_length()))
        key = np.zeros(n, np.int64)
        for k in range(min(wide, depth)):
            key *= symbols + 1
            key[: n - k] += text[k:]
        reach = min(wide, depth)
        order = np.argsort(key)
        while reach < depth:  # the rank of the first symbols, then that of those behind them
            key, new, rank = key[order], np.zeros(n, bool), np.empty(n, np.int32)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            rank[order] = np.cumsum(new, dtype=np.int32)
            np.multiply(rank, n + 1, out=key, dtype=np.int64)
            key[: n - reach] += rank[reach:]
            key[: n - reach] += 1
            del new, rank, order
            order, reach = np.argsort(key), 2 * reach
        del key
        self.size = n
        #: Where each suffix begins.
        self.order = order.astype(np.int32)
        del order
        #: The symbol in front of each suffix; and these symbols with their rows, sorted: ranks of symbols.
        self.before = text[self.order - 1]
        self.ranks = self.before * np.int64(n)
        self.ranks += np.arange(n)
        self.ranks.sort()

    def extend(self, lo: np.ndarray, times: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(interval, count, lo, smaller) of every extension by a symbol: its first row, and how many smaller symbols the interval has.

        Intervals come in blocks of about BLOCK_ROWS rows.
        """
        end = np.cumsum(times, dtype=np.int64)
        cuts = np.searchsorted(end, np.arange(BLOCK_ROWS, end[-1] if len(end) else 0, BLOCK_ROWS), "right")
        for a, b in pairwise(np.unique(np.r_[0, cuts, len(lo)])):
            size, low = times[a:b].astype(np.int64), lo[a:b].astype(np.int64)
            edge = np.cumsum(size) - size
            rows = np.repeat(low - edge, size)
            rows += np.arange(len(rows))
            key = np.repeat(np.arange(len(low)) * (symbols + 1), size)
            key += self.before[rows]
            del rows
            key.sort()
            new = np.flatnonzero(np.diff(key, prepend=-1))
            counts = np.diff(new, append=len(key))
            of, symbol = np.divmod(key[new], symbols + 1)
            real = symbol > 0
            of, symbol, counts, new = of[real], symbol[real], counts[real], new[real]
            yield of + a, counts, np.searchsorted(self.ranks, symbol * self.size + low[of]), new - edge[of]


class PhraseIndex:
    """Bidirectional index of a text of symbols from 1, with 0 at its ends and between pieces."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.text, self.symbols, self.depth = text, symbols, depth
        self.ahead, self.back = Side(text, symbols, depth), Side(text[::-1], symbols, depth)
        self.back.order = None
        times = np.bincount(text, minlength=symbols + 1)
        #: Intervals of the single symbols, the same in both directions.
        self.starts = (np.cumsum(times) - times)[1:].astype(np.int32)
        self.times = times[1:].astype(np.int32)

    def intervals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first rows ahead, counts) of the phrases of each length from 2 to ``depth``, which grow behind and in front by turns."""
        lo, low, times = self.starts, self.starts, self.times
        for length in range(2, self.depth + 1):
            behind = length % 2 == 0
            side, own, other = (self.back, low, lo) if behind else (self.ahead, lo, low)
            new, n = np.empty((3, times.sum()), np.int32), 0
            for of, counts, first, smaller in side.extend(own, times, self.symbols):
                to = n + len(of)
                new[0, n:to], new[1, n:to], new[2, n:to], n = first, other[of] + smaller, counts, to
            first, moved, times = new[:, :n]
            lo, low = (moved, first) if behind else (first, moved)
            yield length, lo, times

    def phrases(self, first: np.ndarray | None = None, last: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases, counts) of each length from 2 to ``depth``, BLOCK_ROWS at most at once: one row of symbols for each phrase that occurs.

        Those of a length are in order of ``first`` of their first symbol plus ``last`` of their last one, if given; among equals, phrases with the same symbols but
        the last stand together.
        """
        for length, lo, times in self.intervals():
            begin, key = self.ahead.order[lo], lo.astype(np.int64)
            if first is not None:
                key += (first[self.text[begin]] + last[self.text[begin + (length - 1)]]) * len(self.text)
            by = np.argsort(key).astype(np.int32)
            del key
            for at in range(0, len(by), BLOCK_ROWS):
                part = by[at : at + BLOCK_ROWS]
                yield self.text[begin[part][:, None] + np.arange(length)], times[part]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _GOLD
    return x ^ (x >> np.uint64(29))


def _word_hash(lang: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{lang}\t{word}")  # no word has a tab


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(a) + b * np.uint64(0xD1342543DE82EF95))


def bitmap(known: DataFrame, rows: int) -> np.ndarray:
    """Bits at the hashes of the words or pairs of ``known`` (lang, phrase); most MOST_BITS of them, whatever ``rows``."""
    bits = min(MOST_BITS, 1 << max(10, (rows * BITS_EACH).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes.append([_word_hash(lang, w) for w in phrase.split(" ")])
            x = np.array(hashes, np.uint64).reshape(batch.num_rows, -1)
            at = ((x[:, 0] if x.shape[1] == 1 else _pair_hash(x[:, 0], x[:, 1])) % np.uint64(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["at", "bit"])

    found = known.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _runs(text: np.ndarray, breaks: np.ndarray, least: int) -> np.ndarray:
    """The runs of ``least`` and more non-zero symbols, cut where ``breaks`` (before a symbol) says so, with zeros around."""
    kept = text > 0
    start = kept.copy()
    start[1:] &= ~kept[:-1] | breaks[1:]
    place = np.cumsum(kept, dtype=np.int32)
    first = place[start] - 1
    length = np.diff(first, append=place[-1:])
    kept[kept] = np.repeat(length >= least, length)
    start &= kept
    place = np.cumsum(kept.view(np.int8) + start.view(np.int8), dtype=np.int32)  # a zero in front of each run
    out = np.zeros(place[-1] + 1, np.int32)
    out[place[kept] - 1] = text[kept]
    return out


def _packed(found: np.ndarray, times: np.ndarray, row: np.ndarray, langs: pa.Array, word: pa.Array) -> pa.RecordBatch:
    """lang, bucket, packed: the phrases in lines, each the words but the last, then all last words with counts above 1 behind them.

    The phrases are in order of ``row``, the number of the language times all buckets plus the bucket; equal heads stand together.
    """
    new_row = np.diff(row, prepend=-1) != 0
    new_line = new_row.copy()
    new_line[1:] |= (found[1:, :-1] != found[:-1, :-1]).any(1)
    ends = word.take(pa.array(found[:, -1] - 1))
    often = pa.array(times > 1)
    ends = pc.if_else(often, pc.binary_join_element_wise(ends, pc.cast(pa.array(times), pa.string()), " "), ends)
    lists = lambda values, new: pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(values)).astype(np.int32)), values)
    heads = (word.take(pa.array(c - 1)) for c in found[new_line, :-1].T)
    lines = pc.binary_join_element_wise(pc.binary_join_element_wise(*heads, " "), pc.binary_join(lists(ends, new_line), "\t"), "\t")
    texts = pc.binary_join(lists(lines, new_row[new_line]), "\n")
    key = row[new_row]
    return pa.RecordBatch.from_arrays([langs.take(pa.array(key // (FIRST_PARTS * LAST_PARTS))), pa.array((key % (FIRST_PARTS * LAST_PARTS)).astype(np.int32)), texts], names=["lang", "bucket", "packed"])


def counted(shard: DataFrame, words: np.ndarray, pairs: np.ndarray | None, longest: int, least: int) -> DataFrame:
    """lang, phrase, n_words, n: phrases of ``longest`` words, or with ``pairs`` of 3 to ``longest``, that occur ``least`` times in all.

    Only phrases of words (and pairs) in the bitmaps are counted.
    """
    known = shard.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, own_pairs = known.value
        for batch in batches:
            for row in range(batch.num_rows):
                entries = batch.column(0)[row].values
                lang, word = entries.field("lang"), entries.field("word")
                hashes = np.zeros(len(entries), np.uint64)
                for at in range(0, len(entries), BLOCK_ROWS):
                    hashes[at : at + BLOCK_ROWS] = [_word_hash(*x) for x in zip(lang[at : at + BLOCK_ROWS].to_pylist(), word[at : at + BLOCK_ROWS].to_pylist(), strict=True)]
                frequent = np.flatnonzero(_has(own_words, hashes))
                new = np.zeros(len(entries) + 1, np.int32)
                new[frequent + 1] = np.arange(1, len(frequent) + 1)
                text = new[np.frombuffer(batch.column(1)[row].as_buffer(), "<i4")]
                breaks, hashes = np.zeros(len(text), bool), np.r_[np.uint64(0), hashes[frequent]]
                for at in range(0, len(text) if own_pairs is not None else 0, BLOCK_ROWS):
                    part = text[at : at + BLOCK_ROWS + 1]
                    met = np.flatnonzero((part[1:] > 0) & (part[:-1] > 0))
                    breaks[at + met + 1] = ~_has(own_pairs, _pair_hash(hashes[part[met]], hashes[part[met + 1]]))
                text = _runs(text, breaks, 2 if own_pairs is None else 3)
                del breaks
                if len(text) == 1:
                    continue
                langs, word = lang.take(pa.array(frequent)).dictionary_encode(), word.take(pa.array(frequent))
                # The bucket follows from the first and the last word, so that neither makes a hot one.
                first, last = (hashes % np.uint64(FIRST_PARTS)).astype(np.int64) * LAST_PARTS, (hashes % np.uint64(LAST_PARTS)).astype(np.int64)
                first[1:] += langs.indices.to_numpy() * np.int64(FIRST_PARTS * LAST_PARTS)
                for found, times in PhraseIndex(text, len(frequent), longest).phrases(first, last):
                    if own_pairs is None or found.shape[1] > 2:
                        yield _packed(found, times, first[found[:, 0]] + last[found[:, -1]], langs.dictionary, word)

    rows = shard.select("words", "ids").mapInArrow(run, "lang string, bucket int, packed string").repartition("lang", "bucket")
    # What was dealt by bucket needs no further exchange to be counted by phrase.
    lines = rows.select("lang", "bucket", F.explode(F.split("packed", "\n")).alias("line")).select("lang", "bucket", F.split("line", "\t").alias("line"))
    ends = lines.select("lang", "bucket", F.col("line")[0].alias("head"), F.explode(F.slice("line", F.lit(2), F.size("line"))).alias("end"))
    ends = ends.select("lang", "bucket", F.concat_ws(" ", "head", F.substring_index("end", " ", 1)).alias("phrase"), F.coalesce(F.get(F.split("end", " "), F.lit(1)).cast("long"), F.lit(1)).alias("n"))
    summed = ends.groupBy("lang", "bucket", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return summed.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n_words"), "n")


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def mine(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, n_words, a, cut, l, r, n, score of every phrase of 2 to ``longest`` words that occurs ``least`` times in a language.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs. a is the
    number of places; of the cuts in two parts the one with the lowest score counts (ties: the shortest first part), with l and r the
    numbers of places of its parts and n of all words of the language; score = floor(1000 * a * n / (l * r)), in whole numbers.
    Phrases that stand inside a longer one with ``share`` percent or more of their places are left out.

    Null texts and empty ones have no words; a null language is ``und``, rows that repeat count each; texts of any length are
    read whole. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    split = materialise(shards(docs, lang_col, text_col, shard_words), ROW_GROUPS)
    sizes = materialise(split.select(F.inline("totals")).groupBy("lang").agg(F.sum("n").alias("total")))
    singles = split.select(F.inline("words")).groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    singles = materialise(singles.select("lang", "phrase", F.lit(1).alias("n_words"), "n"))
    words = bitmap(singles, singles.count())
    known = singles.unionByName(pairs := materialise(counted(split, words, None, 2, least), settings=ALONE))
    if longest > 2:
        known = known.unionByName(materialise(counted(split, words, bitmap(pairs, pairs.count()), longest, least), settings=ALONE))
    discard(split)
    own = F.split("phrase", " ")
    # A longer phrase around one counts at most as often as the phrase and one more word.
    longer = known.filter("n_words > 2").select("lang", "n", F.explode(F.array(_joined(own, 1, F.col("n_words") - 1), _joined(own, 2, F.col("n_words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    kept = known.filter("n_words > 1").join(longer, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("around").isNull() | (_exact(F.lit(100)) * _exact(F.col("around")) < _exact(F.lit(share)) * _exact(F.col("n"))))
    cuts = kept.select("lang", "phrase", "n_words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": _joined(own, 1, F.col("cut")), "right": _joined(own, F.col("cut") + 1, F.col("n_words") - F.col("cut"))})
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = match(cuts, broadcast_if_small(sizes, sizes.count(), BROADCAST_ROWS), ["lang"])
    cuts = cuts.withColumn("over", _exact(1000 * F.col("a")) * _exact(F.col("total"))).withColumn("under", _exact(F.col("l")) * _exact(F.col("r")))
    lowest = cuts.groupBy("lang", "phrase", "n_words", "a", "total").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("best"))
    return lowest.select("lang", "phrase", "n_words", "a", "best.cut", "best.l", "best.r", F.col("total").alias("n"), "best.score")


def top(mined: DataFrame, most: int) -> DataFrame:
    """``mined`` with ``rank``: the first ``most`` of each language by score and a, descending, then phrase (ascending by bytes).

    Ranks are taken in parts of a language first, so no task orders all its phrases.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    first = mined.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    ranked = first.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= most)


def phrases_sql(most: int, least: int = 100) -> str:
    """op11 in SQL: every phrase of up to five words of every piece, grouped."""
    return rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
    i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
    f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM i, range(1, 6) AS r(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= {least}),
    n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
    s AS (SELECT *, string_split(phrase, ' ') AS ws FROM f),
    inner_of AS (SELECT DISTINCT lang, phrase, a FROM (SELECT lang, f, k, ws, unnest(range(1, k)) AS size FROM s) q, range(0, 4) AS o(off),
      LATERAL (SELECT array_to_string(ws[off + 1 : off + size], ' ') AS phrase, f AS a) WHERE off + size <= k),
    c AS (SELECT s.* FROM s WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_of o WHERE o.lang = s.lang AND o.phrase = s.phrase AND 100 * o.a >= 100 * s.f)),
    cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(ws[1 : cut], ' ') AS x, array_to_string(ws[cut + 1 : k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
    v AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN n ON n.lang = cuts.lang),
    b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {most}"""
