"""Language identification by prediction by partial matching over bytes.

For each language a context tree of bounded depth holds, for every context of up to ORDER bytes, the
bytes seen after it. A byte costs -log2 of its probability in the longest known context; a byte not
seen there costs the escape of that context and is coded in the next shorter one (method C: of n
occurrences with d different bytes, a byte seen c times has c / (n + d), the escape d / (n + d)).
The counts are those of the training texts, without strings of more than three bytes seen less than
LEAST_SEEN times, which count as never seen. They are frozen after training, so all costs are worked out
beforehand and a text's exact code length in each language is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, hash_fraction

#: Longest context in bytes.
ORDER = 4
#: Labelled documents a language (expected number) that the trees are grown from.
SAMPLE_DOCS = 1200
#: Contexts of three and more bytes keep a successor only if it was seen this often.
LEAST_SEEN = 2
#: A text fits no language if it costs more than so many times the language's mean a byte, and SLACK_BITS.
MOST_TIMES, SLACK_BITS = 4.0, 64.0
#: Bytes scored at once.
CHUNK = 1 << 19
UNDETERMINED = "und"
_PAD = b" " * ORDER


def prepared(text: str) -> bytes:
    """Lower-cased UTF-8 behind a fixed context, so that the first bytes have contexts too."""
    return _PAD + text.lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(data: np.ndarray) -> list[np.ndarray]:
    """For k = 0..ORDER the k + 1 bytes that end at each place from ORDER on, packed into an integer."""
    out, n = [], len(data)
    packed = data[ORDER:].astype(np.uint64)
    out.append(packed.copy())
    for k in range(1, ORDER + 1):
        packed |= data[ORDER - k : n - k].astype(np.uint64) << np.uint64(8 * k)
        out.append(packed.copy())
    return out


def training_counts(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, k, gram, n: how often each string of k + 1 bytes occurs in the texts of each language."""
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                    if has_letter(text):
                        by.setdefault(lang, []).append(prepared(text))
                for lang, texts in by.items():
                    per_text = [grams(np.frombuffer(t, dtype=np.uint8)) for t in texts]
                    for k in range(ORDER + 1):
                        seen, n = np.unique(np.concatenate([g[k] for g in per_text]), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(np.full(len(seen), k, np.int32)), pa.array(seen.view(np.int64)), pa.array(n)], schema=schema)

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("k") < 3) | (F.col("n") >= LEAST_SEEN))


def sample(labelled: DataFrame, docs_per_language: int, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """About ``docs_per_language`` whole documents of each language, chosen by a hash of the id."""
    share = labelled.groupBy(lang_col).agg((F.lit(float(docs_per_language)) / F.count(F.lit(1))).alias("share")).collect()
    if not share:
        return labelled.limit(0)
    chosen = F.lit(False)
    for row in share:
        chosen = chosen | ((F.col(lang_col) == row[0]) & (hash_fraction(F.col(id_col).cast("string"), "langid") < row[1]))
    return labelled.filter(chosen)


class Table:
    """Exact lookup of packed strings: open addressing with linear probing, on whole arrays."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2 + 1))))
        size = 1 << self.bits
        self.keys, self.slot = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(todo):
            free = self.slot[at] < 0
            _, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[at[taken]], self.slot[at[taken]] = keys[todo[taken]], todo[taken]
            left = np.ones(len(todo), bool)
            left[taken] = False
            todo, at = todo[left], (at[left] + 1) & (size - 1)
        self.values = values

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        at = self._hash(keys)
        out = self.slot[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.slot) - 1)
            row = self.slot[at]
            out[todo] = row
            other = (row >= 0) & (self.keys[at] != keys[todo])
            todo, at = todo[other], at[other]
        return out


class Model:
    """Frozen code lengths (bits) of all languages.

    ``tables[k]`` maps a string of k + 1 bytes to the code length of its last byte behind the others,
    for every language, escapes included. ``escapes[k]`` maps a context of k bytes to each language's
    escape cost, for strings that no language has seen in full.
    """

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """counts: for each k the arrays (language number, string, count)."""
        self.langs, wide = langs, len(langs)
        self.tables: list[Table] = []
        self.escapes: list[Table | None] = []
        self.floor = np.full(wide, 8.0)
        #: Mean bits a byte of the training texts in their own language.
        self.means = np.full(wide, 8.0)
        for k, (lang, gram, n) in enumerate(counts):
            context = gram >> np.uint64(8)
            keys, row = np.unique(gram, return_inverse=True)
            contexts, crow = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((2, len(contexts), wide))
            np.add.at(total, (crow, lang), n)
            np.add.at(kinds, (crow, lang), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = np.searchsorted(contexts, keys >> np.uint64(8))
            cost = escape[own] + (self._shorter(k - 1, keys) if k else self.floor)
            cost[row, lang] = -np.log2(n / (total + kinds)[crow, lang])
            self.tables.append(Table(keys, cost.astype(np.float32)))
            self.escapes.append(Table(contexts, escape.astype(np.float32)))

    def _shorter(self, k: int, gram: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte behind at most the k bytes before it, as an array (strings, languages)."""
        gram = gram & np.uint64((1 << (8 * (k + 1))) - 1)
        out = np.zeros((len(gram), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(gram))
        for j in range(k, -1, -1):
            own = gram[todo] & np.uint64((1 << (8 * (j + 1))) - 1)
            row = self.tables[j].find(own)
            known = row >= 0
            out[todo[known]] += self.tables[j].values[0][row[known]]
            todo, own = todo[~known], own[~known]
            if not len(todo):
                return out
            row = self.escapes[j].find(own >> np.uint64(8))
            known = row >= 0
            out[todo[known]] += self.escapes[j].values[0][row[known]]
        out[todo] += self.floor.astype(np.float32)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each prepared text (without its padding) in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            if end == at + 1:  # a text beyond the chunk is summed piece by piece
                text = texts[at]
                for lo in range(ORDER, max(ORDER + 1, len(text)), CHUNK):
                    data = np.frombuffer(text[lo - ORDER : lo + CHUNK], dtype=np.uint8)
                    if len(data) > ORDER:
                        out[at] += self._bits(data).sum(0, dtype=np.float64)
            else:
                data = np.frombuffer(b"".join(texts[at:end]), dtype=np.uint8)
                bits = self._bits(data)
                starts = np.cumsum([0, *map(len, texts[at:end])])
                sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(bits, axis=0, dtype=np.float64)])
                out[at:end] = sums[starts[1:] - ORDER] - sums[starts[:-1]]
            at = end
        return out

    def fits(self, texts: list[bytes], bits: np.ndarray) -> np.ndarray:
        """Whether each prepared text is described by its best language, given the code lengths ``bits``."""
        size = np.array([len(t) - ORDER for t in texts], dtype=float)
        best = bits.argmin(1)
        return bits[np.arange(len(texts)), best] <= MOST_TIMES * self.means[best] * size + SLACK_BITS

    def _bits(self, data: np.ndarray) -> np.ndarray:
        packed = data[ORDER:].astype(np.uint64)
        for k in range(1, ORDER + 1):
            packed |= data[ORDER - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
        return self._shorter(ORDER, packed)


def train(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Grow the trees from a bounded sample of labelled rows (null labels are left out).

    What reaches the driver is the strings of at most five bytes of about ``docs_per_language``
    documents a language, whatever the size of the table. Null and letterless texts teach nothing, repeated
    rows count as often as they stand, other columns are not read. None if nothing is labelled (so for an
    empty table).
    """
    rows = sample(labelled.filter(F.col(lang_col).isNotNull()), docs_per_language, id_col, lang_col)
    table = training_counts(rows, lang_col, text_col).toArrow()
    if not table.num_rows:
        return None
    langs = sorted(table["lang"].unique().to_pylist())
    number = pc.index_in(table["lang"], pa.array(langs)).to_numpy().astype(np.int64)
    order, gram, n = (table[c].to_numpy() for c in ("k", "gram", "n"))
    counts = []
    for k in range(ORDER + 1):
        own = order == k
        counts.append((number[own], gram[own].view(np.uint64), n[own].astype(float)))
    model = Model(langs, counts)
    means = _mean_costs(rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), model)
    for r in means.collect():
        model.means[langs.index(r["lang"])] = r["mean"]
    return model


def _mean_costs(rows: DataFrame, model: Model) -> DataFrame:
    """lang, mean: bits a byte of the texts of each language in that language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    number = {x: i for i, x in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                both = [(x, prepared(t)) for x, t in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True) if has_letter(t)]
                bits = shared.value.code_lengths([t for _, t in both]) if both else np.zeros((0, len(number)))
                own = [float(b[number[x]]) for b, (x, _) in zip(bits, both, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.string()), pa.array(own, pa.float64()), pa.array([len(t) - ORDER for _, t in both], pa.int64())], names=["lang", "bits", "size"])

    return rows.mapInArrow(run, "lang string, bits double, size long").groupBy("lang").agg((F.sum("bits") / F.sum("size")).alias("mean"))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``bits_per_byte`` for every row; one pass, no shuffle.

    ``score`` is the posterior of the language under equal priors, given the exact code lengths. Null
    texts and texts without a letter (and every text, if nothing could be learned) are ``und`` with
    score 0 and null bits. Ties go to the alphabetically first language. Texts of any length are scored
    whole, in pieces of CHUNK bytes; repeated rows and null ids stay as they are, other columns are not read,
    and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(1).to_pylist()
                lang, score, bits = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
                fit = [i for i, t in enumerate(texts) if own is not None and has_letter(t)]
                ready = [prepared(texts[i]) for i in fit]
                for i, t, length in zip(fit, ready, own.code_lengths(ready) if fit else [], strict=True):
                    best = int(length.argmin())
                    lang[i], score[i], bits[i] = own.langs[best], 1.0 / np.exp2(np.maximum(length[best] - length, -1000)).sum(), float(length[best] / (len(t) - ORDER))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits, pa.float64())], names=["id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_col)


def keep_recognised(docs: DataFrame, model: Model | None, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language: one pass, no shuffle.

    Rejected are null texts, texts without a letter, texts whose best language has a posterior below
    ``least_score``, and texts far from all languages: their code length in the best one is more than
    MOST_TIMES its mean in training (other scripts, encoded data, noise). A language that was not learned but is written
    much like one that was stays as that one. If nothing could be learned, every text with a letter stays. Repeated rows are judged alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(at_text).to_pylist()
                keep = np.array([has_letter(t) for t in texts], dtype=bool)
                fit = np.flatnonzero(keep)
                if own is not None and len(fit):
                    ready = [prepared(texts[i]) for i in fit]
                    bits = own.code_lengths(ready)
                    score = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    keep[fit] = (score >= least_score) & own.fits(ready, bits)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
