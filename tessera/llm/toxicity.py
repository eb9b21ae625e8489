"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, replaces look-alike letters and digit substitutions, and leaves words separated
by one space. Lexicon entries start at a word's start; an entry that ends with a space is a whole word.
Entries and weights (log odds of documents) are learned from a bounded sample of labelled rows; hits
inside an exception phrase do not count. The weighted hits, as such and per hundred words, go through
a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, hash_fraction

#: Labelled rows (expected number) that the lexicon and the curve are learned from.
SAMPLE_DOCS = 8000
#: Lengths of the word beginnings that may become entries, the closing space included.
LENGTHS = range(4, 13)
#: An entry must be in this many toxic documents, with this likelihood ratio statistic.
LEAST_DOCS, LEAST_G2 = 4, 20.0
#: A longer entry replaces a shorter one if it keeps this share of its toxic documents.
KEEP = 0.9

# Look-alike letters (Cyrillic, Greek, Latin variants) and digits or signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ʟ": "l",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
_FOLD = str.maketrans({**{k: SUBSTITUTIONS.get(v, v) for k, v in LOOKALIKES.items()}, **SUBSTITUTIONS})
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_WORD = re.compile(r"[^\W_]+")

# Words that stand in where no label can be learned from, and phrases that are harmless.
SEED_LEXICON = ("idiot ", "moron ", "stupid ", "scum ", "worthless ", "pathetic ", "disgusting ", "loser ", "trash ", "clown ")
EXCEPTIONS = ("clown fish ", "class clown ", "trash can ", "trash bin ", "white trash bag ", "pond scum ", "sore loser ")


def fold(text: str | None) -> str:
    """Folded words with a space before, between and after them ('' for a text without words)."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    words = _WORD.findall(text.translate(_FOLD))
    return f" {' '.join(words)} " if words else ""


@dataclass
class Lexicon:
    """Entries with weights, exception phrases and the curve's three coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: np.ndarray = field(default_factory=lambda: np.array([-4.0, 3.0, 1.0]))

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            out.add_word(" " + word, (len(word) + 1, weight))
        for phrase in self.exceptions:
            known = self.weights.get(phrase)
            out.add_word(" " + phrase, (len(phrase) + 1, None if known is None else known))
        out.make_automaton()
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ self.curve[1:], -500, 500)))


def features(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, float]:
    """log(1 + weighted hits) of a whole text, and the same of the hits per hundred words."""
    folded = fold(text)
    hits, skips = [], []
    for end, (size, weight) in automaton.iter(folded) if folded and len(automaton) else ():
        (skips if weight is None else hits).append((end - size + 1, end, weight or 0.0))
    if skips:
        # A hit lies inside an exception if one that begins at or before it reaches its end.
        skips.sort()
        starts, reach = [a for a, _, _ in skips], list(accumulate((b for _, b, _ in skips), max))
        hits = [h for h in hits if (k := bisect_right(starts, h[0])) == 0 or reach[k - 1] < h[1]]
    total = sum(h[2] for h in hits)
    return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))


def _beginnings(text: str | None) -> set[str]:
    return {w[:n] for word in set(fold(text).split()) for w in (word + " ",) for n in LENGTHS if n <= len(w)}


def _document_counts(rows: DataFrame) -> DataFrame:
    """entry, n: documents of ``rows`` (text) with a word that begins so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                n: Counter = Counter()
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    n.update(_beginnings(text))
                yield pa.RecordBatch.from_pydict({"entry": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _weight(n_toxic: int, n_clean: int) -> Column:
    """Log odds of an entry in ``a`` toxic and ``b`` clean documents."""
    return F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))


def _g2(n_toxic: int, n_clean: int) -> Column:
    """Likelihood ratio statistic of an entry in ``a`` toxic and ``b`` clean documents."""
    both = (F.col("a") + F.col("b")) / (n_toxic + n_clean)
    clean = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n_clean * both))).otherwise(0.0)
    return 2 * (F.col("a") * F.log(F.col("a") / (n_toxic * both)) + clean)


def choose(weights: dict[str, float], toxic: dict[str, int]) -> dict[str, float]:
    """The most specific of the entries that keep their documents; ``toxic`` counts those."""
    out: dict[str, float] = {}
    longer: dict[str, int] = {}  # most toxic documents of a chosen entry with this beginning
    for entry, weight in sorted(weights.items(), key=lambda x: (-len(x[0]), x[0])):
        shorter = [entry[:n] for n in LENGTHS if n < len(entry) and entry[:n] in weights]
        if longer.get(entry, -1) >= KEEP * toxic[entry]:
            continue
        if all(toxic[entry] >= KEEP * toxic[s] or weights[s] < weight - 0.7 for s in shorter):
            out[entry] = weight
            for n in LENGTHS:
                longer[entry[:n]] = max(longer.get(entry[:n], 0), toxic[entry])
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic curve (the constant is not penalised)."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn a lexicon from about ``sample_docs`` rows of ``labels`` (null labels and ids left out).

    The sample is chosen by a hash of the id and is small enough to be broadcast to the texts. Without
    a toxic and a clean example the seed lexicon with its fixed curve is returned.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    count = known.count()
    chosen = known.filter(hash_fraction(F.col("id").cast("string"), "toxicity") < min(1.0, sample_docs / max(1, count)))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    seed = Lexicon(dict.fromkeys(SEED_LEXICON, 5.0))
    if not n.get(1) or not n.get(0):
        return seed
    # The test for significance is Spark's; what passes is as bounded as the sample.
    both = _document_counts(sample.filter("y = 1")).filter(F.col("n") >= LEAST_DOCS).withColumnRenamed("n", "a")
    both = both.join(_document_counts(sample.filter("y = 0")), "entry", "left").select("entry", "a", F.coalesce("n", F.lit(0)).alias("b"))
    found = both.withColumn("weight", _weight(n[1], n[0])).filter((F.col("weight") > 1) & (_g2(n[1], n[0]) >= LEAST_G2)).collect()
    weights = choose({r["entry"]: r["weight"] for r in found}, {r["entry"]: r["a"] for r in found})
    if not weights:
        return seed
    lexicon = Lexicon(weights)
    points = _measured(sample.select("y", "text"), lexicon, "y int", lambda x: list(x.T)).toPandas()
    lexicon.curve = fit_curve(points[["f0", "f1"]].to_numpy(), points["y"].to_numpy().astype(float))
    return lexicon


def _measured(rows: DataFrame, lexicon: Lexicon, first: str, out) -> DataFrame:
    """The first column of ``rows`` and what ``out`` makes of the texts' features, as f0, f1, ..."""
    width = len(out(np.zeros((1, 2))))
    names = [first.split()[0], *(f"f{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                x = np.array([features(automaton, t) for t in part.column(1).to_pylist()]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out(x))], names=names)

    return rows.mapInArrow(run, ", ".join([first, *(f"{n} double" for n in names[1:])]))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) for every row; null and wordless texts score as texts without hits.

    One pass over whole texts of any length without a shuffle; repeated rows and null ids stay as they are,
    other columns are not read, and an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _measured(rows, lexicon, f"id {id_type}", lambda x: [lexicon.score(x)])
    return found.select(F.col("id").alias(id_col), F.col("f0").alias("score"))
