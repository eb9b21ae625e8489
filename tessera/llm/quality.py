"""Quality rules: fixed counts a document, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over BUCKETS hashed words and word pairs: one of trusted documents,
one of the whole corpus. A document's score is the mean over its n-grams, so length does not matter, and
every document is kept or dropped by the same fixed threshold. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialise

from .common import hash_fraction

BUCKETS = 1 << 16
#: Added to every bucket's count in both multinomials.
PSEUDO_COUNT = 0.5
#: Trusted documents (expected number) that the target multinomial is estimated from.
TRUSTED_DOCS = 20_000
#: Documents whose mean log ratio is below this are dropped.
THRESHOLD = -0.2
WINDOW = 8
_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, given each window's hash in order."""

    def covered(starts: Column) -> Column:
        spans = F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(starts, i + 1) - p), F.lit(WINDOW)))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def body(s: Column) -> Column:
        same = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda e: e["at"])), covered)

    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return let(marked, body)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("word", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return rows.withColumn("n_words", F.size("word"))


def grams(word: Column, n_words: Column) -> Column:
    """Buckets of all words and all pairs of neighbours, from the words' hashes."""
    single = F.transform(word, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pairs = F.transform(F.slice(word, 2, F.greatest(n_words - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(F.get(word, i), h), F.lit(BUCKETS)).cast("int"))
    return F.concat(single, pairs)


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode(grams(F.col("word"), F.col("n_words"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """bucket, ratio: BUCKETS rows at most. Trusted are rows labelled 1 (a bounded sample by hash of the id).

    The corpus counts cover every document. Without a trusted document all ratios are 0.
    """
    trusted = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).dropna().distinct()
    count = trusted.count()
    chosen = trusted.filter(hash_fraction(F.col("id").cast("string"), "trusted") < min(1.0, trusted_docs / max(1, count)))
    near = docs.join(F.broadcast(chosen.withColumnRenamed("id", id_col)), id_col, "left_semi")
    target = _counts(_measured(near, id_col, text_col), "target")
    corpus = _counts(_measured(docs, id_col, text_col), "corpus")
    both = materialise(corpus.join(target, "bucket", "left").fillna(0, ["target"]))
    total = both.agg(F.sum("target").alias("t"), F.sum("corpus").alias("c")).first()
    extra = PSEUDO_COUNT * BUCKETS
    if not total["t"]:
        return both.select("bucket", F.lit(0.0).alias("ratio"))
    share = (F.col("target") + PSEUDO_COUNT) / (total["t"] + extra) / ((F.col("corpus") + PSEUDO_COUNT) / (total["c"] + extra))
    return both.select("bucket", F.log(share).alias("ratio"))


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the base counts, base_failed, score (mean log ratio, 0 without words), kept.

    word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines: lines with a word
    that equal an earlier line; n_repeat_words: words inside 8-word windows that occur twice or more.
    base_failed: fewer than 20 words, or over 30 % repeated words. Null texts count as empty; repeated
    rows, null ids and tables without rows need no special care.
    """
    rows = _measured(docs, id_col, text_col)
    text, n = F.col("text"), F.col("n_words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("word", i, WINDOW))))
    rows = rows.withColumns({"lines": lines, "windows": windows})
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeated(F.col("windows"))).otherwise(F.lit(0))
    base = rows.select(
        "row", "id",
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(text.contains("\n"), F.size("lines") - F.size(F.array_distinct("lines"))).otherwise(F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"),
        grams(F.col("word"), n).alias("grams"),
    )
    kept = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    each = base.select("row", "id", *kept, F.explode_outer("grams").alias("bucket"))
    ratios = F.broadcast(log_ratios(docs, labels, id_col, text_col))  # BUCKETS rows at most
    scored = each.join(ratios, "bucket", "left").groupBy("row", "id", *kept).agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("score"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), *kept, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
