"""The phrase index and the mined phrases against plain counting."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.functions.shared import materialise
from tessera.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, phrase string, n long"


@pytest.mark.parametrize("seed", range(12))
def test_index_counts_every_phrase(seed):
    rng = np.random.default_rng(seed)
    symbols, depth = int(rng.integers(1, 6)) if seed % 2 else 70_000, 5
    text = np.zeros(1, np.int64)
    for _ in range(int(rng.integers(1, 30))):
        text = np.r_[text, rng.integers(1, min(symbols, 40) + 1, int(rng.integers(1, 30))), 0]
    if symbols > 40:
        text[text == 7] = symbols
    want = collections.Counter(tuple(text[i : i + k]) for k in range(2, depth + 1) for i in range(len(text) - k + 1) if (text[i : i + k] > 0).all())
    got = {}
    for found, times in C.PhraseIndex(text, symbols, depth).phrases():
        for row, n in zip(found, times, strict=True):
            assert tuple(row) not in got
            got[tuple(row)] = n
    assert got == dict(want)


def test_blocks_bound_the_memory_of_an_index(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(1, 20_000, 1 << 18).astype(np.int32)
    text[::15] = text[-1] = 0
    want = sum(int(np.all([text[j : len(text) - k + 1 + j] > 0 for j in range(k)], 0).sum()) for k in range(2, 6))
    monkeypatch.setattr(C, "BLOCK_ROWS", 1 << 12)
    tracemalloc.start()
    rows, places = 0, 0
    for found, times in C.PhraseIndex(text, 20_000, 5).phrases():
        assert 0 < len(found) <= C.BLOCK_ROWS
        rows, places = rows + len(found), places + int(times.sum())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 2 * len(text) and places == want
    assert most < 100 * len(text)  # before: 162 bytes a word


def test_a_shard_is_a_row_group_and_goes_to_python_alone(spark):
    docs = spark.createDataFrame([("en", "ab cd ef " * 200_000)] * 4, "lang string, text string").coalesce(1)
    split = materialise(C.shards(docs, most=500_000), C.ROW_GROUPS)
    assert [pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in split.inputFiles()] == [4]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["n"] for r in materialise(split.mapInArrow(sizes, "n long"), settings=C.ALONE).collect()] == [1] * 4
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def plain_counts(rows, longest):
    f, n = collections.Counter(), collections.Counter()
    for _, lang, text, *_ in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def plain_mined(rows, longest, least, share):
    f, n = plain_counts(rows, longest)
    candidates, out = {x for x, a in f.items() if len(x[1]) > 1 and a >= least}, {}
    for lang, words in candidates:
        a, text = f[lang, words], " ".join(words)
        if any(o == lang and len(longer) > len(words) and f" {text} " in f" {' '.join(longer)} " and 100 * f[o, longer] >= share * a for o, longer in candidates):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, k, left, right = min(cuts)
        out[lang, text] = (len(words), a, k, left, right, n[lang], score)
    return out


def awkward():
    rng = random.Random(5)
    stock = "New York City of the art STATE model É ß\x1cx 日本  z".split(" ")
    rows = []
    for i in range(150):
        text = "".join(rng.choice(stock) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " new york city "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, rng.choice(["en", "en", "fr", None, "und"]), text, "clash", i))
    rows += [rows[3]] * 5 + [(None, None, None, None, None), (7, "en", "", None, None), (8, "xx", " . ,", None, None), (9, "en", "a b " * 20_000, None, None)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"shard_words": 50, "least": 7, "share": 60}, {"longest": 2, "least": 1, "shard_words": 300}])
def test_mined_phrases_equal_plain_counting(spark, settings):
    rows, least, share, longest = awkward(), settings.get("least", 20), settings.get("share", 100), settings.get("longest", 5)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain_mined(rows, longest, least, share)
    got = {(r["lang"], r["phrase"]): tuple(r)[2:] for r in C.mine(docs, **({"least": least, "share": share} | settings)).collect()}
    assert got == want and len(want) > 10


def test_ranks_and_ties(spark):
    rows = [("en", f"p{i}", i % 7, i % 3) for i in range(300)] + [("fr", "one", 1, 1)]
    got = C.top(spark.createDataFrame(rows, "lang string, phrase string, score long, a long"), 40).collect()
    want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[2], -r[3], r[1]))[:40]
    assert [(r["phrase"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["lang"] == "en"] == [(w[1], k + 1) for k, w in enumerate(want)]
    assert [r["rank"] for r in got if r["lang"] == "fr"] == [1]


def test_empty_tables_and_products_beyond_64_bits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.top(C.mine(empty), 5).count() == 0
    big = spark.createDataFrame([(9_000_000_000_000, 80_000_000_000_000, 3_000_000_000, 7_000_000_000)], "a long, total long, l long, r long")
    both = big.select((C._exact(1000 * C.F.col("a")) * C._exact(C.F.col("total"))).alias("over"), (C._exact(C.F.col("l")) * C._exact(C.F.col("r"))).alias("under"))
    want = 1000 * 9_000_000_000_000 * 80_000_000_000_000
    assert want > 1 << 64 and both.selectExpr("over div under AS s").first()["s"] == want // (3_000_000_000 * 7_000_000_000)
