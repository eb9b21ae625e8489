"""Repeat removal and its run-length index against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import run_index, suffix_dedup


def plain_repeats(rows):
    first = {}
    for i, t in rows:
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], i), i)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = True
        out[i] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def random_text(rng, size):
    text = rng.integers(run_index.FIRST, run_index.FIRST + int(rng.integers(2, 5)), size).astype(np.uint16)
    if rng.integers(2):
        text[rng.integers(0, size, max(1, size // 20))] = run_index.STOP
    if size > 50:
        text[size // 2 : size // 2 + 20] = text[:20]
    return np.append(text, run_index.FINISH).astype(np.uint16)


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_and_classes(seed):
    rng = np.random.default_rng(seed)
    text, least = random_text(rng, int(rng.integers(1, 300))), 4
    index, t = run_index.RunIndex(text), text.tolist()
    assert run_index.suffix_array(index.words).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    strings = [rng.integers(run_index.FIRST, run_index.FIRST + 5, int(rng.integers(1, 60))).tolist() for _ in range(20)]
    sizes = np.array([len(x) for x in strings])
    got = {}
    for which, back, place in index.matches(np.concatenate(strings).astype(np.uint16), np.cumsum(sizes), sizes, least):
        got |= {(int(w), int(sizes[w]) - back): int(p) for w, p in zip(which, place, strict=True)}

    def common(x, at):
        return next((k for k in range(min(len(x), len(t) - at)) if x[k] != t[at + k]), min(len(x), len(t) - at))

    for k, x in enumerate(strings):
        for i in range(len(x)):
            best = max(common(x[i:], j) for j in range(len(t)))
            assert (best >= least) == ((k, i) in got)
            if best >= least:
                assert common(x[i:], got[k, i]) == best
    kinds = {}
    for place, kind in zip(*index.classes(least), strict=True):
        if place + least <= len(t):
            kinds.setdefault(tuple(t[place : place + least]), set()).add(int(kind))
    assert all(len(x) == 1 for x in kinds.values()) and len({min(x) for x in kinds.values()}) == len(kinds)


AWKWARD = [None, "", " ", "a" * 49, "a" * 50, "a" * 51, "x" * 5000, "the quick brown fox jumps over the lazy dog and runs away from it " * 40, "Größe İstanbul 日本語 🎉 " * 30, "\x00" * 120]


def awkward_rows():
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdéß "), 160)) for _ in range(4)]
    rows = [(100 + i, "".join(rng.choice(list("xyz"), 20)) + base[i % 4][rng.integers(30) : 100 + rng.integers(60)] + "q" * int(rng.integers(80))) for i in range(40)]
    rows += [(i, t) for i, t in enumerate(AWKWARD)] + [(7, AWKWARD[7]), (20, AWKWARD[7]), (20, "other text " * 9 + base[0]), (21, AWKWARD[7] + "tail"), (None, base[0]), (None, None), (22, "\x00" * 90)]
    long = "".join(rng.choice(list("abcdefgh"), 1_200_000))
    return rows + [(30, long), (31, long[:70_000] + "!" + long[66_000:130_000]), (32, "?" + long[400_000:])]


def check(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, **settings).collect() if r["doc_id"] is not None)
    own = [(i, (t or "").encode()) for i, t in rows if i is not None]
    want = sorted((i, *x) for i, t in own for x in [one_row(own, i, t)])
    assert got == want
    return docs


_known: dict = {}


def one_row(rows, number, text):
    if not _known.get("rows") == rows:
        first = {}
        for i, t in rows:
            for s in range(len(t) - 49):
                first[t[s : s + 50]] = min(first.get(t[s : s + 50], i), i)
        _known.update(rows=rows, first=first)
    gone = np.zeros(len(text), bool)
    for s in range(len(text) - 49):
        if _known["first"][text[s : s + 50]] < number:
            gone[s : s + 50] = True
    return (len(text), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())


@pytest.mark.parametrize("settings", [{}, {"hot_pieces": 2, "block_bytes": 1 << 16, "index_bytes": 1 << 10}])
def test_repeats_equal_brute_force(spark, settings):
    docs = check(spark, awkward_rows(), **settings)
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_many_variants_of_one_passage(spark):
    """The edges of a passage: one anchor, other bytes before and behind it in every document."""
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdefgh"), 90))
    rows = [(i, "".join(rng.choice(list("uvwxyz"), 40)) + passage[: 60 + i % 30] + "".join(rng.choice(list("uvwxyz"), 40)) * (1 + i % 2)) for i in range(300)]
    check(spark, rows)
    check(spark, rows, hot_pieces=20)


def test_strip_repeats_keeps_rows_and_columns(spark):
    names = ["doc_id", "_id", "_key", "_spans", "key", "batch", "seq", "id", "c0", "c1", "nothing", "size", "places"]
    docs = spark.createDataFrame(awkward_rows(), "doc_id long, text string").select("doc_id", *(F.col("doc_id").cast("string").alias(n) for n in names[1:]), "text")
    got = suffix_dedup.strip_repeats(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() == docs.count()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect() if r["doc_id"] in (7, 21, 31)}
    for r in got.collect():
        assert all(r[n] == (None if r["doc_id"] is None else str(r["doc_id"])) for n in names[1:])
        if r["doc_id"] is None or r["doc_id"] == 7:
            assert (r["doc_id"], r["text"]) in texts
        if r["doc_id"] in (21, 31):
            assert r["text"] == cut[r["doc_id"]]["kept"].decode("utf-8", "ignore")
    assert suffix_dedup.strip_repeats(docs.limit(0)).count() == 0
