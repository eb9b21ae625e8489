"""Locally consistent parsing against a plain parser, and its properties."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import phrases

M = (1 << 64) - 1
GOLD, BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def coin(a, b):
    place = ((a ^ b) & -(a ^ b)).bit_length() - 1
    return 2 * place + ((a >> place) & 1)


def plain_level(symbols, first):
    """[name] of the phrases of one text's symbols, by the definition."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    if not runs:
        return []
    labels = [s for s, _ in runs]
    for k in range(phrases._ROUNDS if first else phrases._ROUNDS + 1):
        mark = 0 if k == 0 and not first else 255
        labels = [coin(x, labels[i - 1] if i else mark) for i, x in enumerate(labels)]
    starts = [i for i in range(len(runs)) if not i or (labels[i] > labels[i - 1] and (i + 1 == len(runs) or labels[i] > labels[i + 1]))]
    out = []
    for a, b in zip(starts, [*starts[1:], len(runs)], strict=True):
        total = sum((s + (r - 1) * GOLD) * pow(BASE, j, 1 << 64) for j, (s, r) in enumerate(runs[a:b]))
        out.append(mix((total + (b - a) * GOLD) & M))
    return out


def plain_sketch(text):
    out, symbols = np.zeros((phrases.LEVELS, phrases.BINS), np.uint16), list(text)
    for k in range(phrases.LEVELS):
        symbols = plain_level(symbols, k == 0)
        seen = {}
        for name in symbols:
            again = seen[name >> 16] = seen.get(name >> 16, -1) + 1
            h = mix(((name >> 16) + again * GOLD) & M)
            value, b = max(h >> 48, 1), h % phrases.BINS
            out[k, b] = min(out[k, b] or 65535, value)
    return out


def texts():
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice("der die und the of a language model corpus data größe naïve 日本".split()) for _ in range(n))
    return ["", "a", "aa", "ab", "x" * 500, "ab" * 300, "\x00\x00z", "🎉é" * 40, *(prose(n) for n in (1, 2, 5, 20, 100, 1000)), prose(400) + "l" * 30]


def test_sketches_equal_a_plain_parse(monkeypatch):
    data = [x.encode() for x in texts()]
    want = np.array([plain_sketch(x) for x in data])
    assert (phrases.sketches(data) == want).all()
    monkeypatch.setattr(phrases, "_POWERS", phrases._POWERS[:300])  # a text longer than the table of powers
    assert (phrases.sketches(data) == want).all()


def test_a_megabyte_and_chunks():
    long = ("".join(chr(97 + i * i % 26) for i in range(1 << 20))).encode()
    both = phrases.sketches([b"before", long, b"after", long])
    assert (both[1] == both[3]).all() and (both[0] == phrases.sketches([b"before"])[0]).all()


def test_equal_substrings_share_phrases_at_any_offset(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    common = " ".join(word() for _ in range(200))
    rows = [(k, " ".join(word() for _ in range(k * 7)) + common + " ".join(word() for _ in range(k * 5))) for k in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in phrases.phrases(docs, 3).collect():
        found.setdefault(r["doc_id"], {})[r["start"]] = (r["name"], r["size"])
    shifted = []
    for i, text in rows:
        at = text.encode().index(common.encode())
        shifted.append({(s - at, n) for s, (n, size) in found[i].items() if s - at >= 150 and s + size - at <= len(common) - 50})
        assert sum(size for _, size in found[i].values()) == len(text)
    assert len(shifted[0]) > 40 and all(x == shifted[0] for x in shifted)


def plain_edits(rows):
    """[(id, text, edited, next)] in order, for distinct ids."""
    rows = sorted(rows)
    out = []
    for (i, text), (_, other) in zip(rows, [*rows[1:], rows[0]], strict=True):
        m = len(text) // 4
        out.append((i, text, text[: len(text) - m] + other[:m], other))
    return out


@pytest.mark.parametrize("range_bytes", [8 << 20, 300])
def test_edits_equal_brute_force(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(phrases, "RANGE_BYTES", range_bytes)
    rows = [(i * 37 % 101, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t or None, "clash") for i, t in rows], "doc_id long, text string, bucket string").repartition(3)
    got = {r["doc_id"]: r for r in phrases.compare_with_edits(docs).collect()}
    assert len(got) == len(rows)
    sketch = lambda x: plain_sketch(x.encode())[None]
    for i, text, edited, other in plain_edits(rows):
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (phrases.from_text([r["fingerprint"], r["edited_fingerprint"]]) == np.concatenate([sketch(text), sketch(edited)])).all()
        assert r["near_edited"] == phrases.likeness(sketch(text), sketch(edited))[0] and r["near_next"] == phrases.likeness(sketch(text), sketch(other))[0]


def test_null_ids_repeats_ties_and_empty_tables(spark):
    text = "one text of several words that repeats " * 9
    rows = [(None, text), (None, None), (5, text), (5, text), (5, text), (7, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = phrases.compare_with_edits(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert len({r["fingerprint"] for r in got if r["n_chars"]}) == 1
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) == 2  # the third is followed by an empty text
    assert phrases.compare_with_edits(docs.limit(0)).count() == 0 == phrases.fingerprint(docs.limit(0)).count() == phrases.phrases(docs.limit(0), 1).count()
    lone = phrases.compare_with_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert lone[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and lone[0]["near_next"] == 1.0
    own = phrases.fingerprint(docs).collect()
    assert {(r["n_chars"], r["fingerprint"]) for r in own} == {(r["n_chars"], r["fingerprint"]) for r in got}


def test_edited_copies_are_near_and_neighbours_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = phrases.compare_with_edits(docs).filter("n_chars >= 200").toPandas()
    assert rows["near_edited"].mean() > 0.65 and (rows["near_edited"] > 0.5).mean() > 0.95
    assert rows["near_next"].mean() < 0.05
