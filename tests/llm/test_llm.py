"""The corpus operators against brute force and libraries, with awkward inputs."""

import collections
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from test_repeats import plain_repeats
from tessera.llm import bpe, decontaminate, language, licenses, quality, queries, sharding, simhash, token_files, toxicity
from tessera.operators import components

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("key", T.LongType())])
LONG = "the quick brown fox jumps over the lazy dog and runs away from it " * 40
TEXTS = [
    None, "", " \n\t ", "a", "12 34 !!", LONG, LONG, LONG + "tail of the text", "Ärger über Größe: naïve café İstanbul ŉ ſ", "word " * 3000,
    "<|endoftext|> x<|startoftext|>y", "don't we'll 'tis x y  z ́a é", "\x00nul \x1cfs", "日本語 emoji 🎉🎉 ok", "cc by cc by-nc General Public License\nAll rights reserved",
    "Licensed under the Apache License, Version 2.0\nfoo", "IT is 1d10t day: you idiot, idiots and сlown", "x" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated rows, clashing column names."""
    rows = [(i, t, ["en", "de", None][i % 3], "clash", i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id, but a text with words", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# ---- tokens


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    got = docs.select("doc_id", "text").distinct().join(bpe.encode_decode(docs, TOKENIZER).distinct(), "doc_id").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want, r["text"]
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(docs, TOKENIZER).count() == docs.count()
    assert bpe.encode_decode(empty, TOKENIZER).count() == 0


def test_bpe_cuts_inside_words():
    own = bpe.FragmentEncoder(TOKENIZER)
    word = "qzqzxjqkabcqy"
    assert len(own.cuts(word)) > 1 and "".join(own.cuts(word)) == word
    assert np.frombuffer(own.encode(word), "<u4").tolist() == own.library.encode(word, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    own = bpe.FragmentEncoder(TOKENIZER)
    parts = token_files.write(docs, TOKENIZER, str(tmp_path), 2)
    got = token_files.read(spark, str(tmp_path), parts).collect()
    assert len(got) == docs.count()
    ordered = sorted(got, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in ordered:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"])) and r["ids"][-1] == 2
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            assert list(r["ids"][:-1]) == np.frombuffer(own.encode(TEXTS[r["doc_id"]]), "<u4").tolist()
    crc = {r["start"]: r["ids_crc32"] for r in token_files.checksums(spark, str(tmp_path), parts).collect()}
    assert all(crc[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in ordered)
    parts = token_files.write(empty, TOKENIZER, str(tmp_path / "e"), 2)
    assert token_files.read(spark, str(tmp_path / "e"), parts).count() == 0


# ---- language


def test_language_accuracy_and_rejects(spark, docs, empty):
    rows = table(spark, "documents")
    model = language.train(rows.filter(~queries.in_fold(5, 0)))
    got = language.predict(rows, model).join(rows.select("doc_id", "lang"), "doc_id").filter(queries.in_fold(5, 0))
    assert got.filter("lang = lang_pred").count() / got.count() > 0.95
    own = {r["doc_id"]: r for r in language.predict(docs, model).collect() if r["doc_id"] is not None}
    assert all(own[i]["lang_pred"] == "und" and own[i]["score"] == 0 for i in (0, 1, 2, 4))
    assert all(0 <= r["score"] <= 1 for r in own.values())
    assert language.predict(empty, model).count() == 0
    assert language.train(empty) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    kept = language.keep_recognised(docs, model)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR trim(text) = ''").count() == 0


def test_code_lengths_equal_a_plain_context_walk():
    texts = {"a": b"    abracadabra abracadabra", "b": b"    banana bandana banana"}
    counts = []
    for k in range(language.ORDER + 1):
        seen = [(lang, g, n) for lang, t in enumerate(texts.values()) for g, n in collections.Counter(language.grams(np.frombuffer(t, np.uint8))[k].tolist()).items() if k < 3 or n >= language.LEAST_SEEN]
        counts.append(tuple(np.array(x, dtype=d) for x, d in zip(zip(*seen, strict=True), (np.int64, np.uint64, float), strict=True)))
    model = language.Model(["a", "b"], counts)

    def plain(lang, data):
        bits = 0.0
        for i in range(language.ORDER, len(data)):
            for k in range(language.ORDER, -1, -1):
                lang_, gram, n = counts[k]
                own = {g: c for x, g, c in zip(lang_, gram.tolist(), n, strict=True) if x == lang and g >> 8 == int.from_bytes(data[i - k : i], "big")}
                if not own:
                    continue
                total, kinds = sum(own.values()), len(own)
                c = own.get(int.from_bytes(data[i - k : i + 1], "big"))
                bits -= np.log2((c if c else kinds) / (total + kinds))
                if c:
                    break
            else:
                bits += 8
        return bits

    for text in (b"    abra banana zz", b"    x", b"    "):
        got = model.code_lengths([text, b"    pad"])[0]
        assert np.allclose(got, [plain(0, text), plain(1, text)], atol=1e-4)
    whole = language.CHUNK
    language.CHUNK = 3
    try:
        assert np.allclose(model.code_lengths([b"    abra banana zz"])[0], plain(0, b"    abra banana zz") * np.array([1, 0]) + plain(1, b"    abra banana zz") * np.array([0, 1]), atol=1e-4)
    finally:
        language.CHUNK = whole


# ---- near duplicates


def plain_fingerprint(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash(docs, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, 4, 4).collect() if r["doc_id"] is not None}
    fps = [plain_fingerprint(t) for t in TEXTS]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(TEXTS))] == fps
    assert [got[i]["component_id"] for i in range(len(TEXTS))] == plain_components(fps, 4)
    assert simhash.near_duplicates(empty, 4, 4).count() == 0
    kept = simhash.keep_first(docs, 4, 4)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 1 and kept.filter("doc_id = 6").count() == 0
    clash = docs.select("doc_id", "text", *(F.lit(n).alias(n) for n in ("_first", "id", "fp", "row", "n", "c0", "node")))
    assert simhash.keep_first(clash, 4, 4).columns == clash.columns and simhash.keep_first(empty, 4, 4).count() == 0


def test_other_texts_under_one_id_stay(spark):
    rows = [(1, LONG), (1, "an entirely different text of eight words here"), (2, LONG), (1, LONG), (None, "words without any id at all, twice"), (None, "words without any id at all, twice")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 4)
    assert sorted(kept.collect(), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)


@pytest.mark.parametrize("block", [1024, 8])
def test_links_keep_every_component(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(12):
            for b in rng.choice(63, rng.integers(1, 7), replace=False):
                s ^= 1 << int(b)
            fps.add(s)
    fps = sorted(fps)
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = [fps[x] for x in plain_components(fps, 4)]
    assert [roots.get(x, x) for x in fps] == want


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_thresholds_sum_to_the_radius(radius):
    sample = np.random.default_rng(0).integers(0, 1 << 63, 200).astype(np.uint64)
    plan = simhash.allocate(sample, 1000, radius)
    assert sum(t + 1 for _, t in plan) == radius + 1
    assert sorted(b for bits, _ in plan for b in bits) == list(range(64))


def test_components_of_a_chain(spark):
    n = 40
    got = components.components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")).collect()
    assert {r["root"] for r in got if r["node"] <= n} == {0} and {r["root"] for r in got if r["node"] >= 100} == {100}


# ---- shards


def test_shards(docs, empty):
    got = sharding.byte_balanced(docs, 8).collect()
    assert len(got) == docs.count()
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert sizes[5] == (len(LONG) + 1, zlib.crc32(LONG.encode())) and sizes[0] == (1, 0)
    assert sharding.byte_balanced(empty, 8).count() == 0


def test_shards_are_near_equal_and_split_a_hot_text(spark):
    hot = [(i, "same text for a third of all rows", None, None, None) for i in range(1500)]
    rest = [(10_000 + i, f"text {i} " * (1 + i % 7), None, None, None) for i in range(3000)]
    got = sharding.byte_balanced(spark.createDataFrame(hot + rest, SCHEMA), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 8 and max(sizes) / (sum(sizes) / 8) < 1.01 and min(sizes) / (sum(sizes) / 8) > 0.99


# ---- quality, licenses, benchmark


def test_quality_base_counts(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1), (8, 1), (9, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.assess(docs, labels).collect() if r["doc_id"] is not None}
    for i, text in enumerate(TEXTS):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, windows = len(words), [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        count, covered = collections.Counter(windows), set()
        for k, w in enumerate(windows):
            covered |= set(range(k, k + 8)) if count[w] > 1 else set()
        lines, seen, again = text.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)), text[:50]
        assert r["base_failed"] == (n < 20 or 100 * len(covered) > 30 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality.assess(empty, labels).count() == 0
    assert {r["score"] for r in quality.assess(docs, labels.limit(0)).collect()} == {0.0}


def test_quality_separates_labelled_documents(spark):
    rows, labels = table(spark, "documents"), table(spark, "labels")
    got = quality.assess(rows, labels).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r["quality"]: r["k"] for r in got.collect()}
    assert share[1] > 0.95


def test_license_scan(docs, empty):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect() if r["doc_id"] is not None}
    assert (got[14]["n_words"], got[14]["n_base"], got[14]["first_word"], got[14]["last_word"]) == (11, 4, 0, 8)
    assert got[14]["base_labels"] == "cc-by,gpl,reserved" and "all-rights-reserved" in got[14]["labels"]
    assert got[15]["labels"] == "apache-2.0" and got[15]["score"] == 1.0 and got[15]["n_base"] == 0
    assert got[0]["n_words"] == 0 and got[0]["labels"] == "" and got[0]["first_word"] is None and got[0]["score"] == 0
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


@pytest.mark.parametrize("width", [20, 30, 45, 70])
def test_license_scan_finds_wrapped_notices(spark, width):
    import textwrap

    notice = lambda text: "\n".join(" * " + x for x in textwrap.wrap(text, width))
    rows = [(i, "some code\n" * (3 * i) + notice("Copyright someone. " + t) + "\nmore code", None, None, None) for i, t in enumerate(licenses.TEMPLATES.values())]
    rows.append((99, "all of it\n" + "other words\n" * 40 + "rights\n" + "other words\n" * 40 + "reserved", None, None, None))
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, k in enumerate(licenses.TEMPLATES):
        assert k in got[i][0] and got[i][1] == 1.0, k
    assert got[99] == ([""], 0.0)


def test_licenses_that_differ_by_a_word(spark):
    want = {
        licenses.TEMPLATES["cc-by-4.0"]: "cc-by-4.0", licenses.TEMPLATES["cc-by-sa-4.0"]: "cc-by-sa-4.0", "Licensed under CC BY 4.0": "cc-by",
        licenses.TEMPLATES["gpl-notice"]: "gpl,gpl-notice", licenses.TEMPLATES["lgpl-notice"]: "gpl,lgpl-notice", "the license MIT accepted": "",
        "all human rights are reserved": "", "Released under the MIT License.": "mit-named", "(c) all rights-reserved": "all-rights-reserved,reserved",
    }
    rows = [(i, f"Notice: {t}. And more", None, None, None) for i, t in enumerate(want)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (i, text, *_), labels in zip(rows, want.values(), strict=True):
        assert got[i][0] == labels, text
        assert (got[i][1] > 0) == any(x in licenses.TEMPLATES for x in labels.split(","))


def test_license_join_equals_brute_force(spark):
    templates = licenses._template_words(licenses.TEMPLATES)
    rng, rows = np.random.default_rng(5), []
    for i in range(150):
        words = list(templates[rng.choice(sorted(templates))])
        drop = rng.random(len(words)) < rng.choice([0.0, 0.15, 0.3])
        words = [w for w, d in zip(words, drop, strict=True) if not d] + [f"w{rng.integers(9)}" for _ in range(rng.integers(4))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), None, None, None))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA), phrases={"zz yy": "z"}).collect()}
    for i, text, *_ in rows:
        share = {k: len(set(t) & set(text.split())) / len(t) for k, t in templates.items()}
        want = {k: v for k, v in share.items() if v >= licenses.CONTAINMENT - 1e-9}
        others = lambda k: {w for j, t in templates.items() if j != k for w in t}
        want = {k: v for k, v in want.items() if set(templates[k]) <= others(k) or set(text.split()) & (set(templates[k]) - others(k))}
        in_order = lambda k: f" {' '.join(re.findall('[a-z0-9]+', licenses.TEMPLATES[k].lower()))} "
        want = {k: v for k, v in want.items() if in_order(k).count(" ") > licenses.ORDERED or in_order(k) in f" {text} "}
        want = {k: v for k, v in want.items() if not any(set(templates[k]) < set(templates[o]) for o in want)}
        assert got[i]["labels"] == ",".join(sorted(want)) and got[i]["score"] == pytest.approx(max(want.values(), default=0.0))


def test_decontamination(spark, docs, empty):
    question = "we know that Alice buys 12 apples and pays 5 dollars for each one in the market before she sells 3 of them to Bob"
    changed = question.replace("Alice", "Carol").replace("12", "17").replace("5 dollars", "9 euros").replace("Bob", "Dave")
    clash = question.replace("Alice", "Carol").replace("12", "5").replace("Bob", "Carol")
    rows = [(1, f"Start here. {question}. End", "x", None, None), (2, changed, None, None, None), (3, clash, None, None, None), (1, f"Start here. {question}. End", "x", None, None), (None, None, None, None, None), (5, "", None, None, None)]
    own = spark.createDataFrame(rows, SCHEMA).unionByName(docs)
    bench = spark.createDataFrame([(7, f"Then {question}."), (8, None), (9, "too short"), (7, f"Then {question}.")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.find(own, bench).collect()}
    assert got == {(1, 7): True, (2, 7): False}
    left = decontaminate.remove(own, bench)
    assert left.columns == own.columns and left.filter("key IS NULL AND doc_id < 3 AND text like '%market%'").count() == 0 and left.count() == own.count() - 3
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_decontamination_meets_every_alignment(spark):
    items = {
        1: "seven grey herons stood beside the frozen pond",  # one window
        2: "seven grey herons stood beside the frozen pond at dawn",
        3: "from 3 to 5 and 7 or 9 we go 4 by 6 with 8 men",  # every other window has too few literals
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    counts = {r["item"]: r["n"] for r in decontaminate.items_table(bench).select("item", F.size("windows").alias("n")).collect()}
    assert counts[1] == 1 and counts[2] == 3 and counts[3] == 4
    rows = [(10 * i + pad, "pad " * pad + t, None, None, None) for i, t in items.items() for pad in range(8)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert {(10 * i + pad, i) for i in items for pad in range(8)} <= got


def test_decontamination_finds_a_copy_behind_a_variant(spark):
    question = "we know that Alice buys 12 apples and pays 5 dollars for each one in the market before she sells 3 of them to Bob"
    clash = question.replace("Alice", "Carol").replace("12", "5").replace("Bob", "Carol")
    changed = question.replace("Alice", "Carol").replace("12", "17").replace("5 dollars", "9 euros").replace("Bob", "Dave")
    opening = "we know that Alice buys 12 apples and pays 7 dollars for each one at home."
    longer = question.replace("in the market", "in the very old market")
    texts = [f"{clash}. {question}", f"{opening} {question}", f"{changed}. {question}", f"{clash}. {changed}", f"{clash}. {longer}", longer, clash, f"{clash}. {clash}", f"{question}. {clash}"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    bench = spark.createDataFrame([(7, question)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_matched"], r["exact"]) for r in decontaminate.find(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    n = decontaminate.items_table(bench).select(F.size("windows")).first()[0]
    assert {i: got[i] for i in (0, 1, 2, 3, 8)} == {0: (n, True), 1: (n, True), 2: (n, True), 3: (n, False), 8: (n, True)}
    assert got[4] == got[5] and got[5][1] and not {6, 7} & set(got)


def test_decontamination_finds_planted_passages(spark):
    rows, bench = table(spark, "documents"), table(spark, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(rows, bench).collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in rows.collect() for i, t in items if t in r["text"]}
    assert want <= got and len(got - want) <= 1


# ---- toxicity


def test_toxicity(spark, docs, empty):
    rows, labels = table(spark, "documents"), table(spark, "labels")
    lexicon = toxicity.train(rows, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.Lexicon({"idiot ": 7.0, "clown ": 7.0})).collect() if r["doc_id"] is not None}
    assert got[16] > 0.7 > got[5] and all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] == got[2] < 0.7
    assert toxicity.score(empty, lexicon).count() == 0 and toxicity.score(docs, lexicon).count() == docs.count()
    assert set(toxicity.train(docs, labels.limit(0)).weights) == set(toxicity.SEED_LEXICON)


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T! ѕtuріd") == " idiot stupid "
    own = toxicity.Lexicon({"clown ": 5.0}, exceptions=("clown fish ",)).automaton()
    assert toxicity.features(own, "a clown fish swims")[0] == 0 and toxicity.features(own, "a clown, a clown fish")[0] == pytest.approx(np.log1p(5.0))


# ---- pipeline


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    rows = table(spark, "documents")
    left = rows.collect()
    step = [f for _, f in pipeline.STAGES]
    one = pipeline.materialise(step[0](spark, rows, DATA))
    assert one.columns == rows.columns and one.filter("NOT text rlike '\\\\p{L}'").count() == 0
    two = pipeline.materialise(step[1](spark, one, DATA))
    fps = sorted((r["doc_id"], plain_fingerprint(r["text"], pipeline.NEAR_WORDS)) for r in one.collect())
    roots = plain_components([f for _, f in fps], pipeline.NEAR_RADIUS)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({fps[x][0] for x in roots})
    three = pipeline.materialise(step[2](spark, two, DATA))
    cut = plain_repeats([(r["doc_id"], r["text"].encode()) for r in two.collect()])
    assert all(abs(len(r["text"].encode()) - (cut[r["doc_id"]][0] - cut[r["doc_id"]][1])) <= 6 * cut[r["doc_id"]][2] for r in three.collect())
    four = pipeline.materialise(step[3](spark, three, DATA))
    items = [r["text"] for r in table(spark, "benchmark").collect()]
    assert four.columns == rows.columns and not [r for r in four.collect() if any(t in r["text"] for t in items)]
    five = {r["doc_id"]: list(r["ids"]) for r in step[4](spark, four, DATA).collect()}
    library = Tokenizer.from_file(TOKENIZER)
    assert five == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in four.collect()}
    assert len(five) <= len(left)


def test_pipeline_stages_take_awkward_rows(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    table(spark, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = docs.select("doc_id", "text", "lang", *(F.lit(c).alias(c) for c in ("_id", "_key", "_spans", "_first", "found_key", "key", "n", "batch", "row", "fp", "id", "c0")))
    for rows in (clash.limit(0), clash):
        for name, stage in pipeline.STAGES:
            left = pipeline.materialise(stage(spark, rows, str(tmp_path)))
            assert left.count() <= rows.count()
            if name != "encoding":
                assert left.dtypes == rows.dtypes
            if name == "repeat_removal":
                assert left.count() == rows.count()
            rows = left
    assert rows.count() > 3
