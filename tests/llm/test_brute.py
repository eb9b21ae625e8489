"""Queries against plain versions on whole small tables, and the columns that their contracts name."""

import time
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


CONTRACT = {
    "op1": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op3": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op4": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")],
    "op5": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op6": [("doc_id", "bigint"), *((x, "bigint") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean")],
    "op7": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op8": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")],
    "op9": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op10": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op11": [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((x, "bigint") for x in ("a", "l", "r", "n", "score"))],
    "op12": [("doc_id", "bigint"), *((x, "string") for x in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", "boolean")],
    "op13": [("doc_id", "bigint"), ("n_chars", "bigint"), *((x, "string") for x in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", "double"), ("near_next", "double")],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract(spark, name):
    got = queries.queries()[name](spark, DATA)
    want = CONTRACT.get(name.split("_")[0], [("doc_id", "bigint")])
    assert set(want) <= set(got.dtypes)
    rows, n = got.collect(), table(spark, "documents").count()
    assert name.startswith(("op2", "op11")) or len(rows) == n
    fold, rest = {"op1": (5, 0), "op9": (3, 1)}.get(name.split("_")[0], (0, 0))
    if fold:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == rest) and 0 <= r["score"] <= 1 for r in rows)
    if name.startswith("op4"):
        sizes, slots, texts = {}, {}, {}
        for r in rows:
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
            texts.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
        assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 8 and all(len(x) == 1 for x in texts.values())


# ---- templates


def plain_values(text, common):
    number, unit, name = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME

    def capital(m):
        inside = regex.search(r"[\p{Ll},] $", text[: m.start()])
        return m[0] if not inside and m[0].lower() in common else name + m[0]

    text = regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", capital, text)
    if regex.search("[0-9]", text):
        text = regex.sub(decontaminate._MEASURE, lambda m: f"{number}{m[1]} {unit}{m[2]}", text)
        text = regex.sub(decontaminate._NUM + decontaminate._END, lambda m: number + m[1], text)
    return [t for t in regex.split(decontaminate._GAP, text.lower()) if t]


def plain_common(items):
    """Words of the items in lower case."""
    return {t for item in items if item for t in plain_values(item, set()) if t[0] not in {decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME}}


def plain_find(text, item, common):
    marks, width = {decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME}, decontaminate.WINDOW
    own, other = plain_values(text, common), plain_values(item, common)
    canon = lambda values: [v[0] if v[0] in marks else v for v in values]
    a, b = canon(own), canon(other)
    windows = [(tuple(b[i : i + width]), i) for i in range(len(b) - width + 1)]
    windows = [w for w in windows if sum(t not in marks for t in w[0]) >= decontaminate.LITERALS]
    places = [(i, j) for w, i in windows for j in range(len(a) - width + 1) if tuple(a[j : j + width]) == w]
    enough = lambda n: windows and n / len(windows) >= decontaminate.SHARE
    shifts = {j - i for i, j in places}
    groups = [places] + [[p for p in places if p[1] - p[0] == s] for s in shifts]
    groups += [[p for p in places if 0 <= p[1] - p[0] - s + k <= decontaminate.SLIDE] for s in shifts for k in range(decontaminate.SLIDE + 1)]
    best = None
    for group in groups:
        first = {}
        for i, j in group:
            first[i] = min(j, first.get(i, j))
        slots = {(other[i + k], own[j + k]) for i, j in first.items() for k in range(width) if other[i + k][0] in marks}
        if enough(len(first)) and len({x for x, _ in slots}) == len(slots) == len({y for _, y in slots}):
            best = max(best or (0, False), (len(first), all(x == y for x, y in slots)))
    return best


APPLES = "Tom has 12 apples. Ann gives Tom 5 more apples. Bob takes 3 of them. How many apples does Tom have in the end?"
OTHER_APPLES = "Jim has 40 apples. Sue gives Jim 9 more apples. Max takes 8 of them. How many apples does Jim have in the end?"


def test_names_that_begin_sentences(spark):
    clash = OTHER_APPLES.replace("Max", "Jim")
    bench = spark.createDataFrame([(1, APPLES), (2, "Is it known how many people live there now and in the past?")], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate([APPLES, OTHER_APPLES, clash, f"A worksheet. {OTHER_APPLES} And so on.", "Tom went home. Ann gives Bob a book."])), "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["exact"]) for r in decontaminate.find(docs, bench).collect()}
    assert got == {0: (1, True), 1: (1, False), 3: (1, False)}


def test_a_megabyte_that_repeats_itself(spark):
    phrase = "go on and on with words "
    bench = spark.createDataFrame([(1, phrase * 40), (2, APPLES)], "item_id long, text string")
    docs = spark.createDataFrame([(1, phrase * 45_000), (2, (OTHER_APPLES + " ") * 9_000), (3, "word " * 200_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["exact"]) for r in decontaminate.find(docs, bench).collect()}
    n = {r["item"]: r["n"] for r in decontaminate.items_table(bench, common=decontaminate.common_words(bench)).select("item", F.size("windows").alias("n")).collect()}
    assert got == {(1, 1): (n[1], True), (2, 2): (n[2], False)} and time.perf_counter() - began < 90


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [r["text"] for r in table(spark, "benchmark").limit(6).collect()]
    opening = "please read the following short question with care and then answer it in one word"
    items += [f"{opening} {t}" for t in ("how many of the 12 red apples did Tom give to Ann on day 3", "which of the 7 old towns lies 40 km north of Paris or Rome", "the 5 boys ran 30 miles with Bob and 4 dogs behind them")]
    items += [" ".join(f"w{k}" for k in range(n)) for n in (7, 8, 9, 13)]
    items += [APPLES, "go on and on " * 6 + "until 7", "la " * 14]
    texts = [None, "", opening, f"{opening} and so on"]
    for item in items:
        words = item.split()
        for _ in range(5):
            lo = int(rng.integers(len(words)))
            part = words[: int(rng.integers(1, len(words) + 1))] if rng.integers(2) else words[lo:]
            part = [x.replace("12", "99") if rng.integers(3) else x for x in part]
            for _ in range(int(rng.integers(3))):
                part.insert(int(rng.integers(len(part) + 1)), str(rng.choice(["new", "17", "Zoe"])))
            texts.append(" ".join(["pad"] * int(rng.integers(5)) + part + ["end", *words[: int(rng.integers(len(words)))]]))
    texts += ["on and go " * 9 + "go on and on " * 30 + "until 8 or so", "la la x " * 9 + "la " * 41, OTHER_APPLES, f"{APPLES} {OTHER_APPLES}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["exact"]) for r in decontaminate.find(docs, bench).collect()}
    common = plain_common(items)
    want = {(i, k): x for i, t in enumerate(texts) if t for k, item in enumerate(items) if (x := plain_find(t, item, common))}
    assert got == want and len(got) > 20
    clash = docs.select("doc_id", "text", *(F.lit(0).alias(c) for c in ("found_key", "key", "n", "item", "id", "c0")))
    left = decontaminate.remove(clash, bench)
    assert left.columns == clash.columns and {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}


# ---- quality


def spark_hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def plain_grams(text):
    hashes = [spark_hash(w) for w in (text or "").encode().replace(b"\x0b", b" ").split()]
    eight = [h.to_bytes(8, "little") for h in hashes]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [signed(h) % quality.BUCKETS for h in hashes] + [signed(spark_hash(b, spark_hash(a))) % quality.BUCKETS for a, b in zip(eight[:-1], eight[1:], strict=True)]


def test_quality_verdict_equals_brute_force(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    trusted = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    target, corpus = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in texts.items():
        np.add.at(corpus, plain_grams(t), 1)
        if i in trusted:
            np.add.at(target, plain_grams(t), 1)
    ratio = np.log((target + quality.PSEUDO_COUNT) / (target.sum() + quality.PSEUDO_COUNT * quality.BUCKETS)) - np.log((corpus + quality.PSEUDO_COUNT) / (corpus.sum() + quality.PSEUDO_COUNT * quality.BUCKETS))
    good = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    right = 0
    for r in quality.assess(docs, labels).collect():
        score = ratio[plain_grams(texts[r["doc_id"]])].mean() if texts[r["doc_id"]].split() else 0.0
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
        right += good.get(r["doc_id"], -1) == int(r["kept"])
    assert right > 0.85 * len(good)


# ---- toxicity


def test_toxicity_score_equals_brute_force(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    lexicon = toxicity.train(docs, labels.filter(~queries.in_fold(3, 1)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.filter(queries.in_fold(3, 1)).collect() if r["toxic"] is not None}
    right = 0
    for r in toxicity.score(docs, lexicon).collect():
        folded, total = toxicity.fold(texts[r["doc_id"]]), 0.0
        places = lambda entry: [m.start() for m in regex.finditer(regex.escape(" " + entry), folded, overlapped=True)]  # noqa: E731,B023
        skips = [(p, p + len(e) + 1) for e in lexicon.exceptions for p in places(e)]
        for entry, weight in lexicon.weights.items():
            total += weight * sum(not any(a <= p and p + len(entry) + 1 <= b for a, b in skips) for p in places(entry))
        x = np.log1p([total, 100 * total / max(1, folded.count(" ") - 1)])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(lexicon.curve[0] + x @ lexicon.curve[1:]))), abs=1e-9)
        right += toxic.get(r["doc_id"], -1) == int(r["score"] >= queries.TOXIC_FROM)
    assert right >= 0.9 * len(toxic)


# ---- language


def test_texts_that_fit_no_language_are_rejected(spark):
    docs = table(spark, "documents")
    rows = docs.select("doc_id", "text", "lang").collect()
    junk = ["日本語の文章はこの言語モデルには含まれていません。それでも文字があります。", "Это предложение написано на русском языке, которого нет в обучении.", "xqzj kvvw pqqz zxkj wvqx jjqk zzxv qkwj xvzq kjqw pzxq vvkq"]
    own = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows] + [(10_000 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language.keep_recognised(own, language.train(docs)).collect()}
    assert not kept & {10_000, 10_001, 10_002}
    assert {r["doc_id"] for r in rows if r["text"] and len(r["text"]) > 100 and any(map(str.isalpha, r["text"]))} <= kept
    left_out = language.keep_recognised(docs.filter("lang = 'de'"), language.train(docs.filter("lang <> 'de'")))
    assert left_out.columns == docs.columns
    # Of languages that were not learned the rule drops the odd ones only: German here, but not French or Spanish.
    stay = lambda lang: language.keep_recognised(docs.filter(F.col("lang") == lang), language.train(docs.filter(F.col("lang") != lang))).count() / docs.filter(F.col("lang") == lang).count()
    assert left_out.count() <= 0.2 * docs.filter("lang = 'de'").count() and stay("fr") > 0.9 and stay("es") > 0.9
