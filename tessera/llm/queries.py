"""Registered queries of the corpus operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, language, licenses, manifest, phrases, quality, sharding, simhash, suffix_dedup, token_files, toxicity

TOKENIZER = "word_bpe_49k.json"
#: Id that op10 appends to every document.
END_ID = 2
SHARDS = 8
#: Phrases that op11 reports for each language.
PHRASES = 2000
TOXIC_FROM = 0.7
SHINGLE_WORDS, SIMHASH_RADIUS = 4, 4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_fold(modulus: int, remainder: int):
    """Whether crc32 of the document id as text leaves ``remainder``; ids that are null count as not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.filter(~in_fold(5, 0)))
    return language.predict(docs, model).select("doc_id", in_fold(5, 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")


def op3_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), SHINGLE_WORDS, SIMHASH_RADIUS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.byte_balanced(documents(spark, sf_dir), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_ngram_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.train(docs, labels.filter(~in_fold(3, 1)))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    parts = token_files.write(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), folder, END_ID)
    return token_files.checksums(spark, folder, parts)


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.top(collocations.mine(documents(spark, sf_dir)), PHRASES)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.when(in_fold(2, 0), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = manifest.prove(docs, carry={"other": manifest.leaf([text if c == "text" else F.col(c) for c in manifest.FIELDS])})
    proofs = proofs.withColumn("folded_root", manifest.fold(F.col("other"), F.col("path")))
    return proofs.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_parsed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_with_edits(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ppm_language": op1_ppm_language,
        "op2_template_decontamination": op2_template_decontamination,
        "op3_simhash_pigeonhole": op3_simhash_pigeonhole,
        "op4_histogram_sort": op4_histogram_sort,
        "op5_bpe_forced_boundaries": op5_bpe_forced_boundaries,
        "op6_ngram_ratio_quality": op6_ngram_ratio_quality,
        "op7_run_length_repeats": op7_run_length_repeats,
        "op8_license_join": op8_license_join,
        "op9_toxic_lexicon": op9_toxic_lexicon,
        "op10_token_files": op10_token_files,
        "op11_phrase_index": op11_phrase_index,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_parsed_fingerprints": op13_parsed_fingerprints,
    }


def license_sql() -> str:
    """op8 in SQL: phrases by position, templates by their share of distinct words in a window."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    words_of = licenses._template_words(licenses.TEMPLATES)
    own_words, ordered = licenses._own_words(words_of, licenses.PHRASES), licenses._ordered(licenses.TEMPLATES)
    text_of = lambda k: f"' {ordered[k]} '" if k in ordered else "NULL"
    templates = ", ".join(f"('{k}', {quoted(t)}, {licenses._need(t)}, {licenses._span(licenses.TEMPLATES[k])}, CAST({quoted(own_words[k])} AS VARCHAR[]), {text_of(k)})" for k, t in words_of.items())
    wider = ", ".join(f"('{k}', '{o}')" for k, others in licenses._wider(words_of).items() for o in others)
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda text: f"list_filter(regexp_split_to_array({text}, '{gap}'), lambda x: x <> '')"
    places = ", ".join(
        f"list_filter(range(len(ws)), lambda i: {' AND '.join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split()))}) AS p{n}" for n, p in enumerate(licenses.PHRASES)
    )
    every = "list_concat(" * (len(licenses.PHRASES) - 1) + "p0" + "".join(f", p{n})" for n in range(1, len(licenses.PHRASES)))
    own = " || ".join(f"CASE WHEN len(p{n}) > 0 THEN ['{label}'] ELSE CAST([] AS VARCHAR[]) END" for n, label in enumerate(licenses.PHRASES.values()))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT rid, doc_id, {words("t")} AS ws FROM d), p AS (SELECT rid, doc_id, len(ws) AS n_words, {places} FROM w),
    b AS (SELECT rid, doc_id, n_words, {every} AS places, {own} AS base FROM p),
    v(label, tw, need, span, ow, phrase) AS (VALUES {templates}),
    c AS (SELECT rid, ws, label, tw, need, span, ow FROM w, v WHERE len(list_intersect(list_distinct(ws), tw)) >= need AND (phrase IS NULL OR contains(' ' || array_to_string(ws, ' ') || ' ', phrase))),
    l AS (SELECT rid, label, tw, need, ow, list_distinct(ws[pos + 1 : pos + 2 * span]) AS lw FROM (SELECT *, unnest(range(0, len(ws), (span + 1) // 2)) AS pos FROM c)),
    h0 AS (SELECT rid, label, max(len(list_intersect(lw, tw)) / len(tw)) AS share FROM l WHERE len(list_intersect(lw, tw)) >= need AND (len(ow) = 0 OR len(list_intersect(lw, ow)) > 0) GROUP BY rid, label),
    h AS (SELECT * FROM h0 WHERE NOT EXISTS (SELECT 1 FROM h0 o JOIN (VALUES {wider}) x(less, more) ON x.more = o.label WHERE o.rid = h0.rid AND x.less = h0.label)),
    g AS (SELECT rid, list(label) AS more, max(share) AS score FROM h GROUP BY rid)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
    array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, CAST([] AS VARCHAR[]))))), ',') AS labels,
    coalesce(score, 0.0) AS score FROM b LEFT JOIN g USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op8_license_join": license_sql(), "op11_phrase_index": collocations.phrases_sql(PHRASES), "op12_merkle_manifest": manifest.manifest_sql()}
