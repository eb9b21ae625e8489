"""License scan: exact set-similarity join of text blocks with license templates, without Python code.

A block is a run of words, across line breaks, since notices are wrapped: for a template of n words those
are windows of 2n words, one every n / 2 words, so a notice spread over 1.5n words is whole in one of
them, and words scattered over a long line are not taken for a notice. A template applies to a block that holds at least CONTAINMENT of the template's
distinct words. Words are ordered by their frequency over all documents, rarest first: a block that
meets the threshold must hold one of the template's first |T| - need + 1 words (prefix filter), must
have at least ``need`` words (length filter), and the words from the first common one on must suffice
(positional filter). What passes is verified by the full intersection. Templates that differ by a word or two are told
apart by the words that no other template has, of which a block must hold one, and a template gives way to one that
has all its words and more; a template of under ORDERED words must stand in the text word by word.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialise

from .common import lower_ascii

CONTAINMENT = 0.8
#: Words of a template below which their order counts.
ORDERED = 6
#: Separators of words: ASCII other than letters and digits (after lower-casing).
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that are counted wherever they stand, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices as they are commonly written, with their labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-named": "MIT License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "all-rights-reserved": "All rights reserved",
    "proprietary": "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential",
}


def _spaced(text: Column) -> Column:
    """Words separated by one space, none outside."""
    return F.trim(F.regexp_replace(lower_ascii(text), _GAP, " "))


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    return {k: list(dict.fromkeys(w for w in re.split(_GAP, v.lower()) if w)) for k, v in templates.items()}


def _span(template: str) -> int:
    """Words of a template, repeated ones included."""
    import re

    return sum(1 for w in re.split(_GAP, template.lower()) if w)


def _own_words(templates: dict[str, list[str]], phrases: dict[str, str]) -> dict[str, list[str]]:
    """Of each template the words that no other and no phrase has."""
    shared = {w for p in phrases for w in p.split()}
    return {k: [w for w in t if w not in shared and not any(w in o for j, o in templates.items() if j != k)] for k, t in templates.items()}


def _wider(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """Of each template those that have all its words and more."""
    return {k: w for k, t in templates.items() if (w := sorted(j for j, o in templates.items() if set(t) < set(o)))}


def _without(met: Column, label: str, unless: Column) -> Column:
    return F.filter(met, lambda m: (m["label"] != label) | unless)


def _ordered(templates: dict[str, str]) -> dict[str, str]:
    """The short templates as words between single spaces."""
    import re

    return {k: " ".join(w for w in re.split(_GAP, v.lower()) if w) for k, v in templates.items() if _span(v) < ORDERED}


def _need(words: list[str]) -> int:
    return ceil(CONTAINMENT * len(words) - 1e-9)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts every place where a phrase's words stand consecutively; first_word and last_word
    are the smallest and largest starts (words from 0, null without a place). ``labels`` joins the
    phrases' labels with those of the templates found; ``score`` is the largest containment among these, else 0. Null and empty texts have no words; label columns are then empty strings.
    Repeated rows and null ids are kept row by row, texts of any length are read whole, other columns are
    not read, and an empty table gives an empty result.
    """
    ordered = _ordered(TEMPLATES if templates is None else templates)
    spans = {k: _span(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    templates = _template_words(TEMPLATES if templates is None else templates)
    phrases = PHRASES if phrases is None else phrases
    known = F.array(*(F.lit(w) for w in sorted({w for t in templates.values() for w in t})))
    any_phrase = "(?:" + "|".join(phrases) + ")"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("spaced", _spaced(F.col("text")))
    rows = rows.withColumn("words", _words(F.col("spaced"))).withColumn("padded", F.concat(F.lit(" "), "spaced", F.lit(" ")))
    rows = rows.withColumn("hits", F.array_intersect("words", known))
    found = F.lit(False)
    for p in phrases:
        found = found | F.col("padded").contains(f" {p} ")
    held = lambda words: F.size(F.array_intersect("hits", F.array(*map(F.lit, words)))) >= _need(words)
    open_spans = F.array_distinct(F.array_compact(F.array(*(F.when(held(t), F.lit(spans[k])) for k, t in templates.items())).cast("array<int>")))
    head, tail = F.regexp_extract("padded", f"(?s)^(.*? ){any_phrase}(?= )", 1), F.regexp_extract("padded", f"(?s)^(.* ){any_phrase}(?= )", 1)
    starts = lambda prefix: (F.length(prefix) - F.length(F.translate(prefix, " ", "")) - 1).cast("long")
    base = F.array_compact(F.array(*(F.when(F.col("padded").contains(f" {p} "), F.lit(label)) for p, label in phrases.items())))
    rows = materialise(
        rows.select(
            "row",
            "id",
            F.size("words").cast("long").alias("n_words"),
            F.when(found, F.regexp_count("padded", F.lit(f"(?<= ){any_phrase}(?= )")).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_base"),
            F.when(found, starts(head)).alias("first_word"),
            F.when(found, starts(tail)).alias("last_word"),
            F.array_sort(base).alias("base"),
            "hits",
            open_spans.alias("spans"),
            F.array_compact(F.array(*(F.when(F.col("padded").contains(f" {p} "), F.lit(k)) for k, p in ordered.items())).cast("array<string>")).alias("in_order"),
            F.when(F.size(open_spans) > 0, F.col("text")).alias("text"),
        )
    )
    # Templates are a fixed list, so these two tables are bounded by its number of words.
    frequency = {r["w"]: r["n"] for r in rows.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted({w for t in templates.values() for w in t}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranked = {k: sorted(t, key=rank.__getitem__) for k, t in templates.items()}
    prefixes = [(w, k, i, len(t), _need(t), spans[k]) for k, t in ranked.items() for i, w in enumerate(t[: len(t) - _need(t) + 1])]
    spark = docs.sparkSession
    prefix = F.broadcast(spark.createDataFrame(prefixes, "word string, label string, t_at int, t_size int, need int, span int"))
    own_words = _own_words(templates, phrases)
    whole = F.broadcast(spark.createDataFrame([(k, t, own_words[k]) for k, t in ranked.items()], "label string, t_words array<string>, t_own array<string>"))

    # Windows only of the spans whose templates the whole text could meet, and of them only the templates' words.
    texts = rows.filter("text IS NOT NULL").select("row", "spans", _words(_spaced(F.col("text"))).alias("every"))
    least = min((_need(t) for t in templates.values()), default=1)

    def windows(every: Column, span: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(every) - 1, F.floor((span + 1) / 2).cast("int"))
        own = lambda at: F.array_intersect(F.array(*map(F.lit, order)), F.slice(every, at + 1, span * 2))
        found = F.transform(starts, lambda at: F.struct(F.struct(span.alias("span"), at.alias("at")).alias("block"), own(at).alias("own")))
        return F.filter(found, lambda w: F.size(w["own"]) >= least)

    blocks = texts.filter(F.size("every") > 0).withColumn("span", F.explode("spans"))
    blocks = blocks.select("row", F.inline(windows(F.col("every"), F.col("span"))))
    common = blocks.select("row", "block", "own", F.posexplode("own").alias("b_at", "word")).join(prefix, "word")
    common = common.filter(F.expr("size(own) >= need AND block.span = span"))
    first = common.groupBy("row", "block", "label", "t_size", "need").agg(F.min(F.struct("b_at", "t_at")).alias("at"), F.first("own").alias("own"))
    possible = first.filter(1 + F.least(F.col("t_size") - F.col("at.t_at") - 1, F.size("own") - F.col("at.b_at") - 1) >= F.col("need"))
    verified = possible.join(whole, "label").withColumn("share", F.size(F.array_intersect("own", "t_words")) / F.col("t_size"))
    verified = verified.filter((F.col("share") * F.col("t_size") >= F.col("need")) & ((F.size("t_own") == 0) | F.arrays_overlap("own", "t_own")))
    verified = verified.groupBy("row", "label").agg(F.max("share").alias("share"))
    matched = verified.groupBy("row").agg(F.collect_list(F.struct("label", "share")).alias("met"))  # a row a template
    short = list(ordered)
    told = F.filter("met", lambda m: (~m["label"].isin(short) | F.array_contains("in_order", m["label"])) if short else F.lit(True))
    out = rows.drop("text", "hits", "spans").join(matched, "row", "left").withColumn("met", told)
    for k, others in _wider(templates).items():
        stays = ~F.arrays_overlap("met.label", F.array(*map(F.lit, others)))
        out = out.withColumn("met", _without(F.col("met"), k, stays))
    out = out.withColumns({"more": F.col("met.label"), "score": F.array_max("met.share")})
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
