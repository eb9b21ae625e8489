"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Numbers, the units behind them and names become typed placeholders, all other words are lower-cased.
A capitalised word is a name inside a sentence, and at the start of one unless the benchmark has it in lower case.
Windows of WINDOW placeholders and words are joined by hash between documents and benchmark items. For
every document and item that share a window, all places of the item's windows are then checked, and the values
in the placeholders must agree: equal values in the item stand for equal values in the document and the
other way round. So a question whose numbers or names were exchanged consistently is found as well.
Places are judged by alignment (start in the document minus start in the item), so another variant of
the template in the same document does not hide a copy. Documents are judged in overlapping pieces of an item's
length, each different piece once, so a text that repeats itself is judged as often as it has different pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import broadcast_if_small, materialise, materialise_counted, materialise_seen
from .quality import let

WINDOW = 8
#: Least share of an item's windows that a document must hold.
SHARE = 0.5
#: Least words (not placeholders) in a window.
LITERALS = 5
#: Words by which alignments may differ within one copy (words put in or left out).
SLIDE = 8
#: Rows up to which the items' windows, or the pairs found, are broadcast, and the words and windows of items
#: up to which these are; beyond it Spark shuffles.
BROADCAST_ROWS, BROADCAST_WORDS = 200_000, 2_000_000

#: Words in lower case, the most frequent of the benchmark, that are no names where a sentence begins with them.
MOST_COMMON = 2000

NUMBER, UNIT, NAME = "\uE000", "\uE001", "\uE002"
# Units that may follow a number.
UNITS = (
    "km", "cm", "mm", "m", "mi", "miles", "mile", "ft", "feet", "inches", "inch", "yards", "kg", "g", "mg", "lb", "lbs", "pounds", "pound", "tons", "ton",
    "l", "ml", "litres", "liters", "litre", "liter", "gallons", "cups", "s", "sec", "seconds", "second", "min", "minutes", "minute", "h", "hours", "hour",
    "days", "day", "weeks", "week", "months", "month", "years", "year", "mph", "kmh", "percent", "%", "°c", "°f", "degrees", "degree",
    "dollars", "dollar", "cents", "cent", "euros", "euro", "usd", "eur", "gbp", "€", "£",
)
_END = r"(?![\p{L}\p{N}])"
# What stands before is looked at only where a digit or a capital was met.
_NUM = r"([0-9](?<![\p{L}\p{N}" + NUMBER + r"][0-9])[0-9]*(?:[.,][0-9]+)*)"
_MEASURE = _NUM + r"\s?((?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + "))" + _END
#: A capitalised word behind a lower-case word or comma, so not at the start of a sentence.
_NAME = r"\p{Lu}(?<=[\p{Ll},] \p{Lu})\p{Ll}+" + _END
_GAP = r"[^\p{L}\p{N}" + NUMBER + UNIT + NAME + r"]+"


def _branches(words: Sequence[str]) -> str:
    """A pattern for any of the words, which branches where they do."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [head + _branches(rest) for head, rest in sorted(heads.items()) if head]
    return ("(?:" + "|".join(parts) + ")" + "?" * ("" in heads)) if parts else ""


def _first_pattern(common: Sequence[str]) -> str:
    """Any other capitalised word but the ``common`` ones, which are looked for behind their capital only."""
    by_capital: dict[str, list[str]] = {}
    for w in common:
        if len(w) > 1 and w.isalpha() and w[0].upper().lower() == w[0] and len(w[0].upper()) == 1:
            by_capital.setdefault(w[0].upper(), []).append(w[1:])
    known = "|".join(f"(?<={c}){_branches(rest)}" for c, rest in sorted(by_capital.items()))
    return r"\p{Lu}(?<![\p{L}\p{N}" + NAME + r"]\p{Lu})" + (f"(?!(?:{known}){_END})" if known else "") + r"\p{Ll}+" + _END


def _marked(text: Column, common: Sequence[str], values: bool) -> Column:
    """The text with placeholders for numbers, units and names; with ``values`` each is followed by what it replaces."""
    number, unit, name = (NUMBER + "$1", UNIT + "$2", NAME + "$0") if values else (NUMBER, UNIT, NAME)
    named = F.regexp_replace(F.regexp_replace(text, _NAME, name), _first_pattern(common), name)
    counted = lambda n: F.regexp_replace(F.regexp_replace(n, _MEASURE, f"{number} {unit}"), _NUM + _END, number)
    # Bound: the plan would hold the pattern of the common words once a branch.
    return let(named, lambda n: F.when(n.rlike("[0-9]"), counted(n)).otherwise(n))


def _values(text: Column, common: Sequence[str], values: bool = True) -> Column:
    """Words in lower case, those that a placeholder stands for behind it (or left out); ``common`` words are no names."""
    return F.filter(F.split(F.lower(_marked(text, common, values)), _GAP), lambda t: t != "")


def _canonical(value: Column) -> Column:
    first = F.substring(value, 1, 1)
    return F.when(first.isin(NUMBER, UNIT, NAME), first).otherwise(value)


def _window(tokens: Column, start: Column) -> Column:
    return F.xxhash64(F.slice(tokens, start, WINDOW))


def _all_windows(tokens: Column) -> Column:
    last = F.size(tokens) - WINDOW + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: _window(tokens, i))).otherwise(F.array().cast("array<bigint>"))


def common_words(benchmark: DataFrame, text_col: str = "text") -> list[str]:
    """The MOST_COMMON words that the benchmark has in lower case most often, ties by the word."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = benchmark.select(F.explode(_values(text, [])).alias("word")).filter(~F.substring("word", 1, 1).isin(NUMBER, UNIT, NAME))
    return [r["word"] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(MOST_COMMON).collect()]


def items_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", common: Sequence[str] = ()) -> DataFrame:
    """item, version (of its text), values (words with placeholder values), windows (hash, start) that have LITERALS words."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()

    def windows(tokens: Column) -> Column:
        literal = lambda start: F.size(F.filter(F.slice(tokens, start, WINDOW), lambda t: ~t.isin(NUMBER, UNIT, NAME))) >= LITERALS
        each = F.transform(_all_windows(tokens), lambda h, i: F.struct(h.alias("hash"), (i + 1).alias("start")))
        return F.filter(each, lambda w: literal(w["start"]))

    # As one generated row: Spark would put the patterns of ``values`` wherever a column uses it.
    made = let(_values(F.col("text"), common), lambda v: F.struct(v.alias("values"), let(F.transform(v, _canonical), windows).alias("windows")))
    rows = rows.select("item", F.xxhash64("text").alias("version"), F.inline(F.array(made)))
    return rows.filter(F.size("windows") > 0)


def _searched(items: DataFrame) -> DataFrame:
    """item, hash: the windows that make a document a candidate.

    Of an item's n windows a copy has n * SHARE or more, so it has one of any n - n * SHARE + 1. Those that
    are in the fewest items are taken: an instruction that begins all items makes no candidates.
    """
    each = items.select("item", "version", F.size("windows").alias("n"), F.inline("windows"))
    often = each.groupBy("hash").agg(F.countDistinct("item", "version").alias("items"))
    by_rarity = F.sort_array(F.collect_list(F.struct("items", "hash", "start")))
    each = each.join(often, "hash").groupBy("item", "version", "n").agg(by_rarity.alias("windows"))
    few = F.col("n") - F.ceil(F.col("n") * SHARE - 1e-9).cast("int") + 1
    return each.select("item", F.explode(F.slice("windows", F.lit(1), few).getField("hash")).alias("hash")).distinct()


def _judged(places: DataFrame, contents: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, n_matched, exact of the best group of places that passes; rows ``by`` without one are absent.

    ``places``: by, n_windows, grp, a, b (starts in the item and in the text); ``contents``: by, values (of the item), own (of the text).
    A group passes if it has SHARE of the item's windows and its slots are one to one.
    """
    by = list(by)
    # Of each window of the item the first place in the group counts.
    each = places.groupBy(*by, "n_windows", "grp", "a").agg(F.min("b").alias("b"))
    each = each.groupBy(*by, "n_windows", "grp").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("met"))
    each = each.filter(F.size("met") / F.col("n_windows") >= SHARE).drop("n_windows", "grp").distinct()

    def at(p: Column, k: Column) -> Column:
        return F.struct(F.get("values", p["a"] + k - 1).alias("a"), F.get("own", p["b"] + k - 1).alias("b"))

    slots = F.flatten(F.transform("met", lambda p: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: at(p, k))))
    slots = F.array_distinct(F.filter(slots, lambda s: F.substring(s["a"], 1, 1).isin(NUMBER, UNIT, NAME)))
    tried = each.join(contents, by).withColumn("slots", slots)
    one_to_one = (F.size(F.array_distinct("slots.a")) == F.size("slots")) & (F.size(F.array_distinct("slots.b")) == F.size("slots"))
    exact = F.forall("slots", lambda s: s["a"] == s["b"])
    # Written first: a filter on these columns would be pushed down and repeat what they are made of.
    passed = materialise(tried.select(*by, F.size("met").cast("long").alias("n_matched"), exact.alias("exact"), one_to_one.alias("consistent")))
    return passed.filter("consistent").groupBy(*by).agg(F.max(F.struct("n_matched", "exact")).alias("best")).select(*by, "best.*")


def _pieces(near: DataFrame) -> DataFrame:
    """id, key, item, version, n_windows, first, own: pieces of the text in which windows of the item stand.

    A piece has twice the length of the item (and SLIDE), and begins every such length, so each alignment that begins in
    its first half is in it as a whole. ``first`` pieces have those as well that begin before the text.
    """
    reach = F.size("values") + SLIDE
    halves = F.array_distinct(F.transform("found", lambda b: F.floor((b - 1) / reach).cast("int")))
    starts = F.array_distinct(F.flatten(F.transform(halves, lambda i: F.array(i, F.greatest(i - 1, F.lit(0))))))
    # Cut inside the row: a row a place would carry the whole text.
    cut = F.transform(starts, lambda i: F.struct((i == 0).alias("first"), F.slice("own", i * reach + 1, 2 * reach).alias("own")))
    return near.select("id", "key", "item", "version", "n_windows", F.inline(cut))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item it contains; documents without one are absent.

    Columns: ``id_col``, ``item_col``, n_windows (of the item), n_matched, share, exact (no placeholder
    differs), key (hash of id and text); of several copies the one with most matches, an exact one first.
    Null and empty texts match nothing; items of fewer than WINDOW words, or of placeholders mostly, give no
    evidence and match nothing. Rows that repeat an id and a text give one row; null ids are reported as
    null. Texts of any length are searched whole, and those that repeat themselves cost no more than others; other columns,
    whatever their names, are not read. An empty table on either side gives an empty result.
    """
    common = common_words(benchmark, bench_text_col)
    size = F.coalesce(F.sum(F.size("values") + F.size("windows")), F.lit(0))
    items, seen = materialise_seen(items_table(benchmark, item_col, bench_text_col, common), n_words=size)
    n_words = seen["n_words"]
    wanted, n_wanted = materialise_counted(_searched(items))
    known = broadcast_if_small(wanted, n_wanted, BROADCAST_ROWS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    canonical = lambda values: F.transform(values, _canonical)

    # Every word starts a window, in documents as in items.
    searched = rows.select("key", F.explode(F.array_distinct(let(_values(F.col("text"), common, False), _all_windows))).alias("hash"))
    pairs, n_pairs = materialise_counted(searched.join(known, "hash").select("key", "item").distinct())

    near = rows.join(broadcast_if_small(pairs, n_pairs, BROADCAST_ROWS), "key").distinct()
    near = near.withColumn("own", _values(F.col("text"), common)).drop("text")
    near = near.join(broadcast_if_small(items, n_words, BROADCAST_WORDS), "item")
    hashes = F.col("windows.hash")
    # Where windows of the item stand, and for each of these the first place.
    found = lambda own: F.filter(F.transform(own, lambda h, i: F.when(F.array_contains(hashes, h), i + 1)), lambda b: b.isNotNull())
    firsts = lambda own: F.filter(F.transform("windows", lambda w: F.struct(w["start"].alias("a"), F.array_position(own, w["hash"]).cast("int").alias("b"))), lambda p: p["b"] > 0)
    near = near.withColumn("met", let(canonical(F.col("own")), lambda tokens: let(_all_windows(tokens), lambda own: F.struct(found(own).alias("found"), firsts(own).alias("firsts")))))
    near = near.select("id", "key", "item", "version", "values", "windows", "own", "met.found", "met.firsts", F.size("windows").cast("long").alias("n_windows"))
    near = materialise(near).filter(F.size("firsts") / F.col("n_windows") >= SHARE)

    # Each alignment alone, and alignments at most SLIDE apart, in each different piece.
    cut = materialise(_pieces(near).withColumn("piece", F.xxhash64("first", "own")))
    parts = materialise(cut.select("item", "version", "piece", "first", "own").dropDuplicates(["item", "version", "piece"]))
    parts = parts.join(broadcast_if_small(items, n_words, BROADCAST_WORDS), ["item", "version"])
    same = lambda h: F.filter("windows", lambda w: w["hash"] == h)
    met = lambda own: F.filter(F.transform(own, lambda h, i: F.struct((i + 1).alias("b"), same(h).alias("w"))), lambda p: F.size(p["w"]) > 0)
    each = parts.withColumn("own_met", let(canonical(F.col("own")), lambda tokens: let(_all_windows(tokens), met)))
    each = each.select("item", "version", "piece", "first", F.size("values").alias("m"), F.size("windows").cast("long").alias("n_windows"), F.explode("own_met").alias("p"))
    each = each.select("item", "version", "piece", "first", "m", "n_windows", F.col("p.b").alias("b"), F.explode(F.col("p.w")["start"]).alias("a"))
    group = lambda reach, at: F.struct(F.lit(reach).alias("reach"), at.alias("at"))
    shift = F.col("b") - F.col("a")
    slid = F.transform(F.sequence(F.lit(0), F.lit(SLIDE)), lambda k: group(SLIDE, shift - k))
    each = each.withColumn("grp", F.explode(F.concat(F.array(group(0, shift)), slid)))
    own_half = (F.col("grp.at") < F.col("m") + SLIDE) & (F.col("first") | (F.col("grp.at") >= 0))
    by = ["item", "version", "piece", "whole"]
    aligned = each.filter(own_half).select(*by[:3], F.lit(False).alias("whole"), "n_windows", "grp", "a", "b")

    # All first places of the document together: the document is one more piece, judged in the same pass.
    whole = near.select("item", "version", F.col("key").alias("piece"), F.lit(True).alias("whole"), "n_windows", "values", "own", "firsts", "id", "key")
    together = whole.select(*by, "n_windows", group(0, F.lit(0)).alias("grp"), F.inline("firsts"))
    contents = parts.select(*by[:3], F.lit(False).alias("whole"), "values", "own").unionByName(whole.select(*by, "values", "own"))
    judged = _judged(aligned.unionByName(together), contents, by)

    pair = ["id", "key", "item", "version", "n_windows"]
    held = cut.select(*pair, "piece", F.lit(False).alias("whole")).unionByName(whole.select(*pair, "piece", "whole"))
    best = held.join(judged, by).groupBy(*pair).agg(F.max(F.struct("n_matched", "exact")).alias("best"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "best.n_matched",
        (F.col("best.n_matched") / F.col("n_windows")).alias("share"), "best.exact", "key",
    )


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, whatever their names, without the documents that contain a benchmark item.

    Rows that repeat an id and a text go or stay together; null texts stay; an empty table gives an empty one.
    """
    found, n_found = materialise_counted(find(docs, benchmark, id_col, text_col).select("key").distinct())
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    id_, text = F.col(names[docs.columns.index(id_col)]), F.col(names[docs.columns.index(text_col)])
    rows = rows.withColumn("key", F.xxhash64(id_, F.coalesce(text.cast("string"), F.lit(""))))
    found = broadcast_if_small(found, n_found, BROADCAST_ROWS)
    return rows.join(found, "key", "left_anti").select(*names).toDF(*docs.columns)
