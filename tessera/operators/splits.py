"""Group-disjoint splits in seeded hash order, and audits of what two splits share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_ranked, match


def _cuts(parts: dict[str, float], total: Column, at_least_one: bool) -> list[tuple[str, Column | None]]:
    """Names with their upper rank; counts are floors and the last name takes the rest."""
    out, upper = [], F.lit(0)
    names = list(parts)
    for i, name in enumerate(names[:-1]):
        share = F.floor(total * F.lit(parts[name]) + F.lit(1e-9))
        upper = upper + (F.greatest(F.lit(1), share) if at_least_one and not i else share)
        out.append((name, upper))
    return [*out, (names[-1], None)]


def _named(rank: Column, cuts: list[tuple[str, Column | None]]) -> Column:
    split = F.lit(cuts[-1][0])
    for name, upper in reversed(cuts[:-1]):
        split = F.when(rank <= upper, name).otherwise(split)
    return split


def split_groups(df: DataFrame, keys: Sequence[str], parts: dict[str, float], seed: int = 42, by: Sequence[str] = (), at_least_one: bool = False) -> DataFrame:
    """Adds ``split``: all rows of a group (equal ``keys``) go to one part, groups are dealt by share.

    ``by`` divides inside each stratum. The shares count groups, not rows; with ``at_least_one`` the
    first part is never empty. Every row stays: nulls are a group, or a stratum, of their own.
    """
    groups = hash_ranked(df.select(*by, *keys).distinct(), seed, [*keys], by, total="_groups")
    groups = groups.select(*by, *keys, _named(F.col("rank"), _cuts(parts, F.col("_groups"), at_least_one)).alias("split"))
    return match(df, groups, [*by, *keys])


def split_fixed(df: DataFrame, keys: Sequence[str], counts: dict[str, int], rest: str, seed: int = 42) -> DataFrame:
    """Adds ``split`` with a fixed number of groups for each name; ``rest`` takes the remaining ones."""
    upper, cuts = 0, []
    for name, n in counts.items():
        upper += n
        cuts.append((name, F.lit(upper)))
    groups = hash_ranked(df.select(*keys).distinct(), seed, keys)
    return match(df, groups.select(*keys, _named(F.col("rank"), [*cuts, (rest, None)]).alias("split")), keys)


def split_rows(df: DataFrame, key: str, parts: dict[str, float], by: Sequence[str], seed: int = 42) -> DataFrame:
    """Adds ``split`` row by row, by share inside each stratum ``by``; ``key`` is unique."""
    rows = hash_ranked(df, seed, [key], by, total="_rows")
    return rows.withColumn("split", _named(F.col("rank"), _cuts(parts, F.col("_rows"), False))).drop("rank", "_rows")


def split_stats(df: DataFrame, identity: str = "identity", label: str = "label") -> DataFrame:
    """split, total, real, fake, identities, fake_real_ratio."""
    out = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == 0).alias("real"),
        F.count_if(F.col(label) == 1).alias("fake"),
        F.countDistinct(identity).alias("identities"),
    )
    return out.withColumn("fake_real_ratio", F.col("fake") / F.greatest(F.lit(1), F.col("real")))


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """split_a, split_b, shared: how many keys each pair of splits has in common (pairs without one: absent)."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(F.inline(pairs)).groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


def leakage_by_level(df: DataFrame, levels: Mapping[str, str], split: str = "split") -> DataFrame:
    """level, split_a, split_b, shared: ``leakage`` of several keys (a subject's, a video's, ...), each a column of its own."""
    audits = [leakage(df, key, split).withColumn("level", F.lit(level)) for level, key in levels.items()]
    return reduce(DataFrame.unionByName, audits)


def overlap(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """by, left_keys, shared, share: distinct keys of ``left`` that ``right`` has too, for each class."""
    keys = left.select(by, key).distinct()
    known = right.select(key).distinct().withColumn("_known", F.lit(1))
    out = keys.join(known, key, "left").groupBy(by).agg(F.count(F.lit(1)).alias("left_keys"), F.count("_known").alias("shared"))
    return out.withColumn("share", F.col("shared") / F.col("left_keys"))


def novelty(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """column, status: values of ``test`` that ``train`` has (seen) or hasn't (unseen)."""
    seen = test.select(column).intersect(train.select(column)).withColumn("status", F.lit("seen"))
    return seen.unionByName(test.select(column).subtract(train.select(column)).withColumn("status", F.lit("unseen")))


def leave_one_out(df: DataFrame, column: str, always: str | None = None) -> DataFrame:
    """fold, role and the row: one fold for each value; its rows are test, all others train.

    The number of folds is the number of distinct values (a small dimension); ``always`` names a value
    without a fold of its own, whose rows train in every fold. The result has a row for each row and fold;
    ``fold_sizes`` counts them without making them.
    """
    folds = df.select(F.col(column).alias("fold")).distinct()
    if always is not None:
        folds = folds.filter(F.col("fold") != always)
    return df.crossJoin(F.broadcast(folds)).withColumn("role", F.when(F.col(column) == F.col("fold"), "test").otherwise("train"))


def fold_sizes(df: DataFrame, column: str, counts: Sequence[Column], always: str | None = None) -> DataFrame:
    """fold, role and ``counts`` (sums over rows, named) of the folds of ``leave_one_out``.

    Rows are summed for each value first, and a training set is everything less its fold's own rows, so
    rows never meet folds.
    """
    names = [f"_s{i}" for i in range(len(counts))]
    each = df.groupBy(column).agg(*counts)
    columns = [c for c in each.columns if c != column]
    whole = each.agg(*(F.sum(c).alias(n) for c, n in zip(columns, names, strict=True)))
    folds = each.filter(F.col(column).isNotNull())
    folds = (folds if always is None else folds.filter(F.col(column) != always)).crossJoin(F.broadcast(whole))  # one row
    test = folds.select(F.col(column).alias("fold"), F.lit("test").alias("role"), *columns)
    train = folds.select(F.col(column).alias("fold"), F.lit("train").alias("role"), *((F.col(n) - F.col(c)).alias(c) for c, n in zip(columns, names, strict=True)))
    return test.unionByName(train)
