"""Balanced, capped and quota samples in seeded hash order; every choice is reproducible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_ranked, match, seeded, uniform
from tessera.functions.shared import broadcast_if_small, materialise

#: Spark's own bound for cutting groups before a shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def balance(df: DataFrame, key: str, label: str = "label", by: Sequence[str] = (), seed: int = 42, cap: int | None = None, keep_single: bool = False) -> DataFrame:
    """As many rows of class 0 as of class 1 in each group ``by``: the smaller class, at most ``cap`` // 2.

    Groups without one of the classes give nothing, or all their rows with ``keep_single``.
    """
    sides = df.groupBy(*by).agg(F.count_if(F.col(label) == 0).alias("_zeros"), F.count_if(F.col(label) == 1).alias("_ones"))
    n = F.least("_zeros", "_ones")
    n = n if cap is None else F.least(n, F.lit(cap // 2))
    sides = sides.select(*by, n.alias("_take"))
    rows = hash_ranked(df, seed, [key], [*by, label])
    rows = match(rows, sides, by) if by else rows.crossJoin(F.broadcast(sides))  # one row of counts
    keep = F.col("rank") <= F.col("_take")
    return rows.filter(keep | (F.col("_take") == 0) if keep_single else keep).drop("rank", "_take")


def cap(df: DataFrame, key: str, by: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each group (nulls are one), in hash order.

    Up to GROUP_LIMIT rows Spark cuts each partition's groups before the shuffle; beyond it groups are
    ranked in two levels, so that a large one is not ordered in one task.
    """
    if n > GROUP_LIMIT:
        return hash_ranked(df, seed, [key], by).filter(F.col("rank") <= n).drop("rank")
    rows = df.withColumn("_hash", seeded(seed, key))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_hash", key))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_hash", "_rank")


def quota(df: DataFrame, key: str, quotas: DataFrame, by: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``quota`` rows of each group, from a table (by..., quota); groups without one give nothing."""
    return match(hash_ranked(df, seed, [key], by), quotas.select(*by, "quota"), by).filter(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def quota_with_topup(df: DataFrame, key: str, by: Sequence[str], per_group: int, total: int, seed: int = 42) -> DataFrame:
    """``per_group`` rows of each group, then the first leftovers in hash order until there are ``total``."""
    rows = hash_ranked(df, seed, [key], by, name="_own").withColumn("_first", F.col("_own") <= per_group)
    taken = rows.agg(F.count_if("_first").alias("_taken"))
    left = hash_ranked(rows.filter(~F.col("_first")), seed, [key], name="_left")
    more = left.crossJoin(F.broadcast(taken)).filter(F.col("_left") <= total - F.col("_taken"))  # one row
    return rows.filter("_first").select(df.columns).unionByName(more.select(df.columns))


def deficit_fill(first: DataFrame, second: DataFrame, key: str, total: int, seed: int = 42) -> DataFrame:
    """``first``'s rows up to ``total`` in hash order; what is missing comes from ``second``; adds ``origin``."""
    own = hash_ranked(first, seed, [key]).filter(F.col("rank") <= total).drop("rank")
    have = first.agg(F.least(F.count(F.lit(1)), F.lit(total)).alias("_have"))
    other = hash_ranked(second.join(first.select(key), key, "left_anti"), seed, [key])
    other = other.crossJoin(F.broadcast(have)).filter(F.col("rank") <= total - F.col("_have")).select(second.columns)  # one row
    return own.withColumn("origin", F.lit("first")).unionByName(other.withColumn("origin", F.lit("second")))


def fill_from_groups(df: DataFrame, key: str, group: str, by: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Visit the groups of each stratum in hash order and take rows until ``n``; the last group is cut."""
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_size")).withColumn("_hash", seeded(seed, group))
    # Rows in the groups before a group: those in earlier ranges of hashes, and those before it in its own range.
    sizes = sizes.withColumn("_range", F.substring("_hash", 1, 3))
    ranges = sizes.groupBy(*by, "_range").agg(F.sum("_size").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*by, "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    inside = F.sum("_size").over(Window.partitionBy(*by, "_range").orderBy("_hash", group).rowsBetween(Window.unboundedPreceding, -1))
    sizes = match(sizes.withColumn("_before", F.coalesce(inside, F.lit(0))), ranges, [*by, "_range"])
    before = F.col("_before") + F.col("_earlier")
    take = sizes.withColumn("_take", F.least("_size", F.greatest(F.lit(0), n - before))).filter("_take > 0")
    rows = df.withColumn("_h", seeded(seed, key))
    rows = match(rows, take.select(*by, group, "_take"), [*by, group])
    inside = F.row_number().over(Window.partitionBy(*by, group).orderBy("_h", key))
    return rows.withColumn("_r", inside).filter("_r <= _take").drop("_h", "_r", "_take")


def few_groups_fallback(df: DataFrame, key: str, group: str, by: Sequence[str], n: int, least_groups: int = 8, seed: int = 42) -> DataFrame:
    """fill_from_groups, but strata with fewer than ``least_groups`` groups are sampled row by row."""
    counts = df.groupBy(*by).agg(F.countDistinct(group).alias("_groups"))
    rows = match(df, counts, by)
    rows = rows.withColumn("_unit", F.when(F.col("_groups") < least_groups, F.col(key).cast("string")).otherwise(F.col(group).cast("string")))
    return fill_from_groups(rows, key, "_unit", by, n, seed).select(df.columns)


def sample_groups(df: DataFrame, group: str, by: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """All rows of ``k`` groups of each stratum."""
    chosen = hash_ranked(df.select(*by, group).distinct(), seed, [group], by).filter(F.col("rank") <= k)
    return match(df, chosen.select(*by, group), [*by, group], "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def middle_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row at place n // 2 (from 0) of each key's sorted rows."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return rows.filter("_r = _n div 2").drop("_r", "_n")


#: Suites that a real row is held against at once, as one array.
SUITES_AT_ONCE = 1000


def _below(reals: DataFrame, key: str, wanted: DataFrame, seed: int) -> DataFrame:
    """The pairs of a real row and a suite whose hash is below the suite's ``_cut``; no others are made."""
    parts = max(1, -(-wanted.count() // SUITES_AT_ONCE))
    lists = wanted.groupBy(F.pmod(F.xxhash64("suite"), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct("suite", "_cut")).alias("_suites")).drop("_part")
    low = F.filter("_suites", lambda s: F.substring(seeded(seed, s["suite"], key), 1, 8) < s["_cut"])
    met = reals.crossJoin(F.broadcast(lists))  # one row of suites, as long as there are SUITES_AT_ONCE or fewer
    return met.withColumn("suite", F.explode(low)).withColumn("suite", F.col("suite.suite")).drop("_suites")


def _with_cut(wanted: DataFrame) -> DataFrame:
    """Adds the hash below which about ``_rows`` of ``_reals`` rows are, as eight hex digits ("g" is above all)."""
    share = F.col("_rows") / F.col("_reals")
    return wanted.withColumn("_cut", F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex(F.ceil(share * float(1 << 32)).cast("long")), 8, "0"))))


def lowest_for_suites(reals: DataFrame, key: str, sizes: DataFrame, seed: int = 42, margin: float = 2.5) -> DataFrame:
    """suite and the ``_take`` rows of ``reals`` that come first in the suite's hash order, for each row of ``sizes`` (suite, _take, _reals).

    Hashes are even, so the place where a suite's share ends is known but for a few rows; pairs below that place and a
    margin (in standard deviations) are made. Suites that still lack rows, about one in two hundred, are made again with twice the share.
    """
    wanted = materialise(_with_cut(sizes.filter("_take > 0").withColumn("_rows", F.greatest(F.lit(1.0), F.col("_take") + margin * F.sqrt("_take") + 3))))
    made, done = None, materialise(_below(reals, key, wanted, seed))
    while True:
        n = done.groupBy("suite").agg(F.count(F.lit(1)).alias("_n"))
        short = materialise(match(wanted, n, ["suite"], "left").filter((F.coalesce("_n", F.lit(0)) < F.col("_take")) & (F.col("_cut") != "g")).drop("_n"))
        lacks = short.count()
        good = match(done, short.select("suite"), ["suite"], "left_anti") if lacks else done
        made = good if made is None else made.unionByName(good)
        if not lacks:
            break
        wanted = _with_cut(short.withColumn("_rows", 2 * F.col("_rows")))
        done = materialise(_below(reals, key, wanted, seed))
    rows = match(hash_ranked(made, seed, ["suite", key], ["suite"], digits=5), sizes.select("suite", "_take"), ["suite"])
    return rows.filter(F.col("rank") <= F.col("_take")).drop("rank", "_take")


def suite_balanced(df: DataFrame, key: str, method: str = "method", label: str = "label", real: str = "real", seed: int = 42) -> DataFrame:
    """For each method as many reals as it has fakes (or fewer of the fakes), as rows (suite, ...).

    Reals are ordered anew for each method, but only those that come first are made into rows of its suite.
    """
    fakes, reals = df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)
    n_real = reals.agg(F.count(F.lit(1)).alias("_reals"))
    sizes = fakes.groupBy(method).agg(F.count(F.lit(1)).alias("_fakes")).crossJoin(F.broadcast(n_real))  # one row
    sizes = materialise(sizes.select(F.col(method).alias("suite"), F.least("_fakes", "_reals").alias("_take"), "_reals"))
    own = match(hash_ranked(fakes.withColumn("suite", F.col(method)), seed, [key], ["suite"]), sizes.select("suite", "_take"), ["suite"])
    own = own.filter(F.col("rank") <= F.col("_take")).drop("rank", "_take")
    return own.unionByName(lowest_for_suites(reals, key, sizes, seed))


def suite_full(df: DataFrame, method: str = "method", label: str = "label", methods: DataFrame | None = None) -> DataFrame:
    """For each method all its fakes and all reals; the result is methods x reals by definition.

    ``methods`` (column suite) names the suites; by default they are the methods of the fakes.
    """
    fakes, reals = df.filter(F.col(label) == 1).withColumn("suite", F.col(method)), df.filter(F.col(label) == 0)
    if methods is None:
        methods = fakes.select("suite")
    methods = materialise(methods.select("suite").distinct())
    return match(fakes, methods, ["suite"], "left_semi").unionByName(reals.crossJoin(broadcast_if_small(methods, methods.count(), SUITES_AT_ONCE)))


def method_suites(benchmark: DataFrame, test: DataFrame, key: str, method: str = "method", label: str = "label", seed: int = 42) -> DataFrame:
    """Rows (suite, variant, ...) of every method of the benchmark's fakes, in the five variants of its suite.

    test_balanced, test_full and test_detailed (the same rows) of the test split; benchmark_balanced and benchmark_full of all rows.
    A method without a fake in the test split has no test_balanced, and only reals in test_full.
    """
    # Each of the variants reads both tables several times, so what they are made of is computed once.
    benchmark, test = materialise(benchmark), materialise(test)
    methods = benchmark.filter(F.col(label) == 1).select(F.col(method).alias("suite"))
    named = lambda df, name: df.withColumn("variant", F.lit(name))
    full = suite_full(test, method, label, methods)
    out = named(suite_balanced(test, key, method, label, seed=seed), "test_balanced")
    for name, df in (("test_full", full), ("test_detailed", full), ("benchmark_balanced", suite_balanced(benchmark, key, method, label, seed=seed)), ("benchmark_full", suite_full(benchmark, method, label))):
        out = out.unionByName(named(df, name))
    return out


def methods_summary(rows: DataFrame, in_test: Column, method: str = "method", label: str = "label") -> DataFrame:
    """method and the sizes of its suites: test_split_fakes, test_split_balanced_total, benchmark_fakes, benchmark_balanced_total, benchmark_full_total.

    All follow from the numbers of fakes and of reals; no suite is made.
    """
    real = rows.filter(F.col(label) == 0).agg(F.count_if(in_test).alias("_test"), F.count(F.lit(1)).alias("_all"))
    fake = rows.filter(F.col(label) == 1).groupBy(method).agg(F.count_if(in_test).alias("test_split_fakes"), F.count(F.lit(1)).alias("benchmark_fakes"))
    both = fake.crossJoin(F.broadcast(real))  # one row
    return both.select(
        method, "test_split_fakes", (2 * F.least("test_split_fakes", "_test")).alias("test_split_balanced_total"),
        "benchmark_fakes", (2 * F.least("benchmark_fakes", "_all")).alias("benchmark_balanced_total"), (F.col("benchmark_fakes") + F.col("_all")).alias("benchmark_full_total"),
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight = total / (classes * n), other_share = share of the other classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))
    total, classes = F.sum("n").over(whole), F.count(F.lit(1)).over(whole)
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"), ((total - F.col("n")) / total).alias("other_share"))


def weighted_resample(df: DataFrame, key: str, weight: Column, seed: int = 42, part: float = 32.0) -> DataFrame:
    """Rows drawn with replacement: each is repeated a Poisson number of times with mean ``weight``.

    The number comes from the row's hash by inverting the distribution; weights above ``part`` are the sum
    of draws of equal means up to ``part``, each with a hash of its own, so exp() never underflows. The
    expected size is the sum of the weights, whatever their size.
    """
    parts = F.greatest(F.lit(1), F.ceil(weight / part)).cast("int")
    mean = (weight / parts).cast("double")
    most = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")

    def drawn(u: Column) -> Column:
        p = F.exp(-mean)
        start = F.struct(p.alias("p"), p.alias("c"), F.when(u >= p, 1).otherwise(0).alias("n"), u.alias("u"))

        def step(a: Column, i: Column) -> Column:
            p = a["p"] * mean / i
            return F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["n"] + F.when(a["u"] >= a["c"] + p, 1).otherwise(0)).alias("n"), a["u"].alias("u"))

        return F.aggregate(F.sequence(F.lit(1), most), start, step)["n"]

    draws = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: drawn(F.when(k == 0, uniform(seed, key)).otherwise(uniform(seed, key, k.cast("string")))))
    copies = F.aggregate(draws, F.lit(0), lambda a, n: a + n)
    return df.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def oversample(df: DataFrame, weights: DataFrame, by: str) -> DataFrame:
    """Each row as often as its group's integer ``weight`` says (once without an entry); adds ``copy``."""
    rows = df.join(weights.select(by, "weight"), by, "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    return rows.filter("weight > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).drop("weight")


def batch_balance(df: DataFrame, key: str, size: int, label: str = "label", seed: int = 42) -> DataFrame:
    """batch, n, fakes, share: class mix of consecutive batches in hash order."""
    rows = hash_ranked(df, seed, [key]).withColumn("batch", F.floor((F.col("rank") - 1) / size))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("fakes"), F.avg(label).alias("share"))


def frame_plan(df: DataFrame, total: str, n: int, every: int, wanted: Sequence[int] = ()) -> DataFrame:
    """plan, frame: frame numbers by ``n`` even places, by every ``every``-th frame, and those ``wanted`` that there are, for each row."""
    last = F.greatest(F.col(total) - 1, F.lit(0))
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(last * i / F.lit(max(1, n - 1))).cast("long"))
    step = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(every).cast("long"))
    plans = F.array(F.struct(F.lit("even").alias("plan"), F.array_distinct(even).alias("frames")), F.struct(F.lit("step").alias("plan"), step.alias("frames")), F.struct(F.lit("set").alias("plan"), F.filter(F.array(*map(F.lit, sorted(set(wanted)))).cast("array<long>"), lambda f: (f >= 0) & (f <= last) & (F.col(total) > 0)).alias("frames")))
    return df.withColumn("_p", F.explode(plans)).select("*", F.col("_p.plan").alias("plan"), F.explode("_p.frames").alias("frame")).drop("_p")
