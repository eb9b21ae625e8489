"""Suites of methods: members by brute force, rows made, variants."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling
from tessera.sources import sinks, snapshots


def md5(*parts):
    return hashlib.md5(":".join("\\N" if p is None else str(p) for p in parts).encode()).hexdigest()


def plain(rows, seed=42):
    reals, out = [i for i, m, y in rows if y == 0], set()
    for suite in {m for _, m, y in rows if y == 1}:
        fakes = [i for i, m, y in rows if y == 1 and m == suite]
        n = min(len(fakes), len(reals))
        out |= {(suite, i) for i in sorted(fakes, key=lambda i: (md5(seed, i), i))[:n]}
        out |= {(suite, i) for i in sorted(reals, key=lambda i: (md5(seed, suite, i), i))[:n]}
    return out


def table(spark, sizes, reals):
    rows, at = [], 0
    for m, n in sizes.items():
        rows += [(at + k, m, 1) for k in range(n)]
        at += n
    rows += [(at + k, "real", 0) for k in range(reals)]
    return rows, spark.createDataFrame(rows, "id long, method string, label int")


@pytest.mark.parametrize("sizes, reals", [({"a": 3, "b": 900, None: 20, "c": 400}, 700), ({"a": 5}, 0), ({"a": 50, "b": 1}, 3)])
def test_balanced_suites_equal_brute_force(spark, sizes, reals):
    rows, df = table(spark, sizes, reals)
    got = sampling.suite_balanced(df, "id").collect()
    assert {(r["suite"], r["id"]) for r in got} == plain(rows) and len(got) == len(plain(rows))
    summary = {r["method"]: r["benchmark_balanced_total"] for r in sampling.methods_summary(df, F.lit(True)).collect()}
    assert summary == {m: 2 * min(n, reals) for m, n in sizes.items()}


@pytest.mark.parametrize("at_once", [1000, 2])
def test_suites_that_lack_rows_are_made_again(spark, monkeypatch, at_once):
    monkeypatch.setattr(sampling, "SUITES_AT_ONCE", at_once)
    rows, df = table(spark, {"a": 90, "b": 40, None: 10, "d": 199, "e": 400}, 300)
    sizes = df.filter("label = 1").groupBy(F.col("method").alias("suite")).agg(F.least(F.count(F.lit(1)), F.lit(300)).alias("_take"), F.lit(300).cast("long").alias("_reals"))
    got = sampling.lowest_for_suites(df.filter("label = 0"), "id", sizes, margin=-6.0).collect()
    assert sorted(map(str, ((r["suite"], r["id"]) for r in got))) == sorted(map(str, ((s, i) for s, i in plain(rows) if dict((i, y) for i, _, y in rows)[i] == 0)))


def test_few_more_rows_are_made_than_returned(spark, monkeypatch):
    made, below = [], sampling._below
    monkeypatch.setattr(sampling, "_below", lambda *a: made.append(below(*a)) or made[-1])
    sizes = {f"m{k}": 900 + 50 * k for k in range(12)}
    _, df = table(spark, sizes, 20_000)
    returned = sampling.suite_balanced(df, "id").count() - sum(sizes.values())
    assert returned == sum(sizes.values()) and sum(x.count() for x in made) <= 1.1 * returned


def test_five_variants(spark, tmp_path):
    rows, df = table(spark, {"a": 30, "b": 8}, 20)
    df = df.withColumns({"path": F.col("id").cast("string"), "identity": F.concat(F.lit("i"), F.col("id")), "domain": F.lit("d"), "video": F.lit("v")})
    test = df.filter("id % 3 = 0 AND method <> 'b'")
    sinks.write_suites(sampling.method_suites(df, test, "id"), str(tmp_path / "s"))
    found = snapshots.read(spark, str(tmp_path / "s"))
    n = {(r["suite"], r["variant"]): (r["n"], r["fakes"]) for r in found.groupBy("suite", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("fakes")).collect()}
    real, fake = sum(i % 3 == 0 for i, _, y in rows if not y), 10
    few = min(real, fake)
    assert n == {
        ("a", "test_balanced"): (2 * few, few), ("a", "test_full"): (real + fake, fake), ("a", "test_detailed"): (real + fake, fake), ("a", "benchmark_balanced"): (40, 20), ("a", "benchmark_full"): (50, 30),
        ("b", "test_full"): (real, 0), ("b", "test_detailed"): (real, 0), ("b", "benchmark_balanced"): (16, 8), ("b", "benchmark_full"): (28, 8),
    }
    summary = {r["method"]: tuple(r)[1:] for r in sampling.methods_summary(df, F.expr("id % 3 = 0 AND method <> 'b'")).collect()}
    assert summary == {"a": (10, 2 * few, 30, 40, 50), "b": (0, 0, 8, 16, 28)}
    assert found.filter("variant = 'test_detailed' AND identity IS NULL").count() == 0 == found.filter("variant = 'test_full' AND identity IS NOT NULL").count()


def test_suites_compute_their_input_once(spark):
    """Before, every variant computed the split anew."""
    seen = spark.sparkContext.accumulator(0)
    rows, df = table(spark, {"a": 30, "b": 8}, 20)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    sampling.method_suites(df.mapInPandas(count, df.schema), df.filter("id % 3 = 0"), "id").count()
    assert seen.value == len(rows)
