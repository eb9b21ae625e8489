"""Models by name and the feature store."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.operators import registry as X
from tessera.sources import manifests, snapshots

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find this folder


def first(path):
    return lambda x: x[:, 0]


def total(path):
    return lambda x: np.nansum(x, axis=1)


def lengths(path):
    return lambda texts: [[len(t), t.count("a")] for t in texts]


def fails(path):
    raise RuntimeError("nothing was to be computed")


def wrong(path):
    return lambda texts: [[1.0]] * len(texts)


def test_several_models_in_one_pass(spark):
    models = X.Registry([X.Model("first", first, "", 3), X.Model("total", total, "", 3)])
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [4.0, None, 1.0])], "id long, v array<double>").repartition(2)
    scored = X.score_models(df, list(models), "v")
    assert sorted(map(tuple, scored.select("id", "prob_first", "prob_total").collect())) == [(1, 1.0, 6.0), (2, None, None), (3, 4.0, 5.0)]
    assert scored._jdf.queryExecution().toString().count("ArrowEvalPython [") <= 4  # both models in one node a plan
    with pytest.raises(Exception, match="takes 3 features, a row has 2"):
        X.score_models(spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>"), [models["first"]], "v").collect()
    with pytest.raises(KeyError):
        models["other"]
    with pytest.raises(ValueError):
        models.register(X.Model("first", first, "", 3))
    assert X.score_models(df.limit(0), list(models), "v").count() == 0


def test_a_second_call_computes_nothing(spark, tmp_path):
    store = str(tmp_path / "s")
    df = spark.createDataFrame([(1, "aab"), (2, "c"), (3, "aab"), (4, None), (5, "")], "id long, text string")
    want = {1: [3.0, 2.0], 2: [1.0, 0.0], 3: [3.0, 2.0], 4: None, 5: [0.0, 0.0]}
    got = lambda rows: {r["id"]: r["features"] for r in rows.collect()}
    assert got(X.stored_features(df, X.Model("m", lengths, "", 2), store, "text")) == want
    assert snapshots.read(spark, store).count() == 3
    assert got(X.stored_features(df, X.Model("m", fails, "", 2), store, "text")) == want and snapshots.version(spark, store).number == 1
    more = df.unionByName(spark.createDataFrame([(6, "aaaa")], df.schema))
    assert got(X.stored_features(more, X.Model("m", lengths, "", 2), store, "text")) == want | {6: [4.0, 4.0]}
    assert [r["address"] for r in snapshots.changes(spark, store, 1).collect()] == [more.filter("id = 6").select(F.sha2(F.col("text").cast("binary"), 256)).first()[0]]
    assert got(X.stored_features(df, X.Model("other", lengths, "", 2), store, "text")) == want  # another model, features of its own
    with pytest.raises(ValueError, match="dimension 2, not 5"):
        X.stored_features(df, X.Model("m", lengths, "", 5), store, "text")
    with pytest.raises(Exception, match="gave"):
        X.stored_features(df, X.Model("new", wrong, "", 2), store, "text")
    assert snapshots.version(spark, store).number == 3
    assert X.stored_features(df.limit(0), X.Model("n", fails, "", 2), str(tmp_path / "e"), "text").count() == 0


def test_features_are_aligned_by_key(spark, tmp_path):
    manifest = spark.createDataFrame([(1, "m"), (2, "m"), (2, "n")], "id long, method string")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, features array<float>")
    good = X.aligned_features(rows((2, [2.0]), (1, [1.0])), manifest, ["id"], 1)
    assert sorted(map(tuple, good.select("id", "method", F.col("features")[0]).collect())) == [(1, "m", 1.0), (2, "m", 2.0), (2, "n", 2.0)]
    for bad in ([(1, [1.0])], [(1, [1.0]), (2, [1.0]), (3, [1.0])], [(1, [1.0]), (1, [1.0]), (2, [1.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0]), (2, None)]):
        with pytest.raises(ValueError):
            X.aligned_features(rows(*bad), manifest, ["id"], 1)
    with pytest.raises(ValueError):
        X.aligned_features(manifest.withColumn("features", F.lit("x")), manifest, ["id"], 1)
    rows((1, [1.0])).write.parquet(str(tmp_path / "f"))
    assert manifests.scan_features(spark, str(tmp_path / "f"), "id").count() == 1
    with pytest.raises(ValueError):
        manifests.scan_features(spark, str(tmp_path / "f"), "sample_id")
