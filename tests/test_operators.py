"""Invariants, edge cases and brute-force comparisons of the operators."""

import json
import struct
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.functions.hashing import hash_ranked
from tessera.operators import components, curation, history, images, metrics, sampling, splits, vectors
from tessera.sources import manifests, sinks, snapshots


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, f"p{rng.integers(60)}", f"m{rng.integers(4)}", int(rng.random() < 0.4), float(rng.integers(50) / 49)) for i in range(600)]
    return spark.createDataFrame(data, "sample_id int, identity string, method string, label int, prob double").cache()


@pytest.mark.parametrize("seed", [1, 42, 99])
@pytest.mark.parametrize("share", [0.5, 0.7])
def test_group_splits_are_disjoint_and_sized(rows, seed, share):
    out = splits.split_groups(rows, ["identity"], {"train": share, "test": 1 - share}, seed)
    assert out.count() == 600
    assert splits.leakage(out, "identity").count() == 0
    groups = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.countDistinct("identity").alias("n")).collect()}
    total = rows.select("identity").distinct().count()
    assert groups["train"] == int(total * share + 1e-9)


def test_split_of_an_empty_table(rows):
    assert splits.split_groups(rows.limit(0), ["identity"], {"train": 0.7, "test": 0.3}).count() == 0


def test_ranks_have_no_gaps(rows):
    ranks = sorted(r["rank"] for r in hash_ranked(rows, 5, ["sample_id"], digits=1).collect())
    assert ranks == list(range(1, 601))


def test_balance_is_one_to_one(rows):
    n = {(r["method"], r["label"]): r["count"] for r in sampling.balance(rows, "sample_id", by=["method"]).groupBy("method", "label").count().collect()}
    assert n and all(n[m, 0] == n[m, 1] for m, _ in n)
    one_class = rows.filter("label = 1")
    assert sampling.balance(one_class, "sample_id").count() == 0
    assert sampling.balance(one_class, "sample_id", keep_single=True).count() == one_class.count()


def test_topup_reaches_the_total(rows):
    assert sampling.quota_with_topup(rows.select("sample_id", "method"), "sample_id", ["method"], 10, 75).count() == 75


def test_weighted_resample_has_the_expected_size(rows):
    n = sampling.weighted_resample(rows, "sample_id", F.lit(1.5)).count()
    assert abs(n - 900) < 150


@pytest.mark.parametrize("weight", [100.0, 2000.0])
def test_weighted_resample_does_not_cut_large_weights(spark, weight):
    few = spark.range(30).withColumnRenamed("id", "k")
    n = [r["n"] for r in sampling.weighted_resample(few, "k", F.lit(weight)).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(n) == 30 and abs(sum(n) - 30 * weight) < 5 * (30 * weight) ** 0.5 and max(n) > weight > min(n)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def test_auc_with_ties(rows):
    x = rows.toPandas()
    assert metrics.roc_auc(rows, "prob").first()["auc"] == pytest.approx(brute_auc(x.label.to_numpy(), x.prob.to_numpy()), abs=1e-12)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    own = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0).evaluate(rows)
    assert metrics.roc_auc(rows, "prob").first()["auc"] == pytest.approx(own, abs=1e-9)


def test_metrics_of_one_class_and_of_nothing(spark, rows):
    one = rows.filter("label = 1").withColumn("pred", F.lit(0))
    assert metrics.roc_auc(one, "prob").first()["auc"] is None
    got = metrics.binary_metrics(one).first()
    assert (got["precision"], got["recall"], got["real_acc"]) == (0.0, 0.0, None)
    assert metrics.binary_metrics(one.limit(0)).first()["accuracy"] == 0.0
    assert metrics.roc_auc(one.limit(0), "prob", ["method"]).count() == 0


def test_all_scores_equal(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1)], "prob double, label int")
    assert metrics.roc_auc(df, "prob").first()["auc"] == 0.5
    assert metrics.youden(df, "prob").first()["j"] == 0.0


def test_calibration_and_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.100001, 1), (1.0, 1)], "prob double, label int")
    assert {r["bin"]: r["n"] for r in metrics.calibration(df, "prob").collect()} == {0: 2, 1: 1, 9: 1}
    assert {r["bin"]: r["n"] for r in metrics.score_histogram(df, "prob", 10, ["label"]).filter("label = 1").collect()} == {1: 2, 9: 1}


def test_early_stop(spark):
    acc = [0.5, 0.6, 0.6, 0.55, 0.7, 0.1, 0.2, 0.3]
    df = spark.createDataFrame([(1, i + 1, a) for i, a in enumerate(acc)], "run int, epoch int, acc double")
    assert history.early_stop(df, 2).first()["stop_epoch"] == 4
    assert history.early_stop(df, 9).first()["stop_epoch"] is None
    assert history.best_epoch(df).first()["best_epoch"] == 5


def test_label_rules(spark):
    df = spark.createDataFrame([("a_fake_1.png",), ("real.png",), ("x.png",)], "n string")
    assert [r[0] for r in df.select(keys.label_from_name(F.col("n"))).collect()] == [1, 0, None]


def test_probe_equals_a_newton_solver(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0.4).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, v array<float>, label int")
    scores = vectors.probe_scores(vectors.fit_probe(df, "v"), df, "v").orderBy("id").toPandas()["prob"].to_numpy()
    z = (x.astype(float) - x.mean(0)) / x.astype(float).std(0, ddof=1)
    design, w = np.column_stack([np.ones(200), z]), np.zeros(5)
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    penalty = np.diag([0.0, 1, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design.T * (weight * p * (1 - p))) @ design + penalty, design.T @ (weight * (p - y)) + penalty @ w)
    assert np.allclose(scores, 1 / (1 + np.exp(-design @ w)), atol=1e-5)
    assert ((scores >= 0) & (scores <= 1)).all()


def near_classes(spark, x, least):
    df = spark.createDataFrame([(i, None if a is None else [float(v) for v in a]) for i, a in enumerate(x)], "id int, v array<double>")
    return {r["id"]: (r["class_id"], r["copies"]) for r in vectors.near_copies(df, "id", "v", least).collect()}


def test_near_copies_give_classes(spark):
    rng = np.random.default_rng(2)
    x = list(rng.normal(size=(60, 16)))
    x[7], x[9], x[20], x[30], x[31] = x[3] + 0.01, x[3] + 0.02, x[5], None, [float("nan")] * 16
    want = {i: (i, 1) for i in range(60)} | {7: (3, 1), 9: (3, 1), 5: (5, 2), 20: (5, 2)}
    assert near_classes(spark, x, 0.99) == want
    assert near_classes(spark, [], 0.99) == {}


def test_near_copies_of_a_dense_group(spark, monkeypatch):
    """A third of the vectors in one direction: their buckets are split by more planes, then compared in blocks."""
    monkeypatch.setattr(vectors, "BUCKET", 8)
    monkeypatch.setattr(vectors, "BLOCK", 12)
    monkeypatch.setattr(vectors, "MOST_BITS", 12)
    rng = np.random.default_rng(3)
    x = list(rng.normal(size=(90, 16)))
    for i in range(0, 90, 3):
        x[i] = x[0] + 1e-9 * rng.normal(size=16)
    got = near_classes(spark, x, 0.95)
    assert got == {i: (0 if i % 3 == 0 else i, 1) for i in range(90)}


def test_near_copies_recall_of_pairs(spark):
    """Pairs just above the bound, one to one, so that each must be found by itself."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 2000, 2):
        side = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = 0.91 * x[i] + np.sqrt(1 - 0.91**2) * side / np.linalg.norm(side)
    got = near_classes(spark, x, 0.9)
    assert all(got[i][0] == i for i in range(0, 2000, 2))
    assert np.mean([got[i + 1][0] == i for i in range(0, 2000, 2)]) >= 0.9


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(components, "HEAVY_ROWS", 20)
    links = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(131, 130), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(40)} | {i: 100 for i in range(100, 132)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    x = {g: np.round(rng.random(n), 2) for g, n in (("a", 101), ("b", 1), (None, 40))}
    df = spark.createDataFrame([(g, float(v)) for g, values in x.items() for v in values] + [("a", None), ("c", None)], "g string, x double")
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in metrics.quantiles(df, "x", ["g"], [0.1, 0.5, 0.77]).collect()}
    assert set(got) == set(x)
    for g, values in x.items():
        assert np.allclose(got[g], np.quantile(values, [0.1, 0.5, 0.77]))


def png(path, pixels):
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_jobs(spark, tmp_path):
    folder = tmp_path / "real" / "v1"
    folder.mkdir(parents=True)
    png(folder / "a.png", np.full((4, 6, 3), (200, 10, 30)))
    png(folder / "b.png", np.random.default_rng(0).integers(0, 255, (8, 8, 3)))
    (folder / "c.png").write_bytes(b"\x89PNG broken")
    (folder / "d.png").write_bytes(b"")
    expected = spark.createDataFrame([(str(folder / f"{c}.png"),) for c in "abcd"], "path string")
    status = {r["path"][-5:]: r["status"] for r in images.decode_audit(spark, str(tmp_path), expected).collect()}
    assert status == {"a.png": "ok", "b.png": "ok", "c.png": "corrupt", "d.png": "absent"}
    stats = {r["path"][-5:]: r for r in images.image_stats(spark, str(tmp_path)).collect()}
    assert stats["a.png"]["blank"] and not stats["b.png"]["blank"]
    assert (stats["a.png"]["red"], stats["a.png"]["green"], stats["a.png"]["blue"]) == (200, 10, 30)
    tree = manifests.scan_tree(spark, str(tmp_path)).collect()
    assert {(r["category"], r["group"]) for r in tree} == {("real", "v1")} and {r["name"] for r in tree} >= {"a.png", "b.png", "c.png"}


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("path,method\na.png,real\nb.png,swap\n")
    got = manifests.scan_manifest(spark, str(tmp_path / "m.csv")).orderBy("path").collect()
    assert [(r["label"], r["identity"]) for r in got] == [(0, "unknown"), (1, "unknown")]
    (tmp_path / "s.csv").write_text("path,label\na,0\nb\nc,1\n")
    assert [r["path"] for r in manifests.scan_split(spark, str(tmp_path / "s.csv")).orderBy("path").collect()] == ["a", "c"]
    (tmp_path / "n.json").write_text(json.dumps({"k": {"Real": {"train": {"v1": {"frames": ["x", "y"]}}}}}))
    assert [(r["video"], r["position"], r["frame"]) for r in manifests.scan_nested_index(spark, str(tmp_path / "n.json")).collect()] == [("v1", 0, "x"), ("v1", 1, "y")]
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "p"}, {"id": 2, "file_name": "q"}], "annotations": [{"image_id": 2, "category_id": 1}, {"image_id": 1, "category_id": 0}]}))
    assert {r["file_name"]: r["label"] for r in manifests.scan_annotations(spark, str(tmp_path / "a.json")).collect()} == {"p": 0, "q": 1}
    (tmp_path / "r.json").write_text(json.dumps({"m1/cdc": {"acc": 0.5}}))
    assert manifests.scan_reports(spark, str(tmp_path / "r.json")).first()[:] == ("m1", "cdc", "acc", 0.5)
    lines = spark.createDataFrame([("1  a/b.mp4",), ("oops",), ("0 c.mp4",)], "value string")
    assert [tuple(r) for r in manifests.scan_list(lines).collect()] == [(1, "a/b.mp4"), (0, "c.mp4")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "real", "i", "d", "v", "train"), ("b", 1, "m", "i", "d", "v", "test")], "path string, label int, method string, identity string, domain string, video string, split string")
    sinks.write_split(df, str(tmp_path / "s"), detailed=True)
    assert snapshots.read(spark, str(tmp_path / "s")).filter("split = 'train'").count() == 1
    for _ in range(2):
        sinks.append_manifest(df, str(tmp_path / "m"), "path")
    assert snapshots.read(spark, str(tmp_path / "m")).count() == 2


def with_nulls(spark):
    rows = [(i, None if i % 3 == 0 else f"id{i % 7}", None if i % 4 == 0 else f"m{i % 2}", int(i % 5 < 2)) for i in range(60)]
    return spark.createDataFrame(rows, "k long, identity string, method string, label int")


def test_null_keys_keep_their_rows(spark):
    df = with_nulls(spark)
    for got in (
        splits.split_groups(df, ["identity"], {"train": 0.7, "test": 0.3}),
        splits.split_groups(df, ["identity"], {"train": 0.7, "test": 0.3}, by=["method"]),
        splits.split_fixed(df, ["identity"], {"test": 2}, "train"),
        splits.split_rows(df, "k", {"train": 0.7, "test": 0.3}, ["method"]),
    ):
        assert got.count() == 60 and got.filter("split IS NULL").count() == 0 and got.columns == [*df.columns, "split"]
    assert splits.split_groups(df, ["identity"], {"train": 0.7, "test": 0.3}).filter("identity IS NULL").select("split").distinct().count() == 1
    assert {r["method"]: r["count"] for r in sampling.cap(df, "k", ["method"], 5).groupBy("method").count().collect()} == {None: 5, "m0": 5, "m1": 5}
    assert {r["method"]: r["count"] for r in sampling.cap(df, "k", ["method"], 1001).groupBy("method").count().collect()} == {None: 15, "m0": 15, "m1": 30}
    assert sampling.fill_from_groups(df, "k", "identity", ["method"], 100).count() == 60
    assert {r["method"]: r["count"] for r in sampling.fill_from_groups(df, "k", "identity", ["method"], 9).groupBy("method").count().collect()} == {None: 9, "m0": 9, "m1": 9}
    assert sampling.sample_groups(df, "identity", ["method"], 100).count() == 60
    assert sampling.few_groups_fallback(df, "k", "identity", ["method"], 100).columns == df.columns
    assert sampling.balance(df, "k", by=["method"]).count() == 48


def test_fold_sizes_equal_the_folds(spark):
    df = with_nulls(spark).withColumn("method", F.coalesce("method", F.lit("real")))
    counts = lambda: [F.count(F.lit(1)).alias("n"), F.sum("label").alias("fakes")]
    want = splits.leave_one_out(df, "method", "real").groupBy("fold", "role").agg(*counts())
    assert sorted(splits.fold_sizes(df, "method", counts(), "real").collect()) == sorted(want.collect())


def test_scores_at_the_ends_and_beyond(spark):
    rows = [(x, int(i % 3 == 0)) for i, x in enumerate([0.0] * 5 + [1e-9 * k for k in range(40)] + [1.0 - 1e-9 * k for k in range(40)] + [-3.0, 7.5])]
    got = metrics.cumulative(spark.createDataFrame(rows, "s double, label int"), "s").collect()
    for r in got:
        assert (r["pos_below"], r["neg_below"]) == tuple(sum(y == v and x < r["score"] for x, y in rows) for v in (1, 0))
    assert metrics.cumulative(spark.createDataFrame([], "s double, label int"), "s").count() == 0


def test_null_contents_and_repeated_predictions(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, None), (4, "x"), (5, "")], "k long, text string")
    got = {r["k"]: (r["copies"], r["content_sha256"] is None) for r in curation.exact_dedup(df, "text", "k").collect()}
    assert got == {1: (2, True), 2: (2, False), 4: (1, False)}
    rows = spark.createDataFrame([("f", "vit", 0.2, 0), ("f", "vit", 0.9, 1), ("g", "cnn", 0.4, 0)], "name string, model string, prob double, pred int")
    wide = {r["name"]: tuple(r)[1:] for r in sinks.predictions_wide(rows, "name", ["vit", "cnn"]).collect()}
    assert wide == {"f": (0.9, 1, None, None), "g": (None, None, 0.4, 0)}


def test_an_odd_header_is_warned_of(spark, tmp_path):
    for name, header in (("good", "path,label"), ("odd", "file,target")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\na.png,1\nb.png\nc.png,0\n")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert manifests.scan_split(spark, str(tmp_path / "good.csv")).count() == 2
    with pytest.warns(UserWarning, match="file,target"):
        assert manifests.scan_split(spark, str(tmp_path / "odd.csv")).count() == 2


def test_paths_are_remapped_by_method(spark):
    df = spark.createDataFrame([("m", "a/real/x"), ("n", "a/real/x"), (None, "a/real/x")], "method string, path string")
    rules = {None: [("a/", "b/")], "m": [("/real/", "/real/real/")]}
    got = df.select("method", keys.path_remap(F.col("path"), F.col("method"), rules).alias("p"), keys.subject_prefix(F.lit("id7_0001")).alias("s")).collect()
    assert {r["method"]: r["p"] for r in got} == {"m": "b/real/real/x", "n": "b/real/x", None: "b/real/x"} and got[0]["s"] == "id7"


@pytest.mark.parametrize("always, block", [(100_000, 1 << 16), (0, 1 << 16), (0, 40)])
def test_near_copies_under_a_loose_bound(spark, monkeypatch, always, block):
    """All pairs of 600 vectors by blocks equal brute force; by planes, also with buckets beyond a block, nearly."""
    monkeypatch.setattr(vectors, "ALWAYS", always)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "BUCKET", 90)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, want = x @ x.T >= 0.4, {}
    for start in range(600):
        todo = [start] if start not in want else []
        while todo:
            i = todo.pop()
            if i not in want:
                want[i] = start
                todo += np.flatnonzero(near[i]).tolist()
    got = near_classes(spark, x, 0.4)
    same = sum(got[i][0] == want[i] for i in want)
    assert same == 600 if always else same >= 560, same


def test_planes_follow_from_what_moving_rows_costs():
    """615,000 vectors at 0.45: before, 12 planes and 539 tables, each of which moved every vector."""
    assert vectors.n_planes(615_000, 0.45, 0.95) == 0
    bits = vectors.n_planes(10**7, 0.9, 0.95)
    assert bits > 8 and vectors.n_tables(bits, 0.9, 0.95) < 60


def test_ensemble_and_frames_deal_rows_to_tasks_of_bounded_size(spark, monkeypatch):
    """Before, all the scores of a member met in one task, and a task of the frames got as much as there are few tasks."""
    from tessera.functions import shared
    from tessera.plans import views

    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    scores = spark.range(2000).selectExpr("id % 1000 AS id", "IF(id < 1000, 'a', 'b') AS model", "id / 2000 AS prob")
    mean = curation.ensemble(scores, spark.createDataFrame([("a", 0.25), ("b", 0.75)], "model string, weight double"), "id")
    assert max(r["n"] for r in mean.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) <= 150
    assert "hashpartitioning(model" not in mean._jdf.queryExecution().toString()
    assert abs(mean.filter("id = 7").first()["prob"] - (0.25 * 7 + 0.75 * 1007) / 2000) < 1e-12
    frames = views.frames(spark, "/root/testdata/sf0.001")
    assert max(r["n"] for r in frames.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) <= 300
