"""Incremental manifests and running metrics: restarts, replays, what is read."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from tessera.operators import metrics
from tessera.streaming import incremental, live


def land(spark, folder, rows, files=1):
    spark.createDataFrame(rows, "id long, method string").repartition(files).write.mode("append").parquet(folder)


def test_a_second_run_reads_the_new_files_only(spark, tmp_path):
    new, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "id long, method string"
    land(spark, new, [(i, "a") for i in range(500)] + [(7, "b"), (None, "x"), (None, "y")])
    first = incremental.grow_manifest(spark, new, schema, out, state, "id")
    land(spark, new, [(i, "c") for i in range(490, 510)])
    # Neither the manifest nor the files of the first run are needed any more.
    for name in os.listdir(out):
        if name.endswith(".parquet"):
            os.rename(f"{out}/{name}", f"{out}/{name}.away")
    second = incremental.grow_manifest(spark, new, schema, out, state, "id")
    for name in os.listdir(out):
        if name.endswith(".away"):
            os.rename(f"{out}/{name}", f"{out}/{name.removesuffix('.away')}")
    assert sum(p["numInputRows"] for p in first.recentProgress) == 503 and sum(p["numInputRows"] for p in second.recentProgress) == 20
    rows = spark.read.parquet(out).collect()
    assert sorted(r["id"] for r in rows if r["id"] is not None) == list(range(510)) and sum(r["id"] is None for r in rows) == 1
    third = incremental.grow_manifest(spark, new, schema, out, state, "id")
    assert not sum(p["numInputRows"] for p in third.recentProgress) and spark.read.parquet(out).count() == 511
    operators = second.recentProgress[0]["stateOperators"][0]
    assert any("rocksdb" in name.lower() for name in operators["customMetrics"])


@pytest.mark.parametrize("lost", ["commit", "sink and commit"])
def test_a_batch_that_was_killed_is_done_again(spark, tmp_path, lost):
    new, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    land(spark, new, [(i, "a") for i in range(50)])
    incremental.grow_manifest(spark, new, "id long, method string", out, state, "id")
    land(spark, new, [(i, "b") for i in range(40, 80)])
    incremental.grow_manifest(spark, new, "id long, method string", out, state, "id")
    # As if the driver had died between the batch's files and its last log entries.
    gone = [f"{state}/commits/1", f"{state}/commits/.1.crc"] + ([f"{out}/_spark_metadata/1", f"{out}/_spark_metadata/.1.crc"] if lost != "commit" else [])
    for path in gone:
        if os.path.exists(path):
            os.remove(path)
    incremental.grow_manifest(spark, new, "id long, method string", out, state, "id")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(80))


def test_a_failing_task_leaves_nothing_behind(spark, tmp_path):
    out, state, flag = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "broken")
    new = str(tmp_path / "in")
    land(spark, new, [(i, "a") for i in range(200)], 4)
    open(flag, "w").close()

    @F.udf("long")
    def once(i):
        if i == 150 and os.path.exists(flag):
            raise ValueError("disk lost")
        return i

    def run():
        stream = spark.readStream.schema("id long, method string").option("maxFilesPerTrigger", 2).parquet(new)
        with incremental.rocksdb_state(spark):
            query = stream.dropDuplicates(["id"]).withColumn("id", once("id")).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    os.remove(flag)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(200))


def test_bounded_state_forgets(spark, tmp_path):
    new, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    at = lambda day: f"timestamp '2024-01-{day:02d}'"
    put = lambda rows: spark.sql(" UNION ALL ".join(f"SELECT {i}L AS id, {at(day)} AS ts" for i, day in rows)).coalesce(1).write.mode("append").parquet(new)
    for rows in ([(1, 1), (1, 1), (2, 2)], [(3, 20)], [(1, 21)]):
        put(rows)
        incremental.grow_manifest(spark, new, "id long, ts timestamp", out, state, "id", "ts", "2 days")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 1, 2, 3]


def scored(spark, n, grid):
    rng = random.Random(n)
    return spark.createDataFrame([(i, rng.choice("ab"), rng.randrange(grid + 1) / grid, int(rng.random() < 0.4)) for i in range(n)] + [(n, "one", 0.5, 1), (n + 1, "a", None, 1), (n + 2, "b", 0.3, None), (n + 3, "a", float("nan"), 0)], "id long, domain string, prob double, label int")


def stream(spark, rows, folder, files):
    rows.repartition(files).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_running_auc_equals_the_exact_one_and_replays_change_nothing(spark, tmp_path):
    rows = scored(spark, 400, 50)
    changes = live.score_cells(stream(spark, rows, str(tmp_path / "in"), 4), ["domain"], "prob", cells=50)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.run_keyed(changes, out, state)
    assert sorted(os.listdir(out)) == [f"batch={k}" for k in range(4)]
    cells = live.latest(spark, out, changes.schema, ["domain", "cell"])
    want = {r["domain"]: r["auc"] for r in metrics.roc_auc(rows.filter("prob IS NOT NULL AND NOT isnan(prob) AND label IS NOT NULL"), "prob", ["domain"]).collect()}
    auc = lambda: {r["domain"]: r["auc"] for r in live.live_auc(live.latest(spark, out, changes.schema, ["domain", "cell"]), ["domain"]).collect()}
    first = auc()
    assert first["one"] is None and all(first[k] == pytest.approx(want[k], abs=1e-12) for k in ("a", "b"))
    before = sorted(map(tuple, cells.collect()))
    for path in (f"{state}/commits/3", f"{state}/commits/.3.crc"):
        if os.path.exists(path):
            os.remove(path)
    live.run_keyed(changes, out, state)  # the last batch again
    assert sorted(map(tuple, live.latest(spark, out, changes.schema, ["domain", "cell"]).collect())) == before and auc() == first
    live.compact(spark, out, changes.schema, ["domain", "cell"], str(tmp_path / "small"))
    assert sorted(map(tuple, live.latest(spark, str(tmp_path / "small"), changes.schema, ["domain", "cell"]).collect())) == before
    assert live.latest(spark, str(tmp_path / "none"), changes.schema, ["domain", "cell"]).count() == 0


def test_cells_bound_the_error_and_bins_hold_all_rows(spark):
    rows = scored(spark, 3000, 100_003)
    known = rows.filter("prob IS NOT NULL AND NOT isnan(prob) AND label IS NOT NULL")
    cells = live.score_cells(rows, ["domain"], "prob", cells=1000)
    want = {r["domain"]: r["auc"] for r in metrics.roc_auc(known, "prob", ["domain"]).collect()}
    assert all(r["auc"] is None or r["auc"] == pytest.approx(want[r["domain"]], abs=1e-3) for r in live.live_auc(cells, ["domain"]).collect())
    bins = live.live_calibration(cells, ["domain"], 100).collect()
    assert sum(r["n"] for r in bins) == known.count() and max(r["bin"] for r in bins) == 9
    assert all(abs(r["mean_score"] - (r["bin"] + 0.5) / 10) < 0.06 for r in bins)
