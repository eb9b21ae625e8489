"""Versioned tables: concurrent writers, crashes, time travel."""

import threading

import pytest

from tessera.sources import snapshots as S


def rows(spark, ids, name="a"):
    return spark.createDataFrame([(i, name) for i in ids], "id long, name string")


def ids(df):
    return sorted(r["id"] for r in df.collect() if r["id"] is not None)


def test_versions_changes_and_tokens(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        S.read(spark, t)
    assert S.commit(rows(spark, [1, 2, 2, None, None]), t, ["id"]).number == 1
    assert S.commit(rows(spark, [2, 3, None], "b"), t, ["id"], token="x").number == 2
    assert S.commit(rows(spark, [9]), t, token="x").number == 2  # that write is in already
    assert ids(S.read(spark, t)) == [1, 2, 3] and ids(S.read(spark, t, 1)) == [1, 2] and S.read(spark, t).count() == 4
    assert ids(S.changes(spark, t, 1)) == [3]
    assert S.commit(rows(spark, [], "c"), t, ["id"]).number == 3 and S.read(spark, t).count() == 4
    assert S.compacted(spark, t).number == 4 and ids(S.read(spark, t)) == [1, 2, 3] and ids(S.read(spark, t, 2)) == [1, 2, 3]
    with pytest.raises(S.Conflict):
        S.changes(spark, t, 1)
    with pytest.raises(ValueError):
        S.commit(rows(spark, [5]).withColumnRenamed("name", "other"), t)
    S.commit(rows(spark, [7]), t, replace=True)
    assert ids(S.read(spark, t)) == [7] and [v.number for v in S.history(spark, t)] == [1, 2, 3, 4, 5]
    assert S.vacuum(spark, t) == 4 and ids(S.read(spark, t)) == [7] and len(S.history(spark, t)) == 1


def test_partitions_and_csv(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    S.commit(rows(spark, [1, 2]), t, partition_by=["name"], form="csv", replace=True)
    S.commit(rows(spark, [2, 3], "b"), t, ["id"], partition_by=["name"], form="csv")
    assert sorted(map(tuple, S.read(spark, t).select("id", "name").collect())) == [(1, "a"), (2, "a"), (3, "b")]
    with pytest.raises(ValueError):
        S.commit(rows(spark, [4]), t)


@pytest.mark.parametrize("writers", [2, 4])
def test_concurrent_writers_add_no_key_twice(spark, tmp_path, monkeypatch, writers):
    """All stage against the same version; then they claim at once."""
    t, gate, failed = f"file://{tmp_path}/t", threading.Barrier(writers), []
    S.commit(rows(spark, range(10)), t, ["id"])
    claim, first = S._claim, threading.local()

    def together(*args):
        if not getattr(first, "done", False):
            first.done = True
            gate.wait(120)
        return claim(*args)

    monkeypatch.setattr(S, "_claim", together)

    def write(k):
        try:
            S.commit(rows(spark, range(5 + k, 30 + k), f"w{k}"), t, ["id"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(writers)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and ids(S.read(spark, t)) == list(range(29 + writers)) and S.version(spark, t).number == 1 + writers
    for n in range(1, 2 + writers):
        assert len(set(ids(S.read(spark, t, n)))) == S.read(spark, t, n).count()


def test_a_crash_before_the_claim_changes_nothing(spark, tmp_path, monkeypatch):
    t = f"file://{tmp_path}/t"
    S.commit(rows(spark, [1]), t, ["id"])

    def dies(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(S, "_claim", dies)
        with pytest.raises(OSError):
            S.commit(rows(spark, [2, 3]), t, ["id"])
    assert ids(S.read(spark, t)) == [1]
    S.commit(rows(spark, [2, 3]), t, ["id"])
    assert ids(S.read(spark, t)) == [1, 2, 3] and S.vacuum(spark, t, keep=5) == 1


def test_replacing_what_another_writer_changed_is_refused(spark, tmp_path, monkeypatch):
    t = f"file://{tmp_path}/t"
    S.commit(rows(spark, [1]), t)
    claim, done = S._claim, []

    def late(*args):
        if not done:
            done.append(1)
            S.commit(rows(spark, [2]), t)
        return claim(*args)

    monkeypatch.setattr(S, "_claim", late)
    with pytest.raises(S.Conflict):
        S.commit(rows(spark, [3]), t, replace=True)
    assert ids(S.read(spark, t)) == [1, 2]
