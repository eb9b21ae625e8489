"""Cells of vectors: recall against brute force at two sizes, candidates, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells as C


def groups(n, rng, dim=64, spread=0.85):
    """Vectors around n / 10 directions: pairs of a group have a cosine of about 0.58, others about 0."""
    centre = C._unit(rng.normal(size=(max(1, n // 10), dim)))
    return C._unit(centre[rng.integers(len(centre), size=n)] + spread * C._unit(rng.normal(size=(n, dim))))


def met(cells, x, bound):
    """(share of the pairs over the bound that meet, candidates a vector) by brute force."""
    like = x @ cells.centres.T
    own, near = np.argmax(like, axis=1), np.argsort(-like, axis=1)[:, : cells.visits]
    visits = np.zeros(like.shape, bool)
    visits[np.arange(len(x))[:, None], near] = True
    found = over = 0
    for lo in range(0, len(x), 2000):
        a, b = np.nonzero(np.triu(x[lo : lo + 2000] @ x.T >= bound, lo + 1))
        over += len(a)
        found += int((visits[a + lo, own[b]] | visits[b, own[a + lo]]).sum())
    return found / over, (visits.sum(0) * np.bincount(own, minlength=len(cells.centres))).sum() / len(x)


def test_recall_and_candidates_at_two_sizes():
    rng, per_row = np.random.default_rng(5), []
    for n in (3_000, 30_000):
        x = groups(n, rng)
        cells = C.fit_cells(x[: C.SAMPLE], n, 0.45, 0.97)
        share, candidates = met(cells, x, 0.45)
        per_row.append(candidates)
        assert share >= 0.95, (n, share, cells.visits)
    # Visits grow where the data have more directions than cells: far below all pairs, but not flat.
    assert per_row[1] <= 0.25 * 30_000 and per_row[1] <= 7 * per_row[0], per_row


def plain(rows, bound):
    x = C._unit(np.array([v for _, v in rows]))
    near, of = x @ x.T >= bound, list(range(len(rows)))
    for start in range(len(rows)):
        if of[start] == start:
            todo = [start]
            while todo:
                i = todo.pop()
                for j in np.flatnonzero(near[i]).tolist():
                    if of[j] != start and of[j] == j and j > start:
                        of[j] = start
                        todo.append(j)
    return {k: rows[o][0] for (k, _), o in zip(rows, of, strict=True)}


@pytest.mark.parametrize("block", [2048, 20])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "CELL", 40)
    x = groups(300, np.random.default_rng(3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(5)]
    df = spark.createDataFrame([*rows, (2000, None), (2001, [float("nan")] * 64)], "id long, v array<double>").repartition(3)
    got = {r["id"]: (r["class_id"], r["copies"]) for r in C.near_copies_by_cells(df, "id", "v", 0.45, 1.0).collect()}
    want = plain(rows, 0.45)
    same = sum(got[i][0] == want[i] for i in want)
    assert same >= 0.99 * len(want) and got[2000] == (2000, 1) and got[2001] == (2001, 1) and got[1003][1] == 6
    assert len(got) == len(rows) + 2 and C.near_copies_by_cells(df.limit(0), "id", "v", 0.45).count() == 0
    assert C.near_copies_by_cells(df.filter("id = 1"), "id", "v", 0.45).select(F.max("class_id")).first()[0] == 1


def test_rows_moved_do_not_grow_with_the_table():
    """At 600,000 vectors a vector visits no more cells than at 60,000, and fewer than 128; before, cells and visits grew with the table."""
    x = groups(3_000, np.random.default_rng(7))
    small, large = C.fit_cells(x, 60_000, 0.45, 0.97), C.fit_cells(x, 600_000, 0.45, 0.97)
    assert large.visits == small.visits <= len(large.centres) <= 128
