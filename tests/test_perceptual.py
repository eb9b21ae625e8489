"""Difference hashes and Hamming search against brute force."""

import math

import numpy as np
import pytest

from tessera.operators import perceptual as P


def plain_hash(grey):
    h, w = grey.shape
    big = np.kron(grey.astype(object), np.ones((P.ROWS, P.COLUMNS), int))  # every pixel cut into as many parts as there are cells
    cells = big.reshape(P.ROWS, h, P.COLUMNS, w).sum(axis=(1, 3))
    bits = [int(cells[r, c + 1] > cells[r, c]) for r in range(P.ROWS) for c in range(P.COLUMNS - 1)]
    value = int("".join(map(str, bits)), 2)
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("shape", [(8, 8), (1, 1), (5, 23), (40, 9), (37, 31)])
def test_hash_equals_exact_areas(shape):
    rng = np.random.default_rng(sum(shape))
    x = rng.integers(0, 240, shape)
    assert P.difference_hash(x) == plain_hash(x)
    assert P.difference_hash(x + 9) == P.difference_hash(np.kron(x, np.ones((3, 2), int))) == P.difference_hash(x)


@pytest.mark.parametrize("n, radius", [(2, 0), (100, 3), (10**4, 6), (10**6, 8), (10**9, 10), (10**12, 1)])
def test_tables_miss_no_pair(n, radius):
    plan = P.tables(n, radius)
    assert sum(bits for _, bits, _ in plan) == P.BITS and sum(r + 1 for *_, r in plan) == radius + 1
    rng = np.random.default_rng(n % 97)
    for _ in range(300):
        flipped = set(rng.choice(64, radius, replace=False).tolist())
        assert any(sum(a <= b < a + bits for b in flipped) <= r for a, bits, r in plan)


def plain_classes(rows, radius):
    names = sorted(k for k, h in rows if h is not None)
    of, hashes = {k: k for k, _ in rows}, dict(rows)
    for start in names:
        if of[start] != start:
            continue
        todo, seen = [start], {start}
        while todo:
            x = todo.pop()
            for y in names:
                if y not in seen and ((hashes[x] ^ hashes[y]) & ((1 << 64) - 1)).bit_count() <= radius:
                    seen.add(y)
                    todo.append(y)
        for y in seen:
            of[y] = start
    return of


@pytest.mark.parametrize("block", [2048, 12])
def test_near_images_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = np.random.default_rng(1)
    seeds, rows = rng.integers(-(2**63), 2**63 - 1, 25), []
    for i in range(160):
        value = int(seeds[i % 25])
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            value ^= -(1 << 63) if b == 63 else 1 << int(b)
        rows.append((f"i{i:03d}", value))
    rows += [("blank1", 0), ("blank2", 0), ("blank3", 1), ("none1", None), ("none2", None)]
    got = P.near_images(spark.createDataFrame(rows, "path string, hash long"), 5).collect()
    assert {r["path"]: r["class_id"] for r in got} == plain_classes(rows, 5)
    copies = {h: sum(h == x for _, x in rows) for _, h in rows if h is not None}
    assert all(r["copies"] == copies.get(dict(rows)[r["path"]], 1) for r in got)
    assert P.near_images(spark.createDataFrame([], "path string, hash long")).count() == 0


def test_search_moves_few_rows_and_calls_few_buckets():
    """A million hashes within 6 bits: before, 277 rows a hash in 8 million buckets."""
    plan = P.tables(10**6, 6)
    assert sum(sum(math.comb(bits, r) for r in range(radius + 1)) for _, bits, radius in plan) <= 60
    assert sum(1 << bits for _, bits, _ in plan) <= 300_000 and len(P.tables(10**9, 6)) < len(P.tables(10**4, 6))
