"""Classes of the rows of one group: near pairs are looked for tile by tile, and only between different classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Rows of each side of a tile.
TILE = 512
#: Pairs whose cosine is computed anew at once.
CHECKED = 1 << 16

Apart = Callable[[np.ndarray, np.ndarray], np.ndarray]
Near = Callable[[slice, slice, Apart], Iterator[tuple[np.ndarray, np.ndarray]]]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of each pair under the smaller root; every root points to its end afterwards."""
    while True:
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def joined(here: np.ndarray, there: np.ndarray | None, near_of: Callable[[np.ndarray, np.ndarray], Near]) -> tuple[np.ndarray, np.ndarray]:
    """(class, smallest class it is joined to), for each class that near rows join to a smaller one.

    ``here`` and ``there`` have the classes of the rows of two sides; without ``there`` one side is compared with itself.
    ``near_of`` takes the order in which the rows of the sides are compared. Rows of a class stand together, so tiles that are
    of one class by then are passed over.
    """
    one = there is None
    names, code = np.unique(here if one else np.concatenate([here, there]), return_inverse=True)
    a = code[: len(here)]
    b = a if one else code[len(here) :]
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, near, root = a[first], b[second], near_of(first, second), np.arange(len(names))
    for i in range(0, len(a), TILE):
        for j in range(i if one else 0, len(b), TILE):
            x, y = a[i : i + TILE], b[j : j + TILE]
            met = root[x[0]]
            if (root[x] == met).all() and (root[y] == met).all():
                continue
            apart = lambda p, q, x=x, y=y: root[x[p]] != root[y[q]]
            for p, q in near(slice(i, i + TILE), slice(j, j + TILE), apart):
                _join(root, x[p], y[q])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return names[moved], names[root[moved]]


def classes(keys: np.ndarray, near_of: Callable[[np.ndarray, np.ndarray], Near]) -> np.ndarray:
    """The smallest key that each row reaches over near rows of the group."""
    moved, to = joined(keys, None, near_of)
    of = dict(zip(moved.tolist(), to.tolist(), strict=True))
    return np.array([of.get(k, k) for k in keys.tolist()], dtype=keys.dtype)


def near_hashes(here: np.ndarray, there: np.ndarray, radius: int):
    """Pairs of 64-bit hashes that differ in ``radius`` bits or fewer."""

    def of(first: np.ndarray, second: np.ndarray) -> Near:
        x, y = here[first], there[second]

        def near(i: slice, j: slice, apart: Apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            hits = np.bitwise_count(x[i, None] ^ y[None, j]) <= radius
            yield np.divmod(np.flatnonzero(hits), hits.shape[1])

        return near

    return of


def near_vectors(here: np.ndarray, there: np.ndarray, least_cosine: float):
    """Pairs of vectors of at least ``least_cosine``: single precision first, those too close to the bound for it once more in double."""
    slack = max(1e-5, here.shape[1] * 2e-7)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def of(first: np.ndarray, second: np.ndarray) -> Near:
        x, y = unit(here[first].astype(np.float64)), unit(there[second].astype(np.float64))
        fast_x, fast_y = x.astype(np.float32), y.astype(np.float32)

        def near(i: slice, j: slice, apart: Apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            like = fast_x[i] @ fast_y[j].T
            places = np.flatnonzero(like >= least_cosine - slack)
            sure = like.ravel()[places] >= least_cosine + slack
            yield np.divmod(places[sure], like.shape[1])
            p, q = np.divmod(places[~sure], like.shape[1])
            for at in range(0, len(p), CHECKED):
                a, b = p[at : at + CHECKED], q[at : at + CHECKED]
                a, b = a[apart(a, b)], b[apart(a, b)]
                hit = np.einsum("ij,ij->i", x[i][a], y[j][b]) >= least_cosine
                yield a[hit], b[hit]

        return near

    return of
