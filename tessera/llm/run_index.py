"""A run-length index: Burrows-Wheeler runs with suffix samples at both ends of every run.

All tables have one entry a run. A step of backward search finds the run of the wanted symbol by binary
search and maps its row to the row of the longer match (LF); the place in the text is known throughout,
since a search that leaves a run goes on at the sample of the nearest run of that symbol. Which of the
two neighbours keeps more of the match is told by the longest common extension of their samples. Texts
are streamed from their ends to their starts, all of them at once, one symbol a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols of the text: the end of all texts, the end of one, and bytes from FIRST on.
FINISH, STOP, FIRST = 0, 1, 2
_WORD, _BITS = 7, 9  # symbols of 9 bits in a 63-bit word


def packed(text: np.ndarray) -> np.ndarray:
    """The _WORD symbols from each place on as one number; FINISH follows the end."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(_WORD, np.uint64)])
    out = np.zeros(n, np.uint64)
    for k in range(_WORD):
        out <<= np.uint64(_BITS)
        out |= padded[k : n + k]
    return out


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order: by their first word, ties by the rank of what follows, doubling its length."""
    n = len(words)
    order = np.argsort(words)
    key = words[order]
    at, depth = np.arange(n), _WORD
    rank = np.empty(n, np.int64)  # of each suffix, the first row of those that are equal so far
    while len(at):
        same = key[1:] == key[:-1]
        new = np.flatnonzero(np.concatenate([[True], ~same]))
        row = np.repeat(at[new], np.diff(new, append=len(at)))
        rank[order[at]] = row
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at, row = at[tied], row[tied]
        later = order[at] + depth
        key = row * (n + 1) + np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, order[at] = key[by], order[at][by]
        depth *= 2
    return order


class RunIndex:
    """Run-length index of a text of symbols that ends with its only FINISH."""

    def __init__(self, text: np.ndarray):
        self.size = n = len(text)
        self.words = packed(text)
        order = suffix_array(self.words)
        before = text[order - 1].astype(np.int64)
        heads = np.flatnonzero(np.diff(before, prepend=-1) != 0)
        tails = np.append(heads[1:], n) - 1
        #: Suffixes at the first row of each run, and at the row above it.
        self.heads, self.above = order[heads], order[heads[1:] - 1]
        by = np.argsort(before[heads], kind="stable")
        length = (tails - heads + 1)[by]
        # Runs by symbol, then row; a run's first row maps to the number of symbols in the runs before it.
        self.symbol = np.append(before[heads][by], -1)
        self.start, self.end = heads[by], tails[by] + 1
        self.first, self.last = order[heads][by], order[tails][by]
        self.target = np.cumsum(length) - length - self.start
        self.key = self.symbol[:-1] * n + self.start
        self.top = order[0]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b (different places), up to ``most``."""
        n, out = self.size, np.zeros(len(a), np.int64)
        most = np.full(len(a), n) if most is None else most
        todo = np.flatnonzero(most > 0)
        while len(todo):
            x, y = a[todo] + out[todo], b[todo] + out[todo]
            inside = (x < n) & (y < n)
            todo, x, y = todo[inside], x[inside], y[inside]
            differ = self.words[x] ^ self.words[y]
            step = np.zeros(len(todo), np.int64)
            for k in range(1, _WORD + 1):
                step += differ < np.uint64(1 << (_BITS * (_WORD - k)))
            out[todo] += step
            todo = todo[(step == _WORD) & (out[todo] < most[todo])]
        return np.minimum(out, most)

    def matches(self, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Stream the strings ``text[end - size : end]`` against the index.

        Yields (strings, symbols before their end, places): where the matching statistic is at least
        ``least``, with a place in the indexed text that has the longest match.
        """
        by = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[by], sizes[by]
        row, place, length = np.zeros(len(by), np.int64), np.full(len(by), self.top), np.zeros(len(by), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            m = int(np.searchsorted(-sizes, -step, side="right"))
            row, place, length = row[:m], place[:m], length[:m]
            symbol = text[ends[:m] - step].astype(np.int64)
            run = np.searchsorted(self.key, symbol * self.size + row, side="right") - 1
            own = self.symbol[run] == symbol
            left = np.flatnonzero(~own | (row >= self.end[run]))
            if len(left):
                above, had, was = run[left], length[left], place[left]
                up, down = own[left], self.symbol[above + 1] == symbol[left]
                below = np.minimum(above + 1, len(self.start) - 1)
                keeps_up = np.where(up, self.common(was, self.last[above], np.where(up, had, 0)), -1)
                keeps_down = np.where(down, self.common(was, self.first[below], np.where(down, had, 0)), -1)
                lower = keeps_down > keeps_up
                run[left] = np.where(lower, below, above)
                row[left] = np.where(lower, self.start[below], self.end[above] - 1)
                place[left] = np.where(lower, self.first[below], self.last[above])
                length[left] = np.maximum(keeps_up, keeps_down)
            row = self.target[run] + row
            place, length = place - 1, length + 1
            if len(left):
                lost = left[~(up | down)]  # the symbol is nowhere in the text
                row[lost], place[lost], length[lost] = 0, self.top, 0
            if step >= least:
                hit = np.flatnonzero(length >= least)
                if len(hit):
                    yield by[hit], step, place[hit]

    def classes(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, class): equal classes for suffixes of the text that agree in ``least`` symbols or more.

        The common prefix with the suffix above is measured at the heads of the runs only. Behind a head
        it gets shorter by one with each symbol of the text, until the next head. The rows are walked
        upwards from the head of the next run by the same distances.
        """
        n = self.size
        sampled = np.sort(self.heads)
        measured = np.full(n, -1, np.int64)
        measured[self.heads[1:]] = self.common(self.heads[1:], self.above)
        measured[self.heads[0]] = 0
        nearest = sampled[np.searchsorted(sampled, np.arange(n), side="right") - 1]
        match = measured[nearest] - (np.arange(n) - nearest)
        # The suffix above each suffix: the one above the nearest head, moved by the distance to it.
        above = np.full(n, -1, np.int64)
        above[self.heads[1:]] = self.above
        above = np.where(match >= least, above[nearest] + (np.arange(n) - nearest), np.arange(n))
        while True:  # to the topmost suffix of the class
            further = above[above]
            if np.array_equal(further, above):
                return np.arange(n), above
            above = further
