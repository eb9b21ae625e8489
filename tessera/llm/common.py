"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Rows that a Python worker turns into one Arrow batch of results.
SLICE_ROWS = 512

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def lower_ascii(col):
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def hash_fraction(col, seed: str):
    """A deterministic pseudo-random number in [0, 1) for each value of ``col``."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 30)) / F.lit(float(1 << 30))
