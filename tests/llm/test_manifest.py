"""The Merkle manifest against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, lo string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """(root, [siblings of each leaf, level by level]) of digests in order."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 3 * 3
            p.append((level[run : at[i]], level[at[i] + 1 : run + 3]))
            at[i] //= 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in order:
        leaves = sorted((r[0] is not None, r[0] or 0, sha(*map(field, r[:5]))) for r in groups[g])
        trees[g] = (leaves, *plain_tree([h for _, _, h in leaves]))
    root, above = plain_tree([trees[g][1] for g in order])
    for g, top in zip(order, above, strict=True):
        leaves, sub, paths = trees[g]
        for (there, i, h), path in zip(leaves, paths, strict=True):
            whole = path + top
            out.append((i if there else None, h, sub, root, sha(*(x for a, b in whole for x in [*a, *b]))))
    return out


def rows_of(sizes):
    rng = random.Random(2)
    out = []
    for g, n in sizes.items():
        for _ in range(n):
            out.append((rng.randint(0, 500), g, rng.choice(["en", None]), rng.randint(0, 9), rng.choice(["", None, "é\nline", "x" * 3000]), "clash", "lo"))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 4}, {None: 10, "": 2, "Z": 1, "a": 28, "é": 9, "z-": 82, "-": 27}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    rows += [rows[0], rows[0], (None, *rows[0][1:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    proofs = manifest.prove(docs, carry={"digest": F.lit("x")})
    got = proofs.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("p"), (manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (manifest.fold(F.col("digest"), F.col("path")) == F.col("root")).alias("false")).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, plain(rows)))
    assert all(r["ok"] and r["false"] == (len(rows) == 1) for r in got)


def test_empty_table_and_a_megabyte(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1 << 20, "a\n" * (1 << 19), "", "")], SCHEMA)
    assert manifest.prove(docs.limit(0)).count() == 0
    row = manifest.prove(docs).first()
    assert row["root"] == row["subroot"] == row["leaf"] == sha(*map(field, (1, "s", "en", 1 << 20, "a\n" * (1 << 19)))) and row["path"] == []
