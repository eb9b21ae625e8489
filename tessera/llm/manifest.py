"""Merkle manifest of a dataset: hash trees over the documents of each group, and one tree over the groups.

Every node carries the interval of leaf ranks that it covers. Trees are built one level at a time by grouping
on the bucket ``rank div FANOUT^level``. Ancestors are attached from the roots down by containment joins within
the buckets of a level; what a parent's interval holds beside the node's own are the node's siblings. So no
task holds more than FANOUT digests of a tree, however large the group, and a proof is handed down once
for all leaves below a node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import broadcast_if_small, discard, materialise

FANOUT = 3
#: Rows up to which the counts of groups by partition are broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 texts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*map(field, values))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``lo`` (rank from 0 within ``grp``, in ``order``) and ``size`` (of the group).

    Rows are sorted by ranges, so a group of any size is spread over partitions; its ranks are places in
    the partition plus the counts of the partitions before.
    """
    ordered = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    # The id's upper bits are the partition, its lower 33 bits count the partition's rows.
    ordered = materialise(ordered.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    pieces = ordered.groupBy("grp", "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = materialise(pieces.select("grp", "_part", (F.col("_first") - before).alias("_base"), F.sum("_n").over(group).alias("size")))
    out = ordered.join(broadcast_if_small(pieces, pieces.count(), BROADCAST_ROWS), ["grp", "_part"])
    return out.withColumn("lo", F.col("_place") - F.col("_base")).drop("_place", "_part", "_base")


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {FANOUT**level}L")


def grow(leaves: DataFrame) -> list[DataFrame]:
    """Nodes of each level from the leaves (grp, size, lo, digest) up: grp, size, lo, hi, digest, kids.

    A level has the nodes of groups that still had several nodes below it, so the root of a group of
    ``size`` leaves is on the first level whose nodes cover that many.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0
    levels = [leaves.withColumn("hi", F.col("lo") + 1)]
    while FANOUT ** (len(levels) - 1) < most:
        k = len(levels)
        below = levels[-1].filter(F.col("size") > FANOUT ** (k - 1))
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))  # FANOUT at most
        nodes = below.groupBy("grp", "size", _bucket(k).alias("_bucket")).agg(kids.alias("kids")).drop("_bucket")
        nodes = nodes.select("grp", "size", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), digest(F.array_join("kids.digest", "")).alias("digest"), "kids")
        levels.append(materialise(nodes))
    return levels


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """grp, digest: the root of each group."""
    return reduce(DataFrame.unionByName, (nodes.filter(F.col("size") <= FANOUT**k).select("grp", "digest") for k, nodes in enumerate(levels)))


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with all columns of ``tops`` (grp, path and any others, one row a group) and their paths.

    A path is an array, from the leaf up, of the digests ``before`` and ``after`` the node among its
    siblings; it ends with the group's path in ``tops``. Deletes the levels above the leaves.
    """
    handed = [c for c in tops.columns if c not in ("grp", "path")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k].withColumn("_bucket", _bucket(k + 1))
        out = nodes.filter(F.col("size") <= FANOUT**k).join(tops, "grp")
        if above is not None:
            parents = above.select("grp", _bucket(k + 1).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), *handed)
            inner = nodes.filter(F.col("size") > FANOUT**k).join(parents, ["grp", "_bucket"]).filter("_lo <= lo AND hi <= _hi")
            # The parent's interval without the node's own: what ends before it, what starts behind it.
            left = F.array_join(F.filter("_kids", lambda x: x["hi"] <= F.col("lo"))["digest"], "")
            right = F.array_join(F.filter("_kids", lambda x: x["lo"] >= F.col("hi"))["digest"], "")
            step = F.array(F.struct(left.alias("before"), right.alias("after")))
            out = out.unionByName(inner.withColumn("path", F.concat(step, F.col("_path"))).drop("_lo", "_hi", "_kids", "_path"))
        out = out.drop("_bucket")
        if k:
            out = materialise(out)
            discard(levels[k])
            if above is not None:
                discard(above)
        above = out
    return above.drop("hi")


def prove(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """``id_col``, leaf, subroot (of the group), root, path, and the columns ``carry``, for every row of ``docs``.

    A leaf is the digest of the ``fields``. Leaves of a group ascend by ``id_col``; null ids come first, rows of
    one id are ordered by their leaf, and equal rows each are a leaf of their own. A null group is a group and
    comes before all others, which ascend by their UTF-8 bytes. A lone leaf is its group's subroot, a lone
    subroot the root. Nulls in any field, empty texts and texts of any length have a leaf; an empty table
    gives an empty result. Columns not named are not read, whatever their names.
    """
    carry = dict(carry or {})
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # "-" sorts before "="
    rows = docs.select(F.col(id_col).alias("id"), group.alias("grp"), leaf([F.col(f) for f in fields]).alias("digest"), *(c.alias(f"carry_{n}") for n, c in carry.items()))
    levels = grow(placed(rows, ["id", "digest"]))
    subroots = materialise(roots(levels)).select(F.lit("all").alias("grp"), F.col("grp").alias("name"), "digest")
    top = grow(placed(subroots, ["name"]))
    summit = roots(top).select("grp", F.col("digest").alias("root"), F.array().cast(NO_PATH).alias("path"))
    tops = materialise(descend(top, summit).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path"))
    return descend(levels, tops).select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *(F.col(f"carry_{n}").alias(n) for n in carry))


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda node, p: digest(p["before"], node, p["after"]))


def manifest_sql() -> str:
    """op12 in SQL: levels by recursion on the position, proofs by a join of every leaf with every level."""
    part = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END"
    leaf_of = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    # CRC-32 (reflected polynomial 0xEDB88320): each byte is mixed in, then shifted out bit by bit.
    bits = "list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce(CAST({bits} AS BIGINT[]), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    tree = lambda name, leaves: f"""{name} AS (SELECT 0 AS lvl, grp, pos, size, h FROM {leaves}
      UNION ALL SELECT any_value(lvl) + 1, grp, pos // 3, any_value((size + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE size > 1 GROUP BY grp, pos // 3)"""  # noqa: E731
    family = lambda tree: f"""SELECT a.lvl, a.grp, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
      FROM {tree} a JOIN {tree} b ON a.lvl = b.lvl AND a.grp = b.grp AND a.pos // 3 = b.pos // 3 AND a.size > 1 GROUP BY ALL"""  # noqa: E731
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '-') AS grp, {leaf_of("text")} AS h,
      CASE WHEN {crc} % 2 = 0 THEN {leaf_of("replace(text, chr(10), '')")} ELSE {leaf_of("text")} END AS other FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM d),
    {tree("t", "leaves")},
    sub AS (SELECT grp AS name, h, 'all' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1),
    {tree("u", "sub")},
    k AS ({family("t")}), w AS ({family("u")}),
    depth AS (SELECT grp, max(lvl) AS top FROM t GROUP BY grp),
    steps AS (SELECT p.grp, p.pos, k.lvl AS step, l, r FROM leaves p JOIN k ON k.grp = p.grp AND k.pos = p.pos // CAST(pow(3, k.lvl) AS BIGINT)
      UNION ALL SELECT p.grp, p.pos, top + w.lvl, l, r FROM leaves p JOIN depth USING (grp) JOIN sub ON sub.name = p.grp JOIN w ON w.pos = sub.pos // CAST(pow(3, w.lvl) AS BIGINT)),
    f AS (SELECT grp, pos, 0 AS step, other AS node FROM leaves
      UNION ALL SELECT f.grp, f.pos, f.step + 1, sha256(l || node || r) FROM f JOIN steps s ON s.grp = f.grp AND s.pos = f.pos AND s.step = f.step),
    e AS (SELECT grp, pos, arg_max(node, step) AS folded_root FROM f GROUP BY grp, pos),
    q AS (SELECT grp, pos, string_agg(l || r, '' ORDER BY step) AS siblings FROM steps GROUP BY grp, pos),
    root AS (SELECT h AS root FROM u WHERE size = 1)
    SELECT p.doc_id, p.h AS leaf, sub.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves p JOIN sub ON sub.name = p.grp JOIN e ON e.grp = p.grp AND e.pos = p.pos LEFT JOIN q ON q.grp = p.grp AND q.pos = p.pos, root"""
