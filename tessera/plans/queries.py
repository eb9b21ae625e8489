"""Registered queries: each operator on the canonical views, with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions.hashing import hash_ranked
from tessera.operators import curation as C
from tessera.operators import history as H
from tessera.operators import metrics as A
from tessera.operators import sampling as B
from tessera.operators import splits as D
from tessera.operators import vectors as V
from tessera.operators.cells import near_copies_by_cells
from tessera.operators.images import decode_audit, domain_gap, image_stats
from tessera.operators import registry as X
from tessera.operators.perceptual import near_images, perceptual_hashes
from tessera.plans.views import G, M, P, R, frames, pages, runs, samples, table
from tessera.sources import manifests as S
from tessera.sources import sinks, snapshots
from tessera.streaming import incremental as I
from tessera.streaming import live as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; results are rounded once, at the end."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _split_sql(parts: str, stratum: str = "", key: str = "identity", first: str = "") -> str:
    over = f"PARTITION BY {stratum} " if stratum else ""
    cols = f"{stratum}, {key}" if stratum else key
    return f"""{M}, k AS (SELECT *, row_number() OVER ({over}ORDER BY md5('42:' || {key}), {key}) AS rank, count(*) OVER ({over.strip()}) AS n FROM (SELECT DISTINCT {cols} FROM m)),
    s AS (SELECT {cols}, {parts} AS split FROM k)"""


TWO = "CASE WHEN rank <= greatest(1, floor(n * 0.7 + 1e-9)) THEN 'train' ELSE 'test' END"
THREE = "CASE WHEN rank <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN rank <= floor(n * 0.7 + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'val' ELSE 'test' END"
PARTS3 = {"train": 0.7, "val": 0.15, "test": 0.15}


def two_way(m: DataFrame) -> DataFrame:
    return D.split_groups(m, ["identity"], {"train": 0.7, "test": 0.3}, at_least_one=True)


CELLS = "count(*) AS n, count(*) FILTER (label=0 AND pred=0) AS tn, count(*) FILTER (label=0 AND pred=1) AS fp, count(*) FILTER (label=1 AND pred=0) AS fn, count(*) FILTER (label=1 AND pred=1) AS tp"
RATIOS = """CAST(CASE WHEN n=0 THEN 0 ELSE (tp+tn)/n END AS DOUBLE) AS accuracy, CAST(CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END AS DOUBLE) AS precision,
CAST(CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END AS DOUBLE) AS recall, CAST(CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END AS DOUBLE) AS f1,
CAST(CASE WHEN tn+fp=0 THEN NULL ELSE tn/(tn+fp) END AS DOUBLE) AS real_acc, CAST(CASE WHEN tp+fn=0 THEN NULL ELSE tp/(tp+fn) END AS DOUBLE) AS fake_det"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity-disjoint split, decisions at 0.5, metrics of every slice on the test side."""
    return A.metrics_by_slice(two_way(samples(spark, sf_dir)).filter("split = 'test'"))


FLAGSHIP_SQL = f"""{_split_sql(TWO)}, t AS (SELECT m.* FROM m JOIN s USING (identity) WHERE split = 'test'),
c AS (SELECT 'overall' AS slice_kind, NULL AS domain, NULL AS method, {CELLS} FROM t
UNION ALL SELECT 'domain', domain, NULL, {CELLS} FROM t GROUP BY domain
UNION ALL SELECT 'method', NULL, method, {CELLS} FROM t GROUP BY method
UNION ALL SELECT 'method_domain', domain, method, {CELLS} FROM t GROUP BY domain, method)
SELECT domain, method, n, tn, fp, fn, tp, {RATIOS}, slice_kind FROM c"""

QUERIES["identity_disjoint_evaluation"], SQL["identity_disjoint_evaluation"] = flagship, FLAGSHIP_SQL

# ---- splits


@query("split_identity_2way", f"{_split_sql(TWO)} SELECT sample_id, identity, split FROM m JOIN s USING (identity)")
def _(spark, d):
    return two_way(samples(spark, d)).select("sample_id", "identity", "split")


@query("split_identity_3way", f"{_split_sql(THREE)} SELECT sample_id, identity, split FROM m JOIN s USING (identity)")
def _(spark, d):
    return D.split_groups(samples(spark, d), ["identity"], PARTS3).select("sample_id", "identity", "split")


@query("split_fixed_counts", f"{_split_sql("CASE WHEN rank <= 20 THEN 'test' WHEN rank <= 28 THEN 'val' ELSE 'train' END")} SELECT sample_id, split FROM m JOIN s USING (identity)")
def _(spark, d):
    return D.split_fixed(samples(spark, d), ["identity"], {"test": 20, "val": 8}, "train").select("sample_id", "split")


@query(
    "split_video",
    f"""{M}, k AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || method || ':' || video), method, video) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT method, video FROM m))
    SELECT sample_id, {TWO} AS split FROM m JOIN k USING (method, video)""",
)
def _(spark, d):
    return D.split_groups(samples(spark, d), ["method", "video"], {"train": 0.7, "test": 0.3}, at_least_one=True).select("sample_id", "split")


@query(
    "split_source_key",
    f"""{M}, v AS (SELECT *, CASE WHEN regexp_full_match(video, '[0-9]+_[0-9]+') THEN 'p:' || split_part(video, '_', 1) ELSE method || ':' || video END AS source FROM m),
    k AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM v))
    SELECT sample_id, source, {TWO} AS split FROM v JOIN k USING (source)""",
)
def _(spark, d):
    rows = samples(spark, d).withColumn("source", K.source_key(F.col("method"), F.col("video"), F.col("domain")))
    return D.split_groups(rows, ["source"], {"train": 0.7, "test": 0.3}, at_least_one=True).select("sample_id", "source", "split")


@query(
    "split_per_source_capped",
    f"""{_split_sql(TWO, "domain", "video")}, x AS (SELECT m.sample_id, m.domain, s.split, row_number() OVER (PARTITION BY m.domain, s.split ORDER BY md5('42:' || sample_id), sample_id) AS r FROM m JOIN s ON m.domain = s.domain AND m.video = s.video)
    SELECT sample_id, domain, split FROM x WHERE r <= 100""",
)
def _(spark, d):
    rows = D.split_groups(samples(spark, d), ["video"], {"train": 0.7, "test": 0.3}, by=["domain"], at_least_one=True)
    return B.cap(rows, "sample_id", ["domain", "split"], 100).select("sample_id", "domain", "split")


@query(
    "split_rows_stratified",
    f"""{M}, k AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM m)
    SELECT sample_id, label, CASE WHEN rank <= floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'train' END AS split FROM k""",
)
def _(spark, d):
    return D.split_rows(samples(spark, d), "sample_id", {"val": 0.1, "train": 0.9}, ["label"]).select("sample_id", "label", "split")


@query(
    "holdout_stratified",
    f"""{M}, k AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || sample_id), sample_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM m)
    SELECT label, CASE WHEN rank <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(sample_id) AS ids FROM k GROUP BY ALL""",
)
def _(spark, d):
    rows = D.split_rows(samples(spark, d), "sample_id", {"train": 0.8, "test": 0.2}, ["label"], seed=7)
    return rows.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("ids"))


@query(
    "split_groups_by_class",
    f"""{M}, f AS (SELECT method, video, row_number() OVER (PARTITION BY method ORDER BY md5('42:' || video), video) AS rank, count(*) OVER (PARTITION BY method) AS n FROM (SELECT DISTINCT method, video FROM m)),
    s AS (SELECT *, CASE WHEN method = 'real' THEN CASE WHEN rank <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'val' END WHEN rank <= floor(n * 0.75 + 1e-9) THEN 'train' ELSE 'val' END AS split FROM f)
    SELECT m.method, split, count(*) AS n, count(DISTINCT m.video) AS videos FROM m JOIN s USING (method, video) GROUP BY ALL""",
)
def _(spark, d):
    m = samples(spark, d)
    fake = D.split_groups(m.filter("label = 1"), ["video"], {"train": 0.75, "val": 0.25}, by=["method"])
    real = D.split_groups(m.filter("label = 0"), ["video"], {"train": 0.8, "val": 0.2}, by=["method"])
    return fake.unionByName(real).groupBy("method", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video").alias("videos"))


@query(
    "split_stats",
    f"""{_split_sql(THREE)} SELECT split, count(*) AS total, count(*) FILTER (label = 0) AS real, count(*) FILTER (label = 1) AS fake, count(DISTINCT identity) AS identities,
    round(count(*) FILTER (label = 1) / greatest(1, count(*) FILTER (label = 0)), 8) AS fake_real_ratio FROM m JOIN s USING (identity) GROUP BY split""",
)
def _(spark, d):
    return rounded(D.split_stats(D.split_groups(samples(spark, d), ["identity"], PARTS3)), "fake_real_ratio")


@query(
    "leakage_audit",
    f"""{_split_sql(THREE)}, x AS (SELECT DISTINCT video, split FROM m JOIN s USING (identity))
    SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM x a JOIN x b ON a.video = b.video AND a.split < b.split GROUP BY ALL""",
)
def _(spark, d):
    return D.leakage(D.split_groups(samples(spark, d), ["identity"], PARTS3), "video")


@query(
    "overlap_by_basename",
    f"""{_split_sql(TWO)}, x AS (SELECT * FROM m JOIN s USING (identity)), tr AS (SELECT DISTINCT video FROM x WHERE split = 'train'), te AS (SELECT DISTINCT label, video FROM x WHERE split = 'test')
    SELECT label, count(*) AS left_keys, count(tr.video) AS shared, round(count(tr.video) / count(*), 8) AS share FROM te LEFT JOIN tr USING (video) GROUP BY label""",
)
def _(spark, d):
    m = two_way(samples(spark, d))
    return rounded(D.overlap(m.filter("split = 'test'"), m.filter("split = 'train'"), "video", "label"), "share")


@query(
    "method_novelty",
    f"{M}, a AS (SELECT DISTINCT method FROM m WHERE domain IN ('cdc', 'ffc') AND method <> 'error'), b AS (SELECT DISTINCT method FROM m WHERE domain = 'fe') SELECT b.method, CASE WHEN a.method IS NULL THEN 'unseen' ELSE 'seen' END AS status FROM b LEFT JOIN a USING (method)",
)
def _(spark, d):
    m = samples(spark, d)
    return D.novelty(m.filter("domain IN ('cdc', 'ffc') AND method <> 'error'"), m.filter("domain = 'fe'"), "method")


@query(
    "leave_one_method_out",
    f"{M}, f AS (SELECT DISTINCT method AS fold FROM m WHERE method <> 'real') SELECT fold, CASE WHEN method = fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(label) AS fakes FROM m, f GROUP BY ALL",
)
def _(spark, d):
    return D.fold_sizes(samples(spark, d), "method", [F.count(F.lit(1)).alias("n"), F.sum("label").alias("fakes")], "real")


# ---- sampling

RANK = "row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || {key}), {key})"


@query("balance_1to1", f"{M}, k AS (SELECT *, {RANK.format(by='label', key='sample_id')} AS r FROM m), n AS (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS n FROM m) SELECT sample_id, label FROM k, n WHERE r <= n.n")
def _(spark, d):
    return B.balance(samples(spark, d), "sample_id").select("sample_id", "label")


@query(
    "method_suite_balanced",
    f"""{M}, fakes AS (SELECT method AS suite, sample_id, label, {RANK.format(by='method', key='sample_id')} AS r FROM m WHERE label = 1),
    s AS (SELECT suite, least(count(*), (SELECT count(*) FROM m WHERE label = 0)) AS n FROM fakes GROUP BY suite),
    reals AS (SELECT suite, sample_id, label, row_number() OVER (PARTITION BY suite ORDER BY md5('42:' || suite || ':' || sample_id), sample_id) AS r FROM m, s WHERE label = 0)
    SELECT suite, sample_id, label FROM (SELECT * FROM fakes UNION ALL SELECT * FROM reals) JOIN s USING (suite) WHERE r <= n""",
)
def _(spark, d):
    return B.suite_balanced(samples(spark, d).select("sample_id", "method", "label"), "sample_id").select("suite", "sample_id", "label")


@query("method_suite_full", f"{M}, s AS (SELECT DISTINCT method AS suite FROM m WHERE label = 1) SELECT suite, label, count(*) AS n FROM m, s WHERE label = 0 OR method = suite GROUP BY ALL")
def _(spark, d):
    return B.suite_full(samples(spark, d).select("sample_id", "method", "label")).groupBy("suite", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "method_subset_balanced",
    f"""{M}, w AS (SELECT * FROM m WHERE method IN ('real', 'click', 'purchase')), k AS (SELECT *, {RANK.format(by='domain, label', key='sample_id')} AS r FROM w),
    n AS (SELECT domain, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS n FROM w GROUP BY domain) SELECT sample_id, domain, method FROM k JOIN n USING (domain) WHERE n = 0 OR r <= n""",
)
def _(spark, d):
    rows = S.filter_methods(samples(spark, d), ["real", "shop"], {"shop": ["click", "purchase"]})
    return B.balance(rows, "sample_id", by=["domain"], keep_single=True).select("sample_id", "domain", "method")


@query("cap_per_class", f"{M}, k AS (SELECT *, {RANK.format(by='label', key='sample_id')} AS r FROM m) SELECT sample_id, label FROM k WHERE r <= 250")
def _(spark, d):
    return B.cap(samples(spark, d), "sample_id", ["label"], 250).select("sample_id", "label")


@query("cap_per_group", f"{G}, k AS (SELECT *, {RANK.format(by='video', key='uid')} AS r FROM g) SELECT uid, video FROM k WHERE r <= 2")
def _(spark, d):
    return B.cap(frames(spark, d), "uid", ["video"], 2).select("uid", "video")


FILL = """s AS (SELECT method, video, count(*) AS size, row_number() OVER (PARTITION BY method ORDER BY md5('42:' || video), video) AS vr FROM {src} GROUP BY method, video),
t AS (SELECT *, least(size, greatest(0, 500 - coalesce(sum(size) OVER (PARTITION BY method ORDER BY vr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM s),
k AS (SELECT x.*, t.take, row_number() OVER (PARTITION BY x.method, x.video ORDER BY md5('42:' || uid), uid) AS r FROM {src} x JOIN t USING (method, video))"""


@query("group_fill_to_n", f"{G}, {FILL.format(src='g')} SELECT uid, method, video FROM k WHERE r <= take")
def _(spark, d):
    return B.fill_from_groups(frames(spark, d), "uid", "video", ["method"], 500).select("uid", "method", "video")


@query(
    "few_groups_fallback",
    f"""{M}, c AS (SELECT method, count(DISTINCT domain) AS groups FROM m GROUP BY method), x AS (SELECT sample_id AS uid, method, CAST(sample_id AS VARCHAR) AS video FROM m JOIN c USING (method) WHERE groups < 8), {FILL.format(src='x')} SELECT uid AS sample_id, method FROM k WHERE r <= take""",
)
def _(spark, d):
    return B.few_groups_fallback(samples(spark, d), "sample_id", "domain", ["method"], 500).select("sample_id", "method")


@query("sample_k_groups", f"{G}, k AS (SELECT method, video, {RANK.format(by='method', key='video')} AS r FROM (SELECT DISTINCT method, video FROM g)) SELECT g.method, g.video, count(*) AS n FROM g JOIN k USING (method, video) WHERE r <= 25 GROUP BY ALL")
def _(spark, d):
    return B.sample_groups(frames(spark, d), "video", ["method"], 25).groupBy("method", "video").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratum_quota_topup",
    f"""{M}, k AS (SELECT *, {RANK.format(by='method', key='sample_id')} AS r FROM m), a AS (SELECT * FROM k WHERE r <= 100),
    b AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS q FROM k WHERE r > 100)
    SELECT sample_id, method FROM a UNION ALL SELECT sample_id, method FROM b WHERE q <= 700 - (SELECT count(*) FROM a)""",
)
def _(spark, d):
    return B.quota_with_topup(samples(spark, d).select("sample_id", "method"), "sample_id", ["method"], 100, 700)


@query(
    "domain_label_matrix",
    f"""{M}, k AS (SELECT *, {RANK.format(by='domain, label', key='sample_id')} AS r FROM m), q(domain, label, quota) AS (VALUES ('cdc', 0, 50), ('cdc', 1, 60), ('ffc', 0, 40), ('ffc', 1, 70), ('oth', 1, 30))
    SELECT sample_id, domain, label FROM k JOIN q USING (domain, label) WHERE r <= quota""",
)
def _(spark, d):
    q = spark.createDataFrame([("cdc", 0, 50), ("cdc", 1, 60), ("ffc", 0, 40), ("ffc", 1, 70), ("oth", 1, 30)], "domain string, label int, quota int")
    return B.quota(samples(spark, d), "sample_id", q, ["domain", "label"]).select("sample_id", "domain", "label")


@query(
    "deficit_fill",
    f"""{M}, a AS (SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS r FROM m WHERE method = 'error'), b AS (SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS r FROM m WHERE method = 'click')
    SELECT sample_id, 'first' AS origin FROM a WHERE r <= 3000 UNION ALL SELECT sample_id, 'second' FROM b WHERE r <= 3000 - (SELECT least(count(*), 3000) FROM a)""",
)
def _(spark, d):
    m = samples(spark, d).select("sample_id", "method")
    return B.deficit_fill(m.filter("method = 'error'"), m.filter("method = 'click'"), "sample_id", 3000).select("sample_id", "origin")


@query(
    "balance_within_method",
    f"""{G}, k AS (SELECT *, {RANK.format(by='method, label', key='uid')} AS r FROM g), n AS (SELECT method, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS n FROM g GROUP BY method) SELECT method, label, count(*) AS n, min(uid) AS first_uid, max(uid) AS last_uid FROM k JOIN n USING (method) WHERE r <= n.n GROUP BY ALL""",
)
def _(spark, d):
    rows = B.balance(frames(spark, d), "uid", by=["method"])
    return rows.groupBy("method", "label").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid"))


@query("one_per_key", f"{M} SELECT method, identity, min(sample_id) AS sample_id FROM m GROUP BY ALL")
def _(spark, d):
    return B.first_per_key(samples(spark, d), ["method", "identity"], ["sample_id"]).select("method", "identity", "sample_id")


@query("mid_row", f"{G}, k AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame, uid) - 1 AS r, count(*) OVER (PARTITION BY video) AS n FROM g) SELECT video, uid FROM k WHERE r = n // 2")
def _(spark, d):
    return B.middle_row(frames(spark, d), ["video"], ["frame", "uid"]).select("video", "uid")


@query("sample_n", f"{M}, k AS (SELECT *, {RANK.format(by='method', key='sample_id')} AS r FROM m) SELECT sample_id, method FROM k WHERE r <= 64")
def _(spark, d):
    return B.cap(samples(spark, d), "sample_id", ["method"], 64).select("sample_id", "method")


@query("class_weights", f"{M}, c AS (SELECT label, count(*) AS n FROM m GROUP BY label) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 8) AS weight, round((sum(n) OVER () - n) / sum(n) OVER (), 8) AS other_share FROM c")
def _(spark, d):
    return rounded(B.class_weights(samples(spark, d)), "weight", "other_share")


@query(
    "weighted_resample",
    f"""{M}, w AS (SELECT label, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS w FROM (SELECT label, count(*) AS n FROM m GROUP BY label)),
    c AS (SELECT label, sum(exp(-w) * pow(w, i) / gamma(i + 1)) OVER (PARTITION BY label ORDER BY i) AS c FROM w, range(0, 120) t(i)),
    u AS (SELECT label, sample_id, CAST('0x' || substr(md5('42:' || sample_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM m),
    k AS (SELECT u.label, sample_id, count(*) AS k FROM u JOIN c ON u.label = c.label AND u >= c GROUP BY ALL)
    SELECT label, CAST(sum(k) AS BIGINT) AS n, count(*) AS rows FROM k GROUP BY label""",
)
def _(spark, d):
    m = samples(spark, d).select("sample_id", "method", "label")
    weights = B.class_weights(m).select("label", "weight")
    rows = m.join(F.broadcast(weights), "label")  # one row a class
    return B.weighted_resample(rows, "sample_id", F.col("weight")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("rows"))


@query("oversample_by_weight", f"{M} SELECT method, count(*) * CASE method WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS n FROM m GROUP BY method")
def _(spark, d):
    w = spark.createDataFrame([("error", 3), ("signup", 2)], "method string, weight int")
    return B.oversample(samples(spark, d), w, "method").groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("batch_balance_audit", f"{M}, k AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS r FROM m) SELECT CAST(floor((r - 1) / 128) AS BIGINT) AS batch, count(*) AS n, sum(label) AS fakes, round(avg(label), 8) AS share FROM k GROUP BY ALL")
def _(spark, d):
    return rounded(B.batch_balance(samples(spark, d), "sample_id", 128), "share")


@query(
    "frame_plan",
    """WITH v AS (SELECT l_orderkey AS video, count(*) AS total FROM lineitem GROUP BY ALL), e AS (SELECT DISTINCT video, 'even' AS plan, CAST(floor((total - 1) * i / 3.0) AS BIGINT) AS frame FROM v, range(0, 4) t(i))
    SELECT * FROM e UNION ALL SELECT video, 'step', CAST(i AS BIGINT) FROM v, range(0, 64) t(i) WHERE i % 2 = 0 AND i < total
    UNION ALL SELECT video, 'set', CAST(i AS BIGINT) FROM v, (VALUES (1), (3), (5)) t(i) WHERE i < total""",
)
def _(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("video")).agg(F.count(F.lit(1)).alias("total"))
    return B.frame_plan(v, "total", 4, 2, [1, 3, 5]).select("video", "plan", "frame")


# ---- metrics


@query("class_counts", f"{M} SELECT domain, method, label, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d):
    return samples(spark, d).groupBy("domain", "method", "label").agg(F.count(F.lit(1)).alias("n"))


@query("pairing_stats", f"{M}, e AS (SELECT identity, count(*) FILTER (label = 0) AS r, count(*) FILTER (label = 1) AS f FROM m GROUP BY identity) SELECT count(*) AS keys, count(*) FILTER (r > 0 AND f > 0) AS paired_keys, sum(CASE WHEN r > 0 AND f > 0 THEN f ELSE 0 END) AS fakes_paired, sum(CASE WHEN r > 0 AND f > 0 THEN 0 ELSE f END) AS fakes_unpaired FROM e")
def _(spark, d):
    return A.pairing_stats(samples(spark, d))


@query("confusion", f"{M}, c AS (SELECT domain, {CELLS} FROM m GROUP BY domain) SELECT *, round(tn / nullif(tn + fp, 0), 8) AS tn_rate, round(fp / nullif(tn + fp, 0), 8) AS fp_rate, round(fn / nullif(fn + tp, 0), 8) AS fn_rate, round(tp / nullif(fn + tp, 0), 8) AS tp_rate FROM c")
def _(spark, d):
    return rounded(A.confusion(samples(spark, d), ["domain"]), "tn_rate", "fp_rate", "fn_rate", "tp_rate")


@query("binary_metrics", f"{M}, c AS (SELECT method, {CELLS} FROM m GROUP BY method) SELECT method, n, tn, fp, fn, tp, {RATIOS} FROM c")
def _(spark, d):
    return A.binary_metrics(samples(spark, d), ["method"])


CUM = """u AS (SELECT {by}prob AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM m GROUP BY ALL),
w AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY {part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(neg) OVER (PARTITION BY {part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
sum(pos) OVER (PARTITION BY {part}) AS ap, sum(neg) OVER (PARTITION BY {part}) AS an FROM u)"""
CUM0, CUMD = CUM.format(by="", part="1"), CUM.format(by="domain, ", part="domain")


@query("roc_auc", f"{M}, {CUM0} SELECT round(sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)), 8) AS auc FROM w")
def _(spark, d):
    return rounded(A.roc_auc(samples(spark, d), "prob"), "auc")


@query("roc_auc_by_domain", f"{M}, {CUMD} SELECT domain, round(sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)), 8) AS auc FROM w GROUP BY domain")
def _(spark, d):
    return rounded(A.roc_auc(samples(spark, d), "prob", ["domain"]), "auc")


@query("average_precision", f"{M}, {CUMD} SELECT domain, round(sum(pos / ap * (ap - pb) / (ap - pb + an - nb)), 8) AS average_precision FROM w GROUP BY domain")
def _(spark, d):
    return rounded(A.average_precision(samples(spark, d), "prob", ["domain"]), "average_precision")


@query("brier", f"{M} SELECT domain, round(avg((prob - label) * (prob - label)), 8) AS brier FROM m GROUP BY domain")
def _(spark, d):
    return rounded(A.brier(samples(spark, d), "prob", ["domain"]), "brier")


@query("rates", f"{M} SELECT domain, round(avg(1 - pred) FILTER (label = 0), 8) AS real_acc, round(avg(pred) FILTER (label = 1), 8) AS fake_det, round(avg(pred) FILTER (label = 0), 8) AS fpr, round(avg(1 - pred) FILTER (label = 0), 8) AS specificity FROM m GROUP BY domain")
def _(spark, d):
    return rounded(A.rates(samples(spark, d), ["domain"]), "real_acc", "fake_det", "fpr", "specificity")


SWEEP = f"""{M}, t AS (SELECT i, i / 20.0 AS threshold FROM range(1, 20) x(i)), c AS (SELECT i, CAST(i AS DOUBLE) / 20 AS threshold, count(*) FILTER (label = 1 AND prob >= CAST(i AS DOUBLE) / 20) AS tp, count(*) FILTER (label = 0 AND prob >= CAST(i AS DOUBLE) / 20) AS fp, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM m, t GROUP BY i),
e AS (SELECT i, threshold, (q - fp) / q AS real_acc, tp / p AS fake_det, ((q - fp) / q + tp / p) / 2 AS balanced_acc, CASE WHEN tp + fp + p = 0 THEN 0 ELSE 2 * tp / (p + tp + fp) END AS f1 FROM c)"""


@query("threshold_sweep", f"{SWEEP} SELECT threshold, round(real_acc, 8) AS real_acc, round(fake_det, 8) AS fake_det, round(balanced_acc, 8) AS balanced_acc, round(f1, 8) AS f1, row_number() OVER (ORDER BY balanced_acc DESC, i) = 1 AS best FROM e")
def _(spark, d):
    return rounded(A.threshold_sweep(samples(spark, d), "prob"), "real_acc", "fake_det", "balanced_acc", "f1")


@query("youden_threshold", f"{M}, {CUMD}, j AS (SELECT *, (ap - pb) * an - (an - nb) * ap AS gap FROM w) SELECT domain, score AS threshold, round(gap / (ap * an), 8) AS j FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY gap DESC, score DESC) AS r FROM j) WHERE r = 1")
def _(spark, d):
    return rounded(A.youden(samples(spark, d), "prob", ["domain"]), "j")


@query("roc_points", f"{M}, {CUM0} SELECT score AS threshold, round((an - nb) / an, 8) AS fpr, round((ap - pb) / ap, 8) AS tpr FROM w")
def _(spark, d):
    return rounded(A.roc_points(samples(spark, d), "prob"), "fpr", "tpr")


@query("pr_points", f"{M}, {CUM0} SELECT score AS threshold, round((ap - pb) / (ap - pb + an - nb), 8) AS precision, round((ap - pb) / ap, 8) AS recall FROM w")
def _(spark, d):
    return rounded(A.pr_points(samples(spark, d), "prob"), "precision", "recall")


@query("calibration", f"{M} SELECT CAST(greatest(ceil(prob * 10) - 1, 0) AS BIGINT) AS bin, count(*) AS n, round(avg(prob), 8) AS mean_score, round(avg(label), 8) AS fraction FROM m GROUP BY ALL")
def _(spark, d):
    return rounded(A.calibration(samples(spark, d), "prob"), "mean_score", "fraction")


@query("score_histogram", f"{M} , c AS (SELECT label, CAST(least(floor(prob * 25), 24) AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY ALL) SELECT label, bin, n, round(n * 25 / sum(n) OVER (PARTITION BY label), 8) AS density FROM c")
def _(spark, d):
    return rounded(A.score_histogram(samples(spark, d), "prob"), "density")


@query("macro_detection", f"{M} SELECT count(*) AS methods, round(avg(rate), 8) AS macro_detection FROM (SELECT method, avg(pred) AS rate FROM m WHERE label = 1 GROUP BY method)")
def _(spark, d):
    return rounded(A.macro_detection(samples(spark, d)), "macro_detection")


@query("detection_summary", f"{M} SELECT method, count(*) AS n, round(avg(CASE WHEN prob > 0.5 THEN 1.0 ELSE 0.0 END), 8) AS rate, round(avg(prob), 8) AS mean_p, round(median(prob), 8) AS median_p FROM m GROUP BY method")
def _(spark, d):
    return rounded(A.detection_summary(samples(spark, d), "prob", ["method"]), "rate", "mean_p", "median_p")


@query("detection_by_quality", f"{M} SELECT CASE WHEN user_id % 2 = 0 THEN 'HQ' ELSE 'LQ' END AS quality, count(*) AS n, round(avg(CASE WHEN prob > 0.5 THEN 1.0 ELSE 0.0 END), 8) AS rate, round(avg(prob), 8) AS mean_p, round(median(prob), 8) AS median_p FROM m WHERE label = 1 GROUP BY ALL")
def _(spark, d):
    rows = samples(spark, d).filter("label = 1")
    name = F.concat(F.when(F.split("video", "_")[0].cast("long") % 2 == 0, "hq").otherwise("lq"), "video")
    return rounded(A.detection_summary(rows.withColumn("quality", K.classify_source(name)), "prob", ["quality"]), "rate", "mean_p", "median_p")


@query("real_by_source", f"{M} SELECT CASE WHEN grouping(domain) = 1 THEN NULL ELSE domain END AS domain, CASE WHEN grouping(user_id % 7) = 1 THEN NULL ELSE user_id % 7 END AS source, count(*) AS n, round(avg(1 - pred), 8) AS real_acc FROM m WHERE label = 0 GROUP BY GROUPING SETS ((), (domain), (user_id % 7), (domain, user_id % 7))")
def _(spark, d):
    rows = samples(spark, d).filter("label = 0").withColumn("source", F.split("video", "_")[0].cast("long") % 7)
    out = rows.groupingSets([[], [F.col("domain")], [F.col("source")], [F.col("domain"), F.col("source")]], F.col("domain"), F.col("source"))
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.col("pred")).alias("real_acc")), "real_acc")


@query("fake_only_report", f"{M}, c AS (SELECT method, {CELLS} FROM m WHERE label = 1 GROUP BY method) SELECT method, n, tp, fn, round(tp / n, 8) AS fake_det FROM c")
def _(spark, d):
    return rounded(A.binary_metrics(samples(spark, d).filter("label = 1"), ["method"]).select("method", "n", "tp", "fn", "fake_det"), "fake_det")


@query("real_only_report", f"{M}, c AS (SELECT domain, {CELLS} FROM m WHERE label = 0 GROUP BY domain) SELECT domain, n, tn, fp, round(tn / n, 8) AS real_acc FROM c")
def _(spark, d):
    return rounded(A.binary_metrics(samples(spark, d).filter("label = 0"), ["domain"]).select("domain", "n", "tn", "fp", "real_acc"), "real_acc")


@query("paired_metrics", f"{M}, b AS (SELECT identity FROM m GROUP BY identity HAVING min(label) <> max(label)), c AS (SELECT {CELLS} FROM m WHERE identity IN (SELECT identity FROM b)) SELECT n, tn, fp, fn, tp, {RATIOS} FROM c")
def _(spark, d):
    return A.binary_metrics(A.paired(samples(spark, d)))


@query("error_rates", f"{M}, c AS (SELECT domain, method, {CELLS} FROM m GROUP BY ALL) SELECT domain, method, n, fn + fp AS errors, fn, fp, round((fn + fp) / n, 8) AS error_rate, round(fn / nullif(fn + tp, 0), 8) AS miss_rate FROM c")
def _(spark, d):
    return rounded(A.error_rates(samples(spark, d), ["domain", "method"]), "error_rate", "miss_rate")


@query(
    "classification_report",
    f"""{M}, c AS (SELECT {CELLS} FROM m), e AS (SELECT '0' AS row, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM c UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c),
    a AS (SELECT * FROM e UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM e UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM e)
    SELECT row, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, CAST(support AS BIGINT) AS support FROM a""",
)
def _(spark, d):
    return rounded(A.classification_report(samples(spark, d)), "precision", "recall", "f1")


VIEWS = {"orig": (1.0, 0.0, 0.40), "flip": (0.98, 0.01, 0.30), "bright": (0.9, 0.05, 0.15), "dark": (0.95, 0.0, 0.15)}


@query("tta_average", f"{M} SELECT sample_id, round(0.40 * prob + 0.30 * (0.98 * prob + 0.01) + 0.15 * (0.9 * prob + 0.05) + 0.15 * (0.95 * prob), 7) AS prob FROM m")
def _(spark, d):
    views = F.array(*(F.struct(F.lit(k).alias("view"), (F.col("prob") * a + b).alias("p")) for k, (a, b, _) in VIEWS.items()))
    long = samples(spark, d).select("sample_id", F.inline(views))
    weights = spark.createDataFrame([(k, w) for k, (_, _, w) in VIEWS.items()], "view string, weight double")
    return rounded(C.ensemble(long, weights, "sample_id", "view", "p"), "prob", digits=7)


@query(
    "methods_summary",
    f"""{_split_sql(THREE)}, r AS (SELECT count(*) FILTER (split = 'test') AS test_reals, count(*) AS reals FROM m JOIN s USING (identity) WHERE label = 0),
    f AS (SELECT method, count(*) FILTER (split = 'test') AS test_split_fakes, count(*) AS benchmark_fakes FROM m JOIN s USING (identity) WHERE label = 1 GROUP BY method)
    SELECT method, test_split_fakes, 2 * least(test_split_fakes, test_reals) AS test_split_balanced_total, benchmark_fakes, 2 * least(benchmark_fakes, reals) AS benchmark_balanced_total, benchmark_fakes + reals AS benchmark_full_total FROM f, r""",
)
def _(spark, d):
    rows = D.split_groups(samples(spark, d).select("identity", "method", "label"), ["identity"], PARTS3)
    return B.methods_summary(rows, F.col("split") == "test")


@query("decode_failures", "SELECT role AS error, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT conv_id)), 1, 10), ',') AS samples FROM conversations WHERE length(text) < 40 GROUP BY role")
def _(spark, d):
    rows = table(spark, d, "conversations").filter(F.length("text") < 40).select(F.col("role").alias("error"), "conv_id")
    counts = rows.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    first = C.top_per_group(rows.distinct(), ["error"], ["conv_id"], 10).groupBy("error").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("samples"))
    return counts.join(first, "error")


@query("duplicate_keys", f"{M} SELECT method, video, count(*) AS n FROM m GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return C.duplicate_keys(samples(spark, d), ["method", "video"])


@query("distinct_identities", f"{M} SELECT domain, count(DISTINCT identity) AS identities FROM m GROUP BY domain")
def _(spark, d):
    return samples(spark, d).groupBy("domain").agg(F.countDistinct("identity").alias("identities"))


@query("stat_by_correctness", f"{M} SELECT label <> pred AS is_error, count(*) AS n, round(avg(prob2), 8) AS mean, round(stddev_pop(prob2), 8) AS std FROM m GROUP BY ALL")
def _(spark, d):
    return rounded(A.by_correctness(samples(spark, d), "prob2"), "mean", "std")


@query(
    "loss_metrics",
    f"""{M}, x AS (SELECT *, greatest(1e-7, least(1 - 1e-7, prob)) AS p FROM m), y AS (SELECT *, CASE WHEN label = 1 THEN p ELSE 1 - p END AS o FROM x)
    SELECT method, round(avg(-ln(o)), 7) AS nll, round(avg(0.9 * -ln(o) - 0.1 * (ln(p) + ln(1 - p)) / 2), 7) AS smoothed, round(avg((1 - o) * (1 - o) * -ln(o)), 7) AS focal FROM y GROUP BY method""",
)
def _(spark, d):
    own = K.losses(F.col("label"), F.col("prob"))
    return rounded(samples(spark, d).groupBy("method").agg(*(F.avg(c).alias(k) for k, c in own.items())), *own, digits=7)


# ---- joins, filters, keys, sets

HELD = f"{_split_sql(TWO)}, h AS (SELECT identity FROM s WHERE split = 'test')"


def held_out(m: DataFrame) -> DataFrame:
    return two_way(m).filter("split = 'test'").select("identity").distinct()


@query("join_predictions_metadata", f"{M} SELECT m.sample_id, m.prob, o.o_orderpriority AS priority FROM m LEFT JOIN orders o ON m.sample_id = o.o_orderkey AND m.label = 1")
def _(spark, d):
    m, o = samples(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit(1).alias("label"), F.col("o_orderpriority").alias("priority"))
    return m.select("sample_id", "label", "prob").join(o, ["sample_id", "label"], "left").drop("label")


@query("assign_domain", f"{M}, re AS (SELECT DISTINCT identity FROM m WHERE label = 0) SELECT sample_id, CASE WHEN label = 1 AND re.identity IS NOT NULL THEN 'paired' ELSE domain END AS pair_domain FROM m LEFT JOIN re USING (identity)")
def _(spark, d):
    return C.assign_domain(samples(spark, d), "identity", F.lit("paired"), F.col("domain")).select("sample_id", "pair_domain")


@query("matched_frame", f"{G}, a AS (SELECT DISTINCT identity, frame FROM g WHERE label = 1), b AS (SELECT DISTINCT identity, frame FROM g WHERE label = 0) SELECT identity, coalesce(min(b.frame), min(a.frame)) AS frame, min(b.frame) IS NOT NULL AS matched FROM a LEFT JOIN b USING (identity, frame) GROUP BY identity")
def _(spark, d):
    g = frames(spark, d)
    return C.matched_frame(g.filter("label = 1"), g.filter("label = 0"), "identity", "frame")


@query("exclude_paths", f"{P} SELECT page_id FROM p WHERE path NOT IN (SELECT path FROM p WHERE page_id % 3 = 0)")
def _(spark, d):
    p = pages(spark, d)
    return C.exclude(p, [p.filter("page_id % 3 = 0").select("path")], "path").select("page_id")


@query("exclude_identities", f"{HELD} SELECT sample_id FROM m WHERE identity NOT IN (SELECT identity FROM h UNION SELECT identity FROM m WHERE method = 'error')")
def _(spark, d):
    m = samples(spark, d)
    return C.exclude(m, [held_out(m), m.filter("method = 'error'")], "identity").select("sample_id")


@query("exclude_component_overlap", f"{M}, h AS (SELECT DISTINCT CAST(event_id % 11 AS VARCHAR) AS c FROM m WHERE method = 'signup' AND event_id % 11 < 4) SELECT sample_id FROM m WHERE split_part(video, '_', 1) NOT IN (SELECT c FROM h) AND split_part(video, '_', 2) NOT IN (SELECT c FROM h)")
def _(spark, d):
    m = samples(spark, d)
    ids = m.filter("method = 'signup' AND sample_id % 11 < 4").select((F.col("sample_id") % 11).cast("string").alias("component"))
    return C.exclude_components(m, ids, "video").select("sample_id")


@query("label_exists", "SELECT doc_id, CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INTEGER) AS has_label FROM documents")
def _(spark, d):
    return C.label_exists(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", F.col("toxic") == 1).select("doc_id", "has_label")


@query("inner_lookup", "SELECT doc_id, quality, source FROM labels JOIN documents USING (doc_id)")
def _(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "quality", "source")


@query("compare_models", f"{M}, a AS (SELECT method, domain, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS vit, avg(CASE WHEN pred2 = label THEN 1.0 ELSE 0.0 END) AS cnn FROM m GROUP BY ALL) SELECT method, domain, round(vit, 8) AS vit, round(cnn, 8) AS cnn, round(vit - cnn, 8) AS delta FROM a")
def _(spark, d):
    m = samples(spark, d)
    long = m.select("method", "domain", "label", F.inline(F.array(F.struct(F.lit("vit").alias("model"), F.col("pred").alias("p")), F.struct(F.lit("cnn").alias("model"), F.col("pred2").alias("p")))))
    reports = long.groupBy("model", "method", "domain").agg(F.avg((F.col("p") == F.col("label")).cast("double")).alias("accuracy"))
    return rounded(C.compare_models(reports, ["method", "domain"], ["vit", "cnn"], "accuracy"), "vit", "cnn", "delta")


@query("model_agreement", f"{M} SELECT domain, count(*) AS n, round(avg(CASE WHEN pred = pred2 THEN 1.0 ELSE 0.0 END), 8) AS agree FROM m GROUP BY domain")
def _(spark, d):
    return rounded(C.agreement(samples(spark, d), "pred", "pred2", ["domain"]), "agree")


@query("ensemble", f"{M} SELECT sample_id, round((0.6 * prob + 0.4 * prob2) / (0.6 + 0.4), 8) AS prob FROM m")
def _(spark, d):
    long = samples(spark, d).select("sample_id", F.inline(F.array(F.struct(F.lit("vit").alias("model"), F.col("prob")), F.struct(F.lit("cnn").alias("model"), F.col("prob2").alias("prob")))))
    return rounded(C.ensemble(long, spark.createDataFrame([("vit", 0.6), ("cnn", 0.4)], "model string, weight double"), "sample_id"), "prob")


@query("paired_only", f"{M} SELECT sample_id FROM m WHERE identity IN (SELECT identity FROM m GROUP BY identity HAVING min(label) <> max(label))")
def _(spark, d):
    return A.paired(samples(spark, d)).select("sample_id")


@query("alignment_audit", "SELECT count(*) FILTER (e.vec_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both, count(*) FILTER (d.doc_id IS NULL) AS only_features, count(*) FILTER (e.vec_id IS NULL) AS only_manifest, count(*) FILTER (e.label % 2 <> d.quality) AS label_mismatch FROM embeddings e FULL JOIN labels d ON e.vec_id = d.doc_id")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") % 2).alias("label"))
    return C.alignment_audit(e, table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("existing_only", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT page_id FROM pages)")
def _(spark, d):
    return C.existing_only(table(spark, d, "documents").select("doc_id"), table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")[0]


@query("filter_unreadable", "SELECT count(p.page_id) AS kept, count(*) - count(p.page_id) AS dropped FROM documents LEFT JOIN pages p ON doc_id = page_id")
def _(spark, d):
    return C.existing_only(table(spark, d, "documents").select("doc_id"), table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")[1]


@query("filter_extension", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), '#top$')")
def _(spark, d):
    return S.filter_extension(pages(spark, d), "url", "#top$").select("page_id")


@query("filter_method_alias", f"{M} SELECT sample_id, method FROM m WHERE method IN ('click', 'purchase', 'error')")
def _(spark, d):
    return S.filter_methods(samples(spark, d), ["shop", "error"], {"shop": ["click", "purchase"]}).select("sample_id", "method")


@query("filter_category_path", f"{P} SELECT page_id FROM p WHERE contains(path, '/fr/') OR contains(path, '/de/')")
def _(spark, d):
    return pages(spark, d).filter(F.col("path").contains("/fr/") | F.col("path").contains("/de/")).select("page_id")


@query("filter_allow_skip", f"{M} SELECT sample_id FROM m WHERE domain IN ('cdc', 'ffc', 'fe') AND domain NOT IN ('fe')")
def _(spark, d):
    return S.filter_allow_skip(samples(spark, d), "domain", ["cdc", "ffc", "fe"], ["fe"]).select("sample_id")


@query("label_sanity", "SELECT d.lang, count(*) AS n, count(*) FILTER (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 2 <> quality) AS contradictions FROM documents d JOIN labels USING (doc_id) GROUP BY d.lang")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return C.label_sanity(rows, F.col("quality"), F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2, ["lang"])


@query("hard_examples", f"{M} SELECT sample_id FROM m WHERE greatest(prob, 1 - prob) < 0.7 OR pred <> label")
def _(spark, d):
    return S.hard_examples(samples(spark, d), "prob", "label", "pred").select("sample_id")


@query("weak_method_subset", f"{M}, c AS (SELECT {CELLS} FROM m WHERE method IN ('real', 'signup', 'error')) SELECT n, tn, fp, fn, tp, {RATIOS} FROM c")
def _(spark, d):
    return A.binary_metrics(samples(spark, d).filter(F.col("method").isin("real", "signup", "error")))


@query("keys_and_paths", f"{P} SELECT page_id, split_part(path, '/', 1) AS host, regexp_extract(path, '/(en|fr|de|es)/', 1) AS side, regexp_replace(name, '[.][^.]*$', '') AS stem, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') AS flat_start FROM p")
def _(spark, d):
    return pages(spark, d).select("page_id", F.split("path", "/")[0].alias("host"), F.regexp_extract("path", "/(en|fr|de|es)/", 1).alias("side"), K.video_stem(F.col("path")).alias("stem"), K.path_safe(F.col("path")).alias("flat_start"))


@query("identity_keys", f"{M} SELECT sample_id, split_part(video, '_', 1) AS pair_first, CASE WHEN regexp_full_match(video, '[0-9]+_[0-9]+') THEN 'pair' ELSE 'other' END AS kind, list_extract(regexp_extract_all(video, '[0-9]+'), -1) AS last_id, domain || ':' || video AS full_key FROM m")
def _(spark, d):
    v = F.col("video")
    return samples(spark, d).select("sample_id", K.identity_pair_first(v).alias("pair_first"), K.classify_source(v).alias("kind"), K.identity_last_match(v, r"\d+").alias("last_id"), K.namespaced(F.col("domain"), v).alias("full_key"))


@query("path_relayout", f"{M} SELECT sample_id, CASE WHEN method = 'real' THEN 'real/' || video ELSE method || '/fake/' || video END AS new_path, method || '/' || video AS tail FROM m")
def _(spark, d):
    path = F.concat_ws("/", F.lit("root"), F.col("domain"), F.lit("data"), F.col("method"), F.col("video"))
    return samples(spark, d).select("sample_id", K.path_relayout(F.col("method"), path).alias("new_path"), K.path_after(path, "data").alias("tail"))


@query("method_family", f"{M} SELECT CASE method WHEN 'real' THEN 'organic' WHEN 'click' THEN 'commerce' WHEN 'purchase' THEN 'commerce' WHEN 'signup' THEN 'account' WHEN 'error' THEN 'fault' ELSE 'other' END AS family, count(*) AS n, round(avg(prob), 8) AS mean_p FROM m GROUP BY ALL")
def _(spark, d):
    rows = samples(spark, d).groupBy(K.method_family(F.col("method")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_p"))
    return rounded(rows, "mean_p")


@query("error_type", f"{M} SELECT CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 0 AND pred = 0 THEN 'TN' WHEN label = 1 THEN 'FN' ELSE 'FP' END AS error_type, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d):
    return samples(spark, d).groupBy(K.error_type(F.col("label"), F.col("pred")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


@query("decide", f"{M} SELECT sum(CASE WHEN prob >= 0.3 THEN 1 ELSE 0 END) AS inclusive, sum(CASE WHEN prob > 0.3 THEN 1 ELSE 0 END) AS exclusive FROM m")
def _(spark, d):
    return samples(spark, d).agg(F.sum(K.decide(F.col("prob"), 0.3)).alias("inclusive"), F.sum(K.decide(F.col("prob"), 0.3, False)).alias("exclusive"))


@query("crop_box", "SELECT p_partkey, CAST((h - s) / 2 AS INTEGER) AS top, CAST((w - s) / 2 AS INTEGER) AS left, s AS min_dim FROM (SELECT p_partkey, h, w, least(h, w) AS s FROM (SELECT p_partkey, CAST(2 * (p_partkey % 97) + 2 AS INTEGER) AS w, CAST(2 * (p_partkey % 53) + 2 AS INTEGER) AS h FROM part))")
def _(spark, d):
    size = lambda k: (F.col("p_partkey") % k * 2 + 2).cast("int")
    return table(spark, d, "part").select("p_partkey", *K.crop_box(size(97), size(53)))


@query("merge_sources", f"{M} SELECT sample_id, method, coalesce(identity, 'unknown') AS identity, label FROM (SELECT sample_id, method, identity, label FROM m UNION ALL SELECT doc_id + 1000000, 'text', NULL, toxic FROM labels)")
def _(spark, d):
    other = table(spark, d, "labels").select((F.col("doc_id") + 1000000).alias("sample_id"), F.lit("text").alias("method"), F.col("toxic").cast("int").alias("label"))
    return C.merge_sources(samples(spark, d).select("sample_id", "method", "identity", "label"), other, {"identity": "unknown"})


@query("union_exclusions", f"{M} SELECT identity FROM m WHERE method = 'error' UNION SELECT identity FROM m WHERE method = 'signup'")
def _(spark, d):
    m = samples(spark, d)
    return m.filter("method = 'error'").select("identity").union(m.filter("method = 'signup'").select("identity")).distinct()


# ---- windows, ranking


@query("best_epoch", f"{R}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY acc DESC, epoch) AS q FROM r) SELECT run, epoch AS best_epoch, acc AS best_value FROM k WHERE q = 1")
def _(spark, d):
    return H.best_epoch(runs(spark, d))


@query("early_stop_epoch", f"{R}, b AS (SELECT *, max(acc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r), l AS (SELECT *, max(CASE WHEN best IS NULL OR acc > best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last_good FROM b) SELECT run, min(CASE WHEN epoch - last_good >= 3 THEN epoch END) AS stop_epoch FROM l GROUP BY run")
def _(spark, d):
    return H.early_stop(runs(spark, d), 3)


@query("latest_run", "WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS q FROM orders) SELECT o_custkey, o_orderkey FROM k WHERE q = 1")
def _(spark, d):
    return H.latest_run(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey")


@query("global_rank", f"{M} SELECT sample_id, row_number() OVER (ORDER BY md5('1:' || sample_id), sample_id) AS rank FROM m")
def _(spark, d):
    return hash_ranked(samples(spark, d).select("sample_id"), 1, ["sample_id"])


@query("top_methods", f"{M} SELECT method, count(*) AS n FROM m GROUP BY method ORDER BY n DESC, method LIMIT 12")
def _(spark, d):
    return C.top(samples(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), "method"], 12)


@query("worst_methods", f"{M} SELECT method, round(avg(1 - pred), 8) AS fn_rate FROM m WHERE label = 1 GROUP BY method ORDER BY avg(1 - pred) DESC, method LIMIT 4")
def _(spark, d):
    each = samples(spark, d).filter("label = 1").groupBy("method").agg(F.avg(1 - F.col("pred")).alias("fn_rate"))
    return rounded(C.top(each, [F.desc("fn_rate"), "method"], 4), "fn_rate")


@query("best_methods", f"{M} SELECT method, round(avg(1 - pred), 8) AS fn_rate FROM m WHERE label = 1 GROUP BY method ORDER BY avg(1 - pred), method LIMIT 4")
def _(spark, d):
    each = samples(spark, d).filter("label = 1").groupBy("method").agg(F.avg(1 - F.col("pred")).alias("fn_rate"))
    return rounded(C.top(each, ["fn_rate", "method"], 4), "fn_rate")


@query("uncertain_errors", f"{M} SELECT sample_id, label, pred FROM m WHERE label <> pred ORDER BY abs(prob - 0.5), sample_id LIMIT 25")
def _(spark, d):
    return C.top(samples(spark, d).filter("label <> pred"), [F.abs(F.col("prob") - 0.5), "sample_id"], 25).select("sample_id", "label", "pred")


@query("missed_by_method", f"{M}, k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY prob, sample_id) AS q FROM m WHERE label = 1 AND pred = 0) SELECT method, sample_id FROM k WHERE q <= 60")
def _(spark, d):
    return C.top_per_group(samples(spark, d).filter("label = 1 AND pred = 0"), ["method"], ["prob", "sample_id"], 60).select("method", "sample_id")


@query("false_positive_examples", f"{M} SELECT sample_id FROM m WHERE label = 0 AND pred = 1 ORDER BY prob DESC, sample_id LIMIT 10")
def _(spark, d):
    return C.top(samples(spark, d).filter("label = 0 AND pred = 1"), [F.desc("prob"), "sample_id"], 10).select("sample_id")


# ---- sinks, vectors, text


@query("predictions_wide", f"{M} SELECT sample_id, prob AS vit_prob, pred AS vit_pred, prob2 AS cnn_prob, pred2 AS cnn_pred FROM m")
def _(spark, d):
    both = F.array(F.struct(F.lit("vit").alias("model"), "prob", "pred"), F.struct(F.lit("cnn").alias("model"), F.col("prob2").alias("prob"), F.col("pred2").alias("pred")))
    return sinks.predictions_wide(samples(spark, d).select("sample_id", F.inline(both)), "sample_id", ["vit", "cnn"])


@query("submission_map", f"{M} SELECT video, CASE WHEN max(pred) = 1 THEN 'fake' ELSE 'real' END AS answer FROM m GROUP BY video")
def _(spark, d):
    return sinks.submission(samples(spark, d).groupBy("video").agg(F.max("pred").alias("pred")), "video")


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha256, count(*) AS copies FROM documents GROUP BY sha256(text)")
def _(spark, d):
    return C.exact_dedup(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "content_sha256", "copies")


@query("near_dedup_vectors")
def _(spark, d):
    return V.near_copies(table(spark, d, "embeddings"), "vec_id", "embedding", NEAR_COSINE)


@query("near_dedup_cells")
def _(spark, d):
    return near_copies_by_cells(table(spark, d, "embeddings"), "vec_id", "embedding", NEAR_COSINE)


NEAR_COSINE = 0.45


def _probe(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).cast("int").alias("label"))
    rows = D.split_rows(rows, "vec_id", {"train": 0.7, "test": 0.3}, ["label"])
    return V.probe_scores(V.fit_probe(rows.filter("split = 'train'"), "embedding"), rows, "embedding")


@query("linear_probe")
def _(spark, d):
    return rounded(_probe(spark, d).select("vec_id", "split", "label", "prob", "pred"), "prob", digits=5)


@query("probe_metrics")
def _(spark, d):
    return rounded(A.binary_metrics(_probe(spark, d), ["split"]), "accuracy", "precision", "recall", "f1", "real_acc", "fake_det")


@query(
    "temperature_scale",
    f"""{M}, p AS (SELECT label, greatest(1e-6, least(1 - 1e-6, prob)) AS p FROM m), c AS (SELECT CAST(round(ln(p / (1 - p)) * (2000 / 28.0)) AS INTEGER) AS cell, label, count(*) AS n FROM p GROUP BY ALL),
    e AS (SELECT CAST(t / 20.0 AS DOUBLE) AS temperature, sum(n * ln(1 + exp(-cell * CAST(28.0 / 2000 AS DOUBLE) / (t / 20.0) * CASE label WHEN 1 THEN 1 ELSE -1 END))) / sum(n) AS nll FROM c, range(4, 101) r(t) GROUP BY t)
    SELECT temperature, round(nll, 6) AS nll FROM e ORDER BY e.nll, temperature LIMIT 1""",
)
def _(spark, d):
    return rounded(V.temperature(samples(spark, d), "prob"), "nll", digits=6)


@query("domain_gap", f"{M}, x AS (SELECT domain, 'prob' AS value, prob AS x FROM m UNION ALL SELECT domain, 'prob2', prob2 FROM m) SELECT domain, value, count(*) AS n, round(avg(x), 8) AS mean, round(quantile_cont(x, 0.1), 8) AS p10, round(quantile_cont(x, 0.5), 8) AS p50, round(quantile_cont(x, 0.9), 8) AS p90 FROM x GROUP BY ALL")
def _(spark, d):
    return rounded(domain_gap(samples(spark, d), "domain", ["prob", "prob2"]), "mean", "p10", "p50", "p90")


@query("score_batches", "SELECT vec_id, round(1 / (1 + exp(-list_sum(CAST(embedding AS DOUBLE[])))), 6) AS prob FROM embeddings")
def _(spark, d):
    import numpy as np

    return rounded(V.score_batches(table(spark, d, "embeddings"), lambda x: 1 / (1 + np.exp(-x.sum(1))), "vec_id", "embedding"), "prob", digits=6)


def load_linear(path: str):
    """Weights from a text file of numbers; scores are logistic."""
    import numpy as np
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place) as file:
        weights = np.array(file.read().split(), dtype=float)
    return lambda x: 1 / (1 + np.exp(-(x @ weights)))


def _linear_model(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame) -> X.Model:
    """A model whose weights are the mean vector of ``rows``, in a file of the shared folder."""
    folder = I.scratch(spark, f"model-{name}")
    means = rows.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("w"))
    means.orderBy("i").coalesce(1).select(F.col("w").cast("string").alias("value")).write.text(folder)
    file = next(f for f in spark.read.text(folder).inputFiles())
    return X.Model(name, load_linear, file, 64)


@query(
    "score_models",
    """WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT label, unnest(range(1, 65)) AS i, unnest(e) AS v FROM x),
    w AS (SELECT list(a ORDER BY i) AS a, list(o ORDER BY i) AS o FROM (SELECT i, avg(v) AS a, avg(v) FILTER (label % 2 = 1) AS o FROM u GROUP BY i))
    SELECT vec_id, round(1 / (1 + exp(-list_dot_product(e, a))), 6) AS prob_all, round(1 / (1 + exp(-list_dot_product(e, o))), 6) AS prob_odd FROM x, w""",
)
def _(spark, d):
    rows = table(spark, d, "embeddings")
    models = X.Registry([_linear_model(spark, d, "all", rows), _linear_model(spark, d, "odd", rows.filter("label % 2 = 1"))])
    scored = X.score_models(rows, list(models), "embedding")
    return rounded(scored.select("vec_id", "prob_all", "prob_odd"), "prob_all", "prob_odd", digits=6)


def load_letters(_: str):
    """Counts of the letters a to z in each text, in either case."""
    return lambda texts: [[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts]


@query("feature_store", "SELECT doc_id, " + ", ".join(f"length(text) - length(replace(replace(text, '{c}', ''), '{c.upper()}', '')) AS {c}" for c in "aez") + ", 26 AS dim FROM documents")
def _(spark, d):
    docs, folder, model = table(spark, d, "documents").select("doc_id", "text"), I.scratch(spark, "features"), X.Model("letters", load_letters, "", 26)
    X.stored_features(docs.filter("doc_id % 2 = 0"), model, folder, "text")
    rows = X.stored_features(docs, model, folder, "text")  # computes what the first call has not
    at = lambda c: F.col("features")[ord(c) - 97].cast("long").alias(c)
    return rows.select("doc_id", at("a"), at("e"), at("z"), F.size("features").alias("dim"))


# ---- streams over the events table

#: Files that the events land in, one a batch, and score cells of the running metrics.
LANDED, CELLS = 4, 100


def _landing(rows: DataFrame, folder: str, files: int) -> None:
    """As new files would arrive: appended to the folder."""
    rows.repartition(files).write.mode("append").parquet(folder)


def _landed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The events in a folder of their own and a stream over it."""
    folder = I.scratch(spark, "landing")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.withColumn("label", (F.col("event_type") != "view").cast("int")).write.parquet(folder)
    return folder, spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def _arriving(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A stream that brings the rows in LANDED batches."""
    folder = I.scratch(spark, "landing")
    _landing(rows, folder, LANDED)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _kept(spark: SparkSession, changes: DataFrame, keys: list[str]) -> DataFrame:
    folder = I.scratch(spark, "keyed")
    L.run_keyed(changes, folder, I.scratch(spark, "stream"))
    return L.latest(spark, folder, changes.schema, keys)


@query("live_batch_metrics", "SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) AS BIGINT) AS fakes, avg(CASE WHEN event_type = 'view' THEN 0.0 ELSE 1.0 END) AS share FROM events GROUP BY event_type")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", (F.col("event_type") != "view").cast("int").alias("label"))
    return _kept(spark, L.class_mix(_arriving(spark, rows), ["event_type"]), ["event_type"])


def _live_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("sample_id", "domain", "prob2", "label")  # prob2 lies on a grid of 1 / CELLS
    return _kept(spark, L.score_cells(_arriving(spark, rows), ["domain"], "prob2", cells=CELLS), ["domain", "cell"])


@query("live_auc", f"{M}, x AS (SELECT domain, label, rank() OVER (PARTITION BY domain ORDER BY prob2) + (count(*) OVER (PARTITION BY domain, prob2) - 1) / 2 AS r FROM m), c AS (SELECT domain, count(*) AS n, sum(label) AS p, count(*) - sum(label) AS q, sum(r) FILTER (label = 1) AS s FROM x GROUP BY domain) SELECT domain, n, round((s - p * (p + 1) / 2) / (p * q), 8) AS auc FROM c")
def _(spark, d):
    return rounded(L.live_auc(_live_cells(spark, d), ["domain"]), "auc")


@query("live_calibration", f"{M} SELECT domain, CAST(greatest(0, ceil(round(prob2 * 100) / 10) - 1) AS INTEGER) AS bin, count(*) AS n, round(avg(prob2), 8) AS mean_score, round(avg(label), 8) AS share FROM m GROUP BY ALL")
def _(spark, d):
    return rounded(L.live_calibration(_live_cells(spark, d), ["domain"], CELLS // 10), "mean_score", "share")


@query("incremental_manifest", "SELECT event_id, event_type FROM events")
def _(spark, d):
    rows, incoming = table(spark, d, "events").select("event_id", "event_type"), I.scratch(spark, "landing")
    manifest, checkpoint = I.scratch(spark, "manifest"), I.scratch(spark, "stream")
    for part in (rows.filter("event_id % 3 <> 0"), rows):  # the second run meets the keys of the first again
        _landing(part, incoming, 2)
        I.grow_manifest(spark, incoming, rows.schema, manifest, checkpoint, "event_id")
    return spark.read.parquet(manifest)


@query(
    "stream_window_mix",
    """SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) AS BIGINT) AS fakes FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY ALL""",
)
def _(spark, d):
    mix = I.windowed_class_mix(_landed(spark, d)[1], "ts", "1 day", "2 days", "event_type")  # closed days only
    return I.run_to_files(mix, I.scratch(spark, "mix"), I.scratch(spark, "stream")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


# ---- image files: each vector as 8 x 8 grey values; some broken, absent or blank

GREY = """WITH g AS (SELECT vec_id, CASE WHEN vec_id % 50 = 3 THEN 'corrupt' WHEN vec_id % 50 = 4 THEN 'absent' ELSE 'ok' END AS status,
    list_transform(embedding, lambda v: CASE WHEN vec_id % 50 = 5 THEN 9 ELSE CAST(least(255, floor(abs(CAST(v AS DOUBLE)) * 512)) AS INTEGER) END) AS p FROM embeddings),
i AS (SELECT *, list_transform(list_filter(range(10, 56), lambda k: (k - 1) % 8 BETWEEN 1 AND 6), lambda k: p[k - 8] + p[k + 8] + p[k - 1] + p[k + 1] - 4 * p[k]) AS bend FROM g)"""


def _grey_images(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The folder of the images and the paths that a manifest would expect there."""
    folder, part = I.scratch(spark, "images"), F.col("vec_id") % 50
    pixel = lambda v: F.when(part == 5, 9).otherwise(F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 512).cast("int")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(part != 3, F.transform("embedding", pixel)).alias("pixels"))
    rows = rows.withColumn("path", F.format_string("%d/%d.png", F.col("vec_id") % 16, "vec_id"))
    sinks.write_grey_images(rows.filter(part != 4), folder, "path", "pixels", 8).count()
    return folder, rows.select(F.concat(F.lit(f"{folder}/"), "path").alias("path"))


def _vec_id(path: str = "path"):
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long").alias("vec_id")


@query("decode_audit", f"{GREY} SELECT vec_id, status, CASE status WHEN 'ok' THEN 8 WHEN 'corrupt' THEN -1 END AS width FROM g")
def _(spark, d):
    folder, expected = _grey_images(spark, d)
    return decode_audit(spark, folder, expected).select(_vec_id(), "status", "width")


@query("image_stats", f"{GREY} SELECT vec_id, round(list_avg(p), 5) AS mean, round(list_stddev_pop(p), 5) AS std FROM i WHERE status = 'ok'")
def _(spark, d):
    return rounded(image_stats(spark, _grey_images(spark, d)[0]).select(_vec_id(), "mean", "std"), "mean", "std", digits=5)


@query("sharpness_rgb", f"{GREY} SELECT vec_id, round(list_var_pop(bend), 4) AS sharpness, round(list_avg(p), 5) AS red, round(list_avg(p), 5) AS green, round(list_avg(p), 5) AS blue FROM i WHERE status = 'ok'")
def _(spark, d):
    stats = image_stats(spark, _grey_images(spark, d)[0]).select(_vec_id(), F.round("sharpness", 4).alias("sharpness"), "red", "green", "blue")
    return rounded(stats, "red", "green", "blue", digits=5)


@query("blank_images", f"{GREY} SELECT vec_id FROM i WHERE status = 'ok' AND len(list_distinct(p)) = 1")
def _(spark, d):
    return image_stats(spark, _grey_images(spark, d)[0]).filter("blank").select(_vec_id())


#: Bits in which the hashes of near copies of an image may differ.
NEAR_BITS = 6


def _hashed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, hash of the images; every seventh vector has a copy twice as wide and high, every eleventh one that is brighter by 2."""
    folder, id_ = I.scratch(spark, "images"), F.col("vec_id")
    pixel = lambda v: F.least(F.lit(250), F.floor(F.abs(v.cast("double")) * 512).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("pixels"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.get("pixels", F.floor(k / 32).cast("int") * 8 + F.floor(k % 16 / 2).cast("int")))
    for kind, width, part in (("plain", 8, rows), ("wide", 16, rows.filter(id_ % 7 == 0).withColumn("pixels", wide)), ("bright", 8, rows.filter(id_ % 11 == 0).withColumn("pixels", F.transform("pixels", lambda p: p + 2)))):
        path = F.format_string("%d/%s%d.png", id_ % 16, F.lit(kind), id_)
        sinks.write_grey_images(part.withColumn("path", path), folder, "path", "pixels", width).count()
    return perceptual_hashes(spark, folder).withColumn("name", F.regexp_extract("path", r"([a-z]+\d+)\.png$", 1))


# Cells of the 8 x 9 grid over 8 x 8 pixels: each row is a row of pixels, column c has 8 - c parts of pixel c and c of the one before.
HASHED = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(least(250, floor(abs(CAST(v AS DOUBLE)) * 512)) AS INTEGER)) AS p FROM embeddings),
c AS (SELECT vec_id, list_transform(range(72), lambda k: coalesce((8 - k % 9) * p[k // 9 * 8 + k % 9 + 1], 0) * CAST(k % 9 < 8 AS INTEGER) + CASE WHEN k % 9 > 0 THEN k % 9 * p[k // 9 * 8 + k % 9] ELSE 0 END) AS cells FROM e),
b AS (SELECT vec_id, array_to_string(list_transform(range(64), lambda k: CAST(CAST(cells[k // 8 * 9 + k % 8 + 2] > cells[k // 8 * 9 + k % 8 + 1] AS INTEGER) AS VARCHAR)), '') AS bits FROM c),
n AS (SELECT 'plain' || vec_id AS name, bits FROM b UNION ALL SELECT 'wide' || vec_id, bits FROM b WHERE vec_id % 7 = 0 UNION ALL SELECT 'bright' || vec_id, bits FROM b WHERE vec_id % 11 = 0)"""


@query("perceptual_hashes", f"{HASHED} SELECT name, bits FROM n")
def _(spark, d):
    return _hashed_images(spark, d).select("name", F.lpad(F.bin("hash"), 64, "0").alias("bits"))


@query(
    "near_images",
    f"""{HASHED.replace("WITH e", "WITH RECURSIVE e", 1)}, l AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON hamming(x.bits, y.bits) <= {NEAR_BITS}),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT a AS name, min(b) AS class_id, (SELECT count(*) FROM n m WHERE m.bits = any_value(n.bits)) AS copies FROM r JOIN n ON n.name = r.a GROUP BY a""",
)
def _(spark, d):
    return near_images(_hashed_images(spark, d), NEAR_BITS, "name")


# ---- files written and read back

#: Bytes of a range of a JSON file: few, so that the files of the smaller tables are cut many times as well.
SPLIT_BYTES = 1 << 16

MANIFEST_SQL = f"{M} SELECT method, video, domain || '/' || method || '/' || sample_id || '.png' AS path, identity, domain, label FROM m"


def _manifest(m: DataFrame) -> DataFrame:
    path = F.concat(F.concat_ws("/", "domain", "method", F.col("sample_id").cast("string")), F.lit(".png"))
    return m.select("method", "video", path.alias("path"), "identity", "domain", "label")


@query("scan_manifest", MANIFEST_SQL)
def _(spark, d):
    folder = I.scratch(spark, "csv")
    _manifest(samples(spark, d)).write.option("header", "true").csv(folder)
    return S.scan_manifest(spark, folder)


@query("scan_pool", f"{M} SELECT domain || '/' || method || '/' || sample_id || '.png' AS path, CASE WHEN method = 'error' THEN 1 ELSE label END AS label, method FROM m")
def _(spark, d):
    folder = I.scratch(spark, "csv")
    rows = _manifest(samples(spark, d)).select("path", F.when(F.col("method") != "error", F.col("label")).alias("label"), "method")
    rows.write.option("header", "true").csv(folder)
    return S.scan_pool(spark, folder)


@query("scan_split_csv", f"{M} SELECT CAST(sample_id AS VARCHAR) AS path, label FROM m WHERE method <> 'signup'")
def _(spark, d):
    folder = I.scratch(spark, "csv")
    line = F.when(F.col("method") == "signup", F.col("sample_id").cast("string")).otherwise(F.concat_ws(",", F.col("sample_id").cast("string"), F.col("label").cast("string")))
    samples(spark, d).select(line.alias("value")).write.text(folder)
    return S.scan_split(spark, folder, header=False)


@query("scan_list_file", f"{M} SELECT label AS flag, 'v/' || video AS path FROM m")
def _(spark, d):
    folder = I.scratch(spark, "text")
    samples(spark, d).select(F.concat(F.lit(" "), F.col("label").cast("string"), F.lit("  v/"), "video").alias("value")).write.text(folder)
    return S.scan_list(spark.read.text(folder))


@query("scan_history", f"{R} SELECT run, epoch, acc FROM r")
def _(spark, d):
    folder = I.scratch(spark, "json")
    runs(spark, d).select("run", "epoch", "acc").write.json(folder)
    return S.scan_history(spark, folder).select("run", "epoch", "acc")


@query("write_split", f"{_split_sql(THREE)} SELECT split, count(*) AS n, sum(label) AS fakes, min(identity) AS first_identity FROM m JOIN s USING (identity) GROUP BY split")
def _(spark, d):
    folder = I.scratch(spark, "split")
    rows = D.split_groups(samples(spark, d), ["identity"], PARTS3)
    sinks.write_split(rows.withColumn("path", F.col("sample_id").cast("string")), folder, detailed=True)
    return snapshots.read(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("fakes"), F.min("identity").alias("first_identity"))


@query(
    "write_method_suites",
    f"""{_split_sql(THREE)}, x AS (SELECT m.*, split FROM m JOIN s USING (identity)), ks AS (SELECT DISTINCT method AS suite FROM x WHERE label = 1),
    full_ AS (SELECT suite, sample_id, label, identity, split FROM x, ks WHERE label = 0 OR method = suite),
    fakes AS (SELECT scope, method AS suite, sample_id, label, row_number() OVER (PARTITION BY scope, method ORDER BY md5('42:' || sample_id), sample_id) AS r FROM x, (VALUES ('test'), ('benchmark')) v(scope) WHERE label = 1 AND (scope = 'benchmark' OR split = 'test')),
    reals AS (SELECT scope, suite, sample_id, label, row_number() OVER (PARTITION BY scope, suite ORDER BY md5('42:' || suite || ':' || sample_id), sample_id) AS r FROM x, ks, (VALUES ('test'), ('benchmark')) v(scope) WHERE label = 0 AND (scope = 'benchmark' OR split = 'test')),
    n AS (SELECT scope, suite, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS n FROM (SELECT * FROM fakes UNION ALL SELECT * FROM reals) GROUP BY ALL),
    v AS (SELECT suite, scope || '_balanced' AS variant, sample_id, label, NULL AS identity FROM (SELECT * FROM fakes UNION ALL SELECT * FROM reals) JOIN n USING (scope, suite) WHERE r <= n
      UNION ALL SELECT suite, 'benchmark_full', sample_id, label, NULL FROM full_ UNION ALL SELECT suite, 'test_full', sample_id, label, NULL FROM full_ WHERE split = 'test' UNION ALL SELECT suite, 'test_detailed', sample_id, label, identity FROM full_ WHERE split = 'test')
    SELECT suite, variant, count(*) AS n, CAST(sum(label) AS BIGINT) AS fakes, CAST(sum(sample_id) AS BIGINT) AS ids, min(identity) AS first_identity FROM v GROUP BY ALL""",
)
def _(spark, d):
    folder = I.scratch(spark, "suites")
    rows = D.split_groups(samples(spark, d), ["identity"], PARTS3).withColumn("path", F.col("sample_id").cast("string"))
    sinks.write_suites(B.method_suites(rows, rows.filter("split = 'test'"), "sample_id"), folder)
    found = snapshots.read(spark, folder).groupBy("suite", "variant")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("fakes"), F.sum(F.col("path").cast("long")).alias("ids"), F.min("identity").alias("first_identity"))


def _two_appends(spark: SparkSession, sf_dir: str) -> str:
    folder, m = I.scratch(spark, "manifest"), samples(spark, sf_dir).select("sample_id", "method")
    sinks.append_manifest(m.filter("method IN ('real', 'click')"), folder, "sample_id")
    sinks.append_manifest(m.filter("method IN ('click', 'error')"), folder, "sample_id")
    return folder


@query("append_manifest", f"{M} SELECT sample_id, method FROM m WHERE method IN ('real', 'click', 'error')")
def _(spark, d):
    return snapshots.read(spark, _two_appends(spark, d))


@query("manifest_versions", f"{M} SELECT sample_id, 1 AS since FROM m WHERE method IN ('real', 'click') UNION ALL SELECT sample_id, 2 FROM m WHERE method = 'error'")
def _(spark, d):
    folder = _two_appends(spark, d)
    first, later = snapshots.read(spark, folder, 1), snapshots.changes(spark, folder, 1)
    return first.select("sample_id", F.lit(1).alias("since")).unionByName(later.select("sample_id", F.lit(2).alias("since")))


@query("write_summary", f"{M} SELECT domain, count(*) AS n FROM m GROUP BY domain")
def _(spark, d):
    folder = I.scratch(spark, "summary")
    sinks.write_summary(samples(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n")), folder)
    return spark.read.json(folder).select("domain", "n")


@query("scan_tree", f"{M} SELECT 'domain=' || domain AS category, 'method=' || method AS \"group\" FROM m GROUP BY ALL")
def _(spark, d):
    folder = I.scratch(spark, "tree")
    samples(spark, d).select("domain", "method", F.col("sample_id").cast("string").alias("value")).write.partitionBy("domain", "method").text(folder)
    return S.scan_tree(spark, folder, r"\.txt$").filter("length > 0").select("category", "group").distinct()


@query(
    "scan_nested_index",
    f"{M} SELECT domain AS source, method AS side, 'all' AS split, video, row_number() OVER (PARTITION BY domain, method, video ORDER BY CAST(sample_id AS VARCHAR)) - 1 AS position, CAST(sample_id AS VARCHAR) AS frame FROM m",
)
def _(spark, d):
    folder = I.scratch(spark, "json")
    videos = samples(spark, d).groupBy("domain", "method", "video").agg(F.sort_array(F.collect_list(F.col("sample_id").cast("string"))).alias("frames"))
    sinks.write_nested_index(videos.select(F.col("domain").alias("source"), F.col("method").alias("side"), F.lit("all").alias("split"), "video", "frames"), folder)
    return S.scan_nested_index(spark, folder, SPLIT_BYTES).withColumn("position", F.col("position").cast("long"))


@query("scan_annotations", f"{M} SELECT sample_id AS image_id, 'v/' || video AS file_name, label FROM m")
def _(spark, d):
    folder, m = I.scratch(spark, "json"), samples(spark, d)
    part = lambda name, *fields: m.select("domain", F.lit(name).alias("part"), F.col("sample_id").alias("place"), F.to_json(F.struct(*fields)).alias("value"))
    images = part("images", F.col("sample_id").alias("id"), F.concat(F.lit("v/"), "video").alias("file_name"))
    sinks.write_json_arrays(images.unionByName(part("annotations", F.col("sample_id").alias("image_id"), F.col("label").alias("category_id"))), folder, "domain")
    return S.scan_annotations(spark, folder, split_bytes=SPLIT_BYTES)


@query("scan_features", "SELECT vec_id, label, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def _(spark, d):
    folder, rows = I.scratch(spark, "features"), table(spark, d, "embeddings")
    rows.select("vec_id", F.col("embedding").cast("array<float>").alias("features")).write.parquet(folder)
    found = X.aligned_features(S.scan_features(spark, folder, "vec_id"), rows.select("vec_id", "label"), ["vec_id"], 64)
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return rounded(found.select("vec_id", "label", F.size("features").alias("dim"), total.alias("total")), "total", digits=4)


@query("scan_reports", f"{M} SELECT method, domain, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY ALL UNION ALL SELECT method, domain, 'fakes', CAST(sum(label) AS DOUBLE) FROM m GROUP BY ALL")
def _(spark, d):
    folder = I.scratch(spark, "json")
    each = samples(spark, d).groupBy("method", "domain").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("fakes"))
    report = F.create_map(F.concat_ws("/", "method", "domain"), F.create_map(F.lit("n"), "n", F.lit("fakes"), "fakes"))
    each.select(F.to_json(report).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return S.scan_reports(spark, folder)


# ---- single expressions


@query("label_from_category", f"{M} SELECT sample_id, CASE domain WHEN 'cdc' THEN 0 WHEN 'ffc' THEN 0 WHEN 'fe' THEN 1 END AS label FROM m")
def _(spark, d):
    own = K.label_from_category(F.upper("domain"), {"cdc": 0, "ffc": 0, "fe": 1})
    return samples(spark, d).select("sample_id", own.alias("label"))


@query("label_from_method", f"{M} SELECT sample_id, CASE WHEN sample_id % 10 = 0 THEN 0 ELSE label END AS label, 1 - label AS inverted FROM m")
def _(spark, d):
    own = K.label_from_method(F.col("method"), F.when(F.col("sample_id") % 10 == 0, 0))
    return samples(spark, d).select("sample_id", own.alias("label"), K.label_invert(F.col("label")).alias("inverted"))


@query("label_from_name", f"{M} SELECT sample_id, CASE WHEN method = 'real' THEN 0 WHEN method = 'error' THEN 1 END AS label FROM m")
def _(spark, d):
    name = F.when(F.col("method") == "error", F.concat(F.lit("FAKE_"), "video")).otherwise(F.concat("method", F.lit("_"), "video"))
    return samples(spark, d).select("sample_id", K.label_from_name(name).alias("label"))


# Keys of every kind: what a sample's place is made of depends on its number.
KINDS = f"""{M}, k AS (SELECT *, CASE sample_id % 6 WHEN 0 THEN 'id' || user_id || '_' || sample_id % 9 || '_0003' WHEN 1 THEN user_id || '_' || sample_id WHEN 5 THEN CAST(user_id AS VARCHAR) ELSE 'clip' || user_id END AS place,
    CASE sample_id % 6 WHEN 2 THEN user_id || '_7' WHEN 3 THEN CAST(user_id AS VARCHAR) ELSE domain END AS folder FROM m)"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, user = samples(spark, sf_dir), F.split("video", "_")[0]
    id_, kind = F.col("sample_id"), F.col("sample_id") % 6
    place = F.when(kind == 0, F.concat(F.lit("id"), user, F.lit("_"), (id_ % 9).cast("string"), F.lit("_0003"))).when(kind == 1, F.concat_ws("_", user, id_.cast("string"))).when(kind == 5, user).otherwise(F.concat(F.lit("clip"), user))
    folder = F.when(kind == 2, F.concat(user, F.lit("_7"))).when(kind == 3, user).otherwise(F.col("domain"))
    return rows.withColumns({"place": place, "folder": folder})


@query(
    "source_keys",
    f"""{KINDS} SELECT sample_id, CASE sample_id % 6 WHEN 0 THEN 'c:id' || user_id WHEN 1 THEN 'p:' || user_id WHEN 2 THEN 'p:' || user_id WHEN 3 THEN 'n:' || user_id ELSE CASE WHEN method = 'real' THEN 'r:' || place ELSE method || ':' || place END END AS source,
    split_part(place, '_', 1) AS subject FROM k""",
)
def _(spark, d):
    return _kinds(spark, d).select("sample_id", K.source_key(F.col("method"), F.col("place"), F.col("folder")).alias("source"), K.subject_prefix(F.col("place")).alias("subject"))


@query("frame_identities", f"{KINDS} SELECT sample_id, CASE WHEN sample_id % 6 = 0 THEN 'id' || user_id || '_' || sample_id % 9 WHEN sample_id % 6 = 5 THEN CAST(user_id AS VARCHAR) END AS identity FROM k")
def _(spark, d):
    # Frames are named after their source and the place in it, as in real-clips_id3_4_0003_12.png.
    rows = _kinds(spark, d).select("sample_id", F.concat(F.lit("real-clips_"), F.regexp_replace("place", "_0003$", ""), F.lit("_12.png")).alias("name"))
    return rows.select("sample_id", K.identity_from_frame(F.col("name"), r"real-clips_(id\d+_\d+|\d+)_\d+\.png$").alias("identity"))


REMAP = {None: [("cdf/Celeb-real/", "cdf/Fake_from_Celeb-real/")], "click": [("/real/", "/real/real/"), ("/fake/", "/fake/fake/")]}


@query("path_remap", f"{M} SELECT sample_id, CASE WHEN method = 'click' THEN domain || '/cdf/Fake_from_Celeb-real/fake/fake/' ELSE domain || '/cdf/Fake_from_Celeb-real/fake/' END || sample_id || '.png' AS new_path FROM m")
def _(spark, d):
    path = F.concat(F.col("domain"), F.lit("/cdf/Celeb-real/fake/"), F.col("sample_id").cast("string"), F.lit(".png"))
    return samples(spark, d).select("sample_id", K.path_remap(path, F.col("method"), REMAP).alias("new_path"))


NAMES = [m for members in K.TAXONOMY.values() for m in members] + ["real"]


@query(
    "taxonomy_families",
    f"""{M}, n AS (SELECT *, list_extract([{", ".join(f"'{n}'" for n in NAMES)}], CAST(sample_id % {len(NAMES)} + 1 AS INTEGER)) AS name FROM m), f(family, members, known) AS (VALUES {", ".join(f"('{f}', [{', '.join(f"'{x}'" for x in m)}], {f not in K.UNKNOWN_FAMILIES})" for f, m in K.TAXONOMY.items())})
    SELECT coalesce(family, 'other') AS family, coalesce(known, true) AS known, count(*) AS n, round(avg(prob), 8) AS mean_p FROM n LEFT JOIN f ON list_contains(members, name) GROUP BY ALL""",
)
def _(spark, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("sample_id") % len(NAMES) + 1).cast("int"))
    family = K.method_family(name, K.TAXONOMY).alias("family")
    rows = samples(spark, d).groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_p"))
    return rounded(rows.withColumn("known", ~F.col("family").isin(*K.UNKNOWN_FAMILIES)), "mean_p")


@query(
    "real_by_kind",
    f"""{KINDS}, x AS (SELECT pred, unnest([struct_pack(kind := 'domain', value := domain), struct_pack(kind := 'folder', value := folder), struct_pack(kind := 'identifier', value := CASE WHEN regexp_full_match(place, 'id[0-9]+_[0-9]+') THEN 'celebrity' WHEN regexp_full_match(place, '[0-9]+_[0-9]+') THEN 'pair' WHEN regexp_full_match(place, '[0-9]+') THEN 'number' ELSE 'other' END)]) AS s FROM k WHERE label = 0)
    SELECT s.kind AS kind, s.value AS value, count(*) AS n, round(avg(1 - pred), 8) AS real_acc, CAST(sum(pred) AS BIGINT) AS false_positives FROM x GROUP BY ALL""",
)
def _(spark, d):
    kinds = {"domain": F.col("domain"), "folder": F.col("folder"), "identifier": K.classify_source(F.col("place"))}
    return rounded(A.real_report(_kinds(spark, d), kinds), "real_acc")


@query(
    "leakage_by_level",
    f"""{_split_sql(THREE)}, x AS (SELECT split_part(video, '_', 1) AS subject, video, split FROM m JOIN s USING (identity)), y AS (SELECT DISTINCT level, key, split FROM (SELECT 'subject' AS level, subject AS key, split FROM x UNION ALL SELECT 'video', video, split FROM x))
    SELECT a.level, a.split AS split_a, b.split AS split_b, count(*) AS shared FROM y a JOIN y b ON a.level = b.level AND a.key = b.key AND a.split < b.split GROUP BY ALL""",
)
def _(spark, d):
    rows = D.split_groups(samples(spark, d), ["identity"], PARTS3).withColumn("subject", K.subject_prefix(F.col("video")))
    return D.leakage_by_level(rows, {"subject": "subject", "video": "video"})


@query("path_rewrite", f"{P} SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'mobile/' || substr(url, 11) ELSE url END AS new_url FROM p")
def _(spark, d):
    return pages(spark, d).select("page_id", K.path_rewrite(F.col("url"), "https://m.", "mobile/").alias("new_url"))


@query("path_parts", f"{P}, q AS (SELECT page_id, string_split(path, '/') AS parts FROM p) SELECT page_id, coalesce(list_extract(parts, -2), '') AS folder, CASE WHEN list_contains(parts, 'en') THEN array_to_string(parts[list_position(parts, 'en') + 1 :], '/') END AS tail FROM q")
def _(spark, d):
    return pages(spark, d).select("page_id", K.path_folder(F.col("path")).alias("folder"), K.path_after(F.col("path"), "en").alias("tail"))


@query("safe_ratio", f"{M} SELECT identity, round(sum(label) / greatest(1, count(*) - sum(label)), 8) AS ratio FROM m GROUP BY identity")
def _(spark, d):
    rows = samples(spark, d).groupBy("identity").agg(F.sum("label").alias("f"), F.count_if(F.col("label") == 0).alias("r"))
    return rounded(rows.select("identity", K.safe_ratio(F.col("f"), F.col("r")).alias("ratio")), "ratio")


@query("merge_pools", f"{M} SELECT method, label, count(*) AS n FROM m WHERE (label = 0 AND domain <> 'fe') OR (label = 1 AND domain <> 'efs') GROUP BY ALL")
def _(spark, d):
    m = samples(spark, d).select("method", "label", "domain")
    both = m.filter("label = 0 AND domain <> 'fe'").unionByName(m.filter("label = 1 AND domain <> 'efs'"))
    return both.groupBy("method", "label").agg(F.count(F.lit(1)).alias("n"))


@query("intersect_except", f"{M}, a AS (SELECT DISTINCT video FROM m WHERE label = 0), b AS (SELECT DISTINCT video FROM m WHERE label = 1) SELECT video, 'both' AS side FROM a WHERE video IN (SELECT video FROM b) UNION ALL SELECT video, 'real_only' FROM a WHERE video NOT IN (SELECT video FROM b)")
def _(spark, d):
    m = samples(spark, d)
    a, b = m.filter("label = 0").select("video"), m.filter("label = 1").select("video")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("real_only")))


@query("cumulative_counts", f"{M}, {CUMD} SELECT domain, score, pos, neg, pb AS pos_below, nb AS neg_below, ap AS all_pos, an AS all_neg FROM w")
def _(spark, d):
    return A.cumulative(samples(spark, d), "prob", ["domain"])


@query("improving_epochs", f"{R}, b AS (SELECT *, max(acc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r) SELECT run, epoch, best AS best_before, best IS NULL OR acc > best AS improved FROM b")
def _(spark, d):
    return H.improvements(runs(spark, d)).select("run", "epoch", "best_before", "improved")
