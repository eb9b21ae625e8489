"""Canonical manifests derived from the given tables; each as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import label_from_method
from tessera.functions.shared import dealt

DOMAINS = ("cdc", "ffc", "efs", "oth", "fe")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: sample_id, method, label, domain, identity, video, prob, prob2, ts, pred, pred2."""
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.col("user_id") % 5 + 1).cast("int"))
    method = F.when(F.col("event_type") == "view", "real").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"), method.alias("method"), domain.alias("domain"),
        F.concat(domain, F.lit(":"), F.col("user_id"), F.lit("_"), F.dayofmonth("ts")).alias("identity"),
        F.concat_ws("_", F.col("user_id").cast("string"), (F.col("event_id") % 37).cast("string")).alias("video"),
        (F.col("value") / (F.col("value") + 50)).alias("prob"),
        (F.regexp_extract("props", r'"k": (\d+)', 1).cast("double") / 100).alias("prob2"), "ts",
    )
    rows = rows.withColumn("label", label_from_method(F.col("method")))
    return rows.withColumns({"pred": (F.col("prob") >= 0.5).cast("int"), "pred2": (F.col("prob2") >= 0.5).cast("int")})


M = """WITH m0 AS (
  SELECT event_id AS sample_id, CASE WHEN event_type = 'view' THEN 'real' ELSE event_type END AS method,
    CASE user_id % 5 WHEN 0 THEN 'cdc' WHEN 1 THEN 'ffc' WHEN 2 THEN 'efs' WHEN 3 THEN 'oth' ELSE 'fe' END AS domain,
    user_id, event_id, value / (value + 50) AS prob, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) / 100 AS prob2, ts
  FROM events),
m AS (SELECT *, domain || ':' || user_id || '_' || day(ts) AS identity, user_id || '_' || (event_id % 37) AS video,
    CASE WHEN method = 'real' THEN 0 ELSE 1 END AS label, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred,
    CASE WHEN prob2 >= 0.5 THEN 1 ELSE 0 END AS pred2 FROM m0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: identity (customer), video (order), frame, method, label, uid."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = lines.count()
    rows = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), lines["l_orderkey"] == orders["o_orderkey"])
    uid = F.concat_ws("_", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    return rows.select(
        F.col("o_custkey").alias("identity"), F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("frame"),
        F.concat(F.lit("m"), F.col("l_linestatus")).alias("method"), (F.col("l_returnflag") == "R").cast("int").alias("label"), uid.alias("uid"),
    )


G = """WITH g AS (SELECT o_custkey AS identity, l_orderkey AS video, l_linenumber AS frame, 'm' || l_linestatus AS method,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS uid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as epochs of runs (customers): run, epoch, acc, started."""
    from pyspark.sql import Window

    along = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(along).alias("epoch"), (F.col("o_totalprice") / 1e6).alias("acc"), F.col("o_orderdate").alias("started"))


R = """WITH r AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch,
  o_totalprice / 1e6 AS acc, o_orderdate AS started FROM orders)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, path (without scheme), name."""
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"), F.substring_index(path, "/", -1).alias("name"))


P = """WITH p AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS path,
  list_extract(string_split(regexp_replace(url, '^https?://', ''), '/'), -1) AS name FROM pages)"""
