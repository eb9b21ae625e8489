"""Readers for manifests, listings, indexes and reports; one schema for each, defaults as columns."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.keys import label_from_method
from tessera.functions.shared import materialise
from tessera.sources.split_json import scan_json_values

_S, _I = T.StringType(), T.IntegerType()
MANIFEST = T.StructType([T.StructField(c, _S) for c in ("method", "video", "path", "identity", "domain")] + [T.StructField("label", _I)])
POOL = T.StructType([T.StructField("path", _S), T.StructField("label", _I), T.StructField("method", _S)])
SPLIT = T.StructType([T.StructField("path", _S), T.StructField("label", _I)])
IMAGE_SUFFIXES = r"\.(png|jpe?g|bmp)$"


def with_defaults(df: DataFrame) -> DataFrame:
    """Fills identity, domain and video with "unknown" and the label from the method."""
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("identity", "domain", "video")})
    return out.withColumn("label", label_from_method(F.col("method"), F.col("label")))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV with any of MANIFEST's columns, by name; absent ones take their defaults."""
    raw = spark.read.option("header", "true").csv(path)
    return with_defaults(raw.select(*((F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST)))


def scan_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POOL).option("header", "true").csv(path).withColumn("label", F.coalesce("label", F.lit(1)))


def scan_split(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Two-column CSV; rows that don't fit the schema are left out. A header other than path, label is warned of."""
    if header and (found := spark.read.option("header", "true").csv(path).columns) != list(SPLIT.names):
        warnings.warn(f"{path} has the header {','.join(found)}, not {','.join(SPLIT.names)}", stacklevel=2)
    schema = T.StructType([*SPLIT.fields, T.StructField("_bad", _S)])
    rows = spark.read.schema(schema).option("header", str(header).lower()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    return rows.filter(F.col("_bad").isNull() & F.col("path").isNotNull() & F.col("label").isNotNull()).drop("_bad")


def scan_tree(spark: SparkSession, folder: str, suffixes: str = IMAGE_SUFFIXES, skip: tuple[str, ...] = ("landmarks",)) -> DataFrame:
    """path, length, category, group, name of the files below ``folder``/<category>/<group>/; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    out = files.filter(F.lower("path").rlike(suffixes) & ~hidden & ~F.arrays_overlap(parts, F.array(*map(F.lit, skip))))
    return out.select("path", "length", F.try_element_at(parts, F.lit(-3)).alias("category"), F.try_element_at(parts, F.lit(-2)).alias("group"), F.try_element_at(parts, F.lit(-1)).alias("name"))


def scan_nested_index(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """source, side, split, video, position, frame from {source: {side: {split: {video: {frames: [...]}}}}}.

    Files of any size are read in ranges of ``split_bytes``; a task holds one video's frames at a time.
    """
    values = scan_json_values(spark, path, 4, split_bytes)
    names = [F.col("keys")[i].alias(n) for i, n in enumerate(("source", "side", "split", "video"))]
    return values.select(*names, F.posexplode(F.from_json("value", "frames array<string>")["frames"]).alias("position", "frame"))


def scan_annotations(spark: SparkSession, path: str, category: int = 1, split_bytes: int | None = None) -> DataFrame:
    """image_id, file_name, label: 1 if any annotation of the image has ``category``.

    Files {"images": [{id, file_name}], "annotations": [{image_id, category_id}]} of any size are read in ranges
    of ``split_bytes``, so the order of the two arrays doesn't matter and neither is held whole.
    """
    values = scan_json_values(spark, path, 2, split_bytes).withColumn("part", F.col("keys")[0]).filter("part IN ('images', 'annotations')")
    # The files are read once, for both arrays.
    fields = "id bigint, file_name string, image_id bigint, category_id int"
    values = materialise(values.select("part", F.from_json("value", fields).alias("v")).select("part", "v.*"))
    images = values.filter("part = 'images'").select(F.col("id").alias("image_id"), "file_name")
    hits = values.filter("part = 'annotations'").filter(F.col("category_id") == category).select("image_id").distinct().withColumn("_hit", F.lit(1))
    return images.join(hits, "image_id", "left").select("image_id", "file_name", F.coalesce("_hit", F.lit(0)).alias("label"))


def scan_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """flag, path from lines "<flag> <path>"; shorter lines are left out."""
    parts = F.split(F.trim(F.col(value)), r"\s+")
    return lines.filter(F.size(parts) >= 2).select(parts[0].cast("int").alias("flag"), parts[1].alias("path"))


def scan_features(spark: SparkSession, path: str, key: str, column: str = "features") -> DataFrame:
    """``key`` and an array of floats; ValueError where the stored columns are of another kind."""
    rows = spark.read.parquet(path)
    kind = rows.schema[column].dataType if column in rows.columns else None
    if key not in rows.columns or not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{path} doesn't hold {key} and {column}, an array of floats")
    return rows.select(key, F.col(column).cast("array<float>").alias(column))


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """method, domain, metric, value from {"<method>/<domain>": {metric: value}}."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    rows = rows.select(F.explode("m").alias("key", "v")).select("key", F.explode("v").alias("metric", "value"))
    return rows.select(F.split("key", "/", 2)[0].alias("method"), F.split("key", "/", 2)[1].alias("domain"), "metric", "value")


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def filter_extension(df: DataFrame, path: str, suffixes: str = IMAGE_SUFFIXES) -> DataFrame:
    return df.filter(F.lower(path).rlike(suffixes))


def filter_methods(df: DataFrame, wanted: list[str], aliases: dict[str, list[str]], method: str = "method") -> DataFrame:
    """Rows of the wanted methods, each name standing for its aliases as well."""
    names = sorted({m for w in wanted for m in [w, *aliases.get(w, [])]})
    return df.filter(F.lower(F.col(method)).isin(names))


def filter_allow_skip(df: DataFrame, column: str, allow: list[str] | None, skip: list[str]) -> DataFrame:
    keep: Column = ~F.col(column).isin(skip) if skip else F.lit(True)
    return df.filter(keep if allow is None else keep & F.col(column).isin(allow))


def hard_examples(df: DataFrame, prob: str, label: str, pred: str, least: float = 0.7) -> DataFrame:
    """Rows whose confidence is below ``least`` or whose prediction is wrong."""
    return df.filter((F.greatest(F.col(prob), 1 - F.col(prob)) < least) | (F.col(pred) != F.col(label)))
