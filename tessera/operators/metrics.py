"""Binary detection metrics over any slice; the positive class is 1 and empty denominators are explicit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import inf, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import match
from tessera.functions.shared import materialise

#: Buckets of scores in the two-level prefix sums.
BUCKETS = 512


def ratio(top: Column, bottom: Column, empty=0.0) -> Column:
    """top / bottom, ``empty`` (0 or None) where the denominator is 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def _cells(label: str, pred: str) -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """n, tn, fp, fn, tp and the row-normalised rates (null where the class is absent)."""
    out = df.groupBy(*by).agg(*_cells(label, pred))
    zero, one = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return out.withColumns({"tn_rate": ratio(F.col("tn"), zero, None), "fp_rate": ratio(F.col("fp"), zero, None), "fn_rate": ratio(F.col("fn"), one, None), "tp_rate": ratio(F.col("tp"), one, None)})


def with_metrics(cells: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 (0 for empty denominators), real_acc, fake_det (null for them)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({
        "accuracy": ratio(tp + tn, F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "real_acc": ratio(tn, tn + fp, None), "fake_det": ratio(tp, tp + fn, None),
    })


def binary_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    return with_metrics(df.groupBy(*by).agg(*_cells(label, pred)))


def metrics_by_slice(df: DataFrame, domain: str = "domain", method: str = "method", label: str = "label", pred: str = "pred") -> DataFrame:
    """slice_kind (overall, domain, method, method_domain), domain, method and all metrics, in one pass."""
    sets = df.groupingSets([[], [F.col(domain)], [F.col(method)], [F.col(method), F.col(domain)]], F.col(domain), F.col(method))
    out = with_metrics(sets.agg(F.grouping_id().alias("_g"), *_cells(label, pred)))
    kind = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "domain").when(F.col("_g") == 2, "method").otherwise("method_domain")
    return out.withColumn("slice_kind", kind).drop("_g")


def cumulative(df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """by, score, pos, neg and pos_below, neg_below, all_pos, all_neg for each distinct score.

    Rows are counted per distinct score first; then bucket totals are summed along the score and the
    scores ranked inside their bucket, so no slice is ordered in one task. The buckets are between
    approximate quantiles of the distinct scores, so crowded ends of the range are divided as well.
    """
    y = F.col(label)
    # Written once, and read for the quantiles, the totals and the sums.
    points = materialise(df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))
    cuts = points.select(F.percentile_approx(F.col("score").cast("double"), [i / BUCKETS for i in range(1, BUCKETS)])).first()[0]
    splits = [-inf, *sorted({c for c in cuts or [0.0] if isfinite(c)} or {0.0}), inf]
    points = Bucketizer(splits=splits, inputCol="score", outputCol="_b", handleInvalid="keep").transform(points)
    totals = points.groupBy(*by, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c + "0") for c in ("_p", "_n")), F.sum("_p").over(group).alias("all_pos"), F.sum("_n").over(group).alias("all_neg"))
    inside = Window.partitionBy(*by, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    out = points.withColumns({"pos_below": F.coalesce(F.sum("pos").over(inside), F.lit(0)), "neg_below": F.coalesce(F.sum("neg").over(inside), F.lit(0))})
    out = match(out, totals, [*by, "_b"])
    return out.select(*by, "score", "pos", "neg", (F.col("pos_below") + F.col("_p0")).alias("pos_below"), (F.col("neg_below") + F.col("_n0")).alias("neg_below"), "all_pos", "all_neg")


def quantiles(df: DataFrame, score: str, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """by, q0, q1, ...: exact quantiles of the non-null scores, linear between neighbours, from cumulative counts."""
    points = cumulative(df.filter(F.col(score).isNotNull()).withColumn("_one", F.lit(1)), score, by, "_one")
    out = []
    for i, share in enumerate(shares):
        place = (F.col("all_pos") - 1) * F.lit(float(share))
        low = F.max(F.when(F.col("pos_below") <= F.floor(place), F.col("score")))
        high = F.min(F.when(F.col("pos_below") + F.col("pos") > F.ceil(place), F.col("score")))
        part = F.max(place - F.floor(place))
        out.append((low * (1 - part) + high * part).alias(f"q{i}"))
    return points.groupBy(*by).agg(*out)


def roc_auc(df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """by, auc: exact, ties count half; null for slices of one class."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    out = cumulative(df, score, by, label).groupBy(*by).agg(wins.alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return out.select(*by, ratio(F.col("_w"), F.col("_p") * F.col("_n"), None).alias("auc"))


def _at_threshold(points: DataFrame) -> DataFrame:
    """Adds tp and fp when everything from this score on is called positive."""
    return points.withColumns({"tp": F.col("all_pos") - F.col("pos_below"), "fp": F.col("all_neg") - F.col("neg_below")})


def average_precision(df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    points = _at_threshold(cumulative(df, score, by, label))
    gain = F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return points.filter("all_pos > 0").groupBy(*by).agg(gain.alias("average_precision"))


def roc_points(df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """threshold, fpr, tpr for each distinct score."""
    points = _at_threshold(cumulative(df, score, by, label))
    return points.select(*by, F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("all_neg"), None).alias("fpr"), ratio(F.col("tp"), F.col("all_pos"), None).alias("tpr"))


def pr_points(df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """threshold, precision, recall for each distinct score."""
    points = _at_threshold(cumulative(df, score, by, label))
    return points.select(*by, F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("all_pos"), None).alias("recall"))


def youden(df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """by, threshold, j: where tpr - fpr is largest; of equal ones the highest threshold."""
    points = _at_threshold(cumulative(df, score, by, label)).filter("all_pos > 0 AND all_neg > 0")
    # Compared as integers: (tp * all_neg - fp * all_pos) / (all_pos * all_neg).
    gap = F.col("tp") * F.col("all_neg") - F.col("fp") * F.col("all_pos")
    best = points.groupBy(*by).agg(F.max(F.struct(gap.alias("gap"), "score", "all_pos", "all_neg")).alias("b"))
    return best.select(*by, F.col("b.score").alias("threshold"), (F.col("b.gap") / (F.col("b.all_pos") * F.col("b.all_neg"))).alias("j"))


def threshold_sweep(df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label", steps: int = 20) -> DataFrame:
    """Metrics at i / steps for i = 1 .. steps - 1, and which threshold is best (first largest balanced accuracy).

    Rows are first counted by the number of thresholds they meet; only those counts meet the grid.
    """
    met = sum((F.col(score) >= i / steps).cast("int") for i in range(1, steps))
    counts = df.groupBy(*by, met.alias("_met")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    grid = df.sparkSession.range(1, steps).select(F.col("id").cast("int").alias("step"))
    above = F.col("_met") >= F.col("step")
    cells = counts.crossJoin(F.broadcast(grid)).groupBy(*by, "step").agg(
        F.sum(F.when(above, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("_n")).otherwise(0)).alias("fp"),
        F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"),
    )
    cells = cells.withColumns({"fn": F.col("_pos") - F.col("tp"), "tn": F.col("_neg") - F.col("fp"), "n": F.col("_pos") + F.col("_neg")})
    out = with_metrics(cells).withColumn("threshold", F.col("step") / F.lit(float(steps)))
    out = out.withColumn("balanced_acc", (F.coalesce("real_acc", F.lit(0.0)) + F.coalesce("fake_det", F.lit(0.0))) / 2)
    first = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("balanced_acc"), "step"))
    return out.withColumn("best", first == 1).select(*by, "threshold", "real_acc", "fake_det", "balanced_acc", "f1", "best")


def calibration(df: DataFrame, score: str, bins: int = 10, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """bin, n, mean_score, fraction: uniform bins open on the left (0 belongs to the first); empty ones absent."""
    own = F.greatest(F.ceil(F.col(score) * bins) - 1, F.lit(0)).alias("bin")
    return df.groupBy(*by, own).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("fraction"))


def score_histogram(df: DataFrame, score: str, bins: int = 25, by: Sequence[str] = ("label",)) -> DataFrame:
    """by, bin, n, density: uniform bins closed on the left, the last one on both sides."""
    own = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    counts = df.groupBy(*by, own).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("density", F.col("n") * bins / total)


def brier(df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"))


def rates(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """real_acc, fake_det, fpr, specificity; null for absent classes."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.avg(F.when(y == 0, 1 - p)).alias("real_acc"), F.avg(F.when(y == 1, p)).alias("fake_det"),
        F.avg(F.when(y == 0, p)).alias("fpr"), F.avg(F.when(y == 0, 1 - p)).alias("specificity"),
    )


def macro_detection(df: DataFrame, method: str = "method", label: str = "label", pred: str = "pred") -> DataFrame:
    """Mean over methods of the share of fakes found."""
    each = df.filter(F.col(label) == 1).groupBy(method).agg(F.avg(pred).alias("rate"))
    return each.agg(F.count(F.lit(1)).alias("methods"), F.avg("rate").alias("macro_detection"))


def detection_summary(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """n, share above 0.5, mean and exact median of the score."""
    means = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) > 0.5).cast("double")).alias("rate"), F.avg(score).alias("mean_p"))
    return match(means, quantiles(df, score, by, [0.5]).withColumnRenamed("q0", "median_p"), by, "left")


def paired(df: DataFrame, identity: str = "identity", label: str = "label") -> DataFrame:
    """Rows of identities that have both classes."""
    both = df.groupBy(identity).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter("_a <> _b")
    return df.join(both.select(identity), identity, "left_semi")


def pairing_stats(df: DataFrame, identity: str = "identity", label: str = "label") -> DataFrame:
    """keys, paired_keys, fakes_paired, fakes_unpaired."""
    each = df.groupBy(identity).agg(F.count_if(F.col(label) == 0).alias("r"), F.count_if(F.col(label) == 1).alias("f"))
    both = (F.col("r") > 0) & (F.col("f") > 0)
    return each.agg(F.count(F.lit(1)).alias("keys"), F.count_if(both).alias("paired_keys"), F.sum(F.when(both, F.col("f")).otherwise(0)).alias("fakes_paired"), F.sum(F.when(~both, F.col("f")).otherwise(0)).alias("fakes_unpaired"))


def error_rates(df: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """n, errors, fn, fp, error_rate, miss_rate (null without fakes)."""
    out = df.groupBy(*by).agg(*_cells(label, pred))
    errors = F.col("fn") + F.col("fp")
    return out.select(*by, "n", errors.alias("errors"), "fn", "fp", (errors / F.col("n")).alias("error_rate"), ratio(F.col("fn"), F.col("fn") + F.col("tp"), None).alias("miss_rate"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """row (0, 1, macro, weighted), precision, recall, f1, support."""
    cells = df.agg(*_cells(label, pred)).select(
        F.inline(F.array(
            F.struct(F.lit("0").alias("row"), F.col("tn").alias("t"), (F.col("tn") + F.col("fn")).alias("called"), (F.col("tn") + F.col("fp")).alias("support")),
            F.struct(F.lit("1").alias("row"), F.col("tp").alias("t"), (F.col("tp") + F.col("fp")).alias("called"), (F.col("tp") + F.col("fn")).alias("support")),
        ))
    )
    each = cells.select("row", ratio(F.col("t"), F.col("called")).alias("precision"), ratio(F.col("t"), F.col("support")).alias("recall"), ratio(2 * F.col("t"), F.col("called") + F.col("support")).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = each.agg(F.lit("macro").alias("row"), *(F.avg(c).alias(c) for c in names), F.sum("support").alias("support"))
    weighted = each.agg(F.lit("weighted").alias("row"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted)


def by_correctness(df: DataFrame, value: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """is_error, n, mean, std (population) of an attribute."""
    wrong = (F.col(label) != F.col(pred)).alias("is_error")
    return df.groupBy(wrong).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def real_report(df: DataFrame, kinds: Mapping[str, Column], label: str = "label", pred: str = "pred") -> DataFrame:
    """kind, value, n, real_acc, false_positives of the real rows by each of ``kinds`` (source, folder, kind of identifier, ...), in one pass."""
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in kinds.items()))
    rows = df.filter(F.col(label) == 0).select(F.inline(each), F.col(pred).alias("_pred"))
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_pred") == 0).cast("double")).alias("real_acc"), F.count_if(F.col("_pred") == 1).alias("false_positives"))
