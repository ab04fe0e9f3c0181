"""Metrics over prediction tables: everything works on counts per label, score or bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.scalar import bind
from vitalgrid.operators.ordering import fine_buckets, running_totals, tied_ranks, value_bucket, with_scalars


def confusion(df: DataFrame, y: str, yhat: str, labels: Sequence[int]) -> DataFrame:
    """One row per label with counts and row shares per predicted label; absent labels stay as zeros."""
    counts = df.groupBy(y).agg(*[F.count_if(F.col(yhat) == c).alias(f"p{c}") for c in labels])
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in labels])).alias(y))
    out = grid.join(counts, y, "left").na.fill(0)
    total = sum((F.col(f"p{c}") for c in labels[1:]), F.col(f"p{labels[0]}"))
    return out.select(
        y,
        *[f"p{c}" for c in labels],
        *[(F.col(f"p{c}") / F.greatest(total, F.lit(1))).alias(f"share{c}") for c in labels],
    )


def class_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Support, predicted and hit counts per class from one grouped count of (y, yhat)."""
    pairs = df.groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))
    each = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col(y).alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col(y) == F.col(yhat), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col(yhat).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("c")
    ).select("c.*")
    return each.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])


def _zero_div(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def class_report(counts: DataFrame) -> DataFrame:
    hit, sup, pre = F.col("hit"), F.col("support"), F.col("predicted")
    per = counts.select(
        F.col("label").cast("string").alias("label"),
        _zero_div(hit, pre).alias("precision"),
        _zero_div(hit, sup).alias("recall"),
        _zero_div(2.0 * hit, sup + pre).alias("f1"),
        sup.alias("support"),
    )
    cols = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *cols, "support")
    weighted = per.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")
    ).select(F.lit("weighted avg").alias("label"), *cols, "support")
    return per.unionByName(macro).unionByName(weighted)


def agreement(counts: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy over classes with support, Cohen's kappa."""
    n, hit = F.sum("support"), F.sum("hit")
    po = hit / n
    pe = F.sum(F.col("support").cast("double") * F.col("predicted")) / (n.cast("double") * n)
    balanced = F.avg(F.when(F.col("support") > 0, F.col("hit") / F.col("support")))
    return counts.agg(po.alias("accuracy"), balanced.alias("balanced_accuracy"), F.when(pe != 1, (po - pe) / (1 - pe)).otherwise(0.0).alias("kappa"), n.alias("n"))


def roc_points(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives at every distinct threshold, highest first."""
    keys = list(keys)
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    per = rows.groupBy(*keys, score).agg(F.sum(y).alias("__p"), F.sum(1 - F.col(y)).alias("__q"))
    per = fine_buckets(per, keys, score, "__fine")
    run = running_totals(per, keys, -F.col("__fine"), [F.col(score).desc()], {"tp": F.col("__p"), "fp": F.col("__q")}).drop("__fine")
    totals = rows.groupBy(*keys).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    run = run.withColumns({"tp": F.col("tp").cast("bigint"), "fp": F.col("fp").cast("bigint")})
    joined = run.join(totals, keys) if keys else with_scalars(run, totals)
    return joined.select(*keys, F.col(score).alias("threshold"), "tp", "fp", "pos", "neg")


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    pts = roc_points(df, y, score)
    curve = pts.select("threshold", (F.col("tp") / F.col("pos")).alias("tpr"), (F.col("fp") / F.col("neg")).alias("fpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return start.unionByName(curve)


def auc(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per key from tie-averaged rank sums; null with a single class."""
    keys = list(keys)
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    ranks = tied_ranks(rows, keys, score, {"pos": F.col(y)})
    p, n = F.sum("pos"), F.sum("n")
    u = F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2.0
    value = F.when((p > 0) & (n > p), u / (p.cast("double") * (n - p)))
    return ranks.groupBy(*keys).agg(value.alias("auc"), n.alias("n"), p.alias("pos"))


def youden(df: DataFrame, y: str, score: str) -> DataFrame:
    """Threshold with the largest J, the highest one on ties; (0.5, 0) with a single class."""
    pts = roc_points(df, y, score)
    # compare J in exact integers
    j = F.col("tp") * F.col("neg") - F.col("fp") * F.col("pos")
    best = pts.agg(
        F.max(F.struct(j.alias("j"), "threshold")).alias("b"), F.max("pos").alias("pos"), F.max("neg").alias("neg")
    )
    ok = (F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("b.j") > 0)
    return best.select(
        F.when(ok, F.col("b.threshold")).otherwise(0.5).alias("threshold"),
        F.when(ok, F.col("b.j") / (F.col("pos").cast("double") * F.col("neg"))).otherwise(0.0).alias("j"),
    )


def threshold_sweep(df: DataFrame, y: str, score: str, start: float = 0.30, step: float = 0.01, count: int = 41) -> DataFrame:
    """Balanced accuracy at every grid threshold from one histogram of how many thresholds a score meets."""
    grid = F.array(*[F.lit(start + i * step) for i in range(count)])
    met = bind(F.col(score), lambda s: F.size(F.filter(grid, lambda t: s >= t)))
    hist = df.where(F.col(score).isNotNull()).groupBy(met.alias("met"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    # at most count + 1 bins per label
    per = hist.select(
        "y", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(i.alias("i"), (F.col("met") > i).alias("hit")))).alias("g")
    ).select("y", "n", "g.i", "g.hit")
    hit, miss = F.col("hit"), ~F.col("hit")
    agg = per.groupBy("i").agg(
        F.sum(F.when((F.col("y") == 1) & hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when((F.col("y") == 0) & miss, F.col("n")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"),
    )
    return agg.select(
        (F.lit(start) + F.col("i") * F.lit(step)).alias("threshold"),
        ((F.col("tp") / F.col("p") + F.col("tn") / F.col("q")) / 2.0).alias("balanced_accuracy"),
    )


def best_by(df: DataFrame, value: str, metric: str, default: float) -> DataFrame:
    """First-wins argmax: the smallest grid value among the best."""
    m = F.round(metric, 12)
    best = df.agg(F.max(F.struct(m.alias("m"), (-F.col(value)).alias("v"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.v"), F.lit(default)).alias(value), F.col("b.m").alias(metric))


def spearman(df: DataFrame, x: str, y: str) -> Column:
    """Rank correlation from counts of (x, y) pairs; ranks join on distinct values only."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("c"))
    rx = tied_ranks(rows.select(x), [], x).select(x, F.col("rank").alias("rx"))
    ry = tied_ranks(rows.select(y), [], y).select(y, F.col("rank").alias("ry"))
    j = pairs.join(rx, x).join(ry, y)
    c, a, b = F.col("c"), F.col("rx"), F.col("ry")
    n = F.sum(c)
    mean = (n + 1) / 2.0  # average rank with ties averaged
    s = {k: F.sum(v) for k, v in {"ab": c * a * b, "aa": c * a * a, "bb": c * b * b}.items()}
    cov = s["ab"] - n * mean * mean
    va, vb = s["aa"] - n * mean * mean, s["bb"] - n * mean * mean
    return j.agg(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("spearman"))


def regression_errors(df: DataFrame, y: str, yhat: str) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n")
    )


def reliability_bins(df: DataFrame, y: str, score: str, bins: int = 8) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return df.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(y).alias("observed_rate"), F.count(F.lit(1)).alias("n")
    )


def weight_grid(df: DataFrame, a: str, b: str, steps: int = 21) -> DataFrame:
    """Rows with each blend of two scores; a fixed factor of ``steps``."""
    w = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / F.lit(float(steps - 1))))
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("w", w)
    return rows.withColumn("blend", F.round(F.col("w") * F.col(a) + (1.0 - F.col("w")) * F.col(b), 9))


def normal_tail(z: Column) -> Column:
    """Two-sided normal tail probability by a rational approximation (absolute error below 1e-6)."""
    # Coefficients of the published approximation of the normal distribution function.
    t = 1.0 / (1.0 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2.0 * F.exp(-z * z / 2.0) / 2.5066282746310002 * poly)


def mann_whitney(long: DataFrame, feature: str, value: str, y: str) -> DataFrame:
    """U of the y = 1 group and the tie-corrected two-sided p with continuity correction, per feature."""
    r = tied_ranks(long.where(F.col(value).isNotNull()), [feature], value, {"pos": F.col(y)})
    n, p = F.sum("n"), F.sum("pos")
    q = n - p
    u = F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2.0
    ties = F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n"))
    pq = p.cast("double") * q
    var = pq / 12.0 * ((n + 1) - ties / (n.cast("double") * (n - 1)))
    gap = F.abs(u - pq / 2.0)
    z = F.greatest(gap - 0.5, F.lit(0.0)) / F.sqrt(var)
    return r.groupBy(feature).agg(
        u.alias("u"), F.when(var > 0, normal_tail(z)).otherwise(1.0).alias("p_value"), n.alias("n")
    )


def numbered_by_first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Number of each key by its first appearance."""
    first = df.groupBy(key).agg(F.min(order).alias("__first"))
    run = running_totals(first, [], value_bucket(F.col("__first") + 1), [F.col("__first")], {"no": F.lit(1)})
    return run.select(key, (F.col("no") - 1).cast("bigint").alias("subject_no"))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per class
    total = F.sum("n").over(w)
    k = F.count(F.lit(1)).over(w)
    n0 = F.max(F.when(F.col(y) == 0, F.col("n"))).over(w)
    n1 = F.max(F.when(F.col(y) == 1, F.col("n"))).over(w)
    return counts.select(
        y,
        "n",
        (F.col("n") * 100.0 / total).alias("percent"),
        (n1 / total).alias("prevalence"),
        (n0 / n1).alias("scale_pos_weight"),
        (total / (k * F.col("n"))).alias("balanced_weight"),
    )
