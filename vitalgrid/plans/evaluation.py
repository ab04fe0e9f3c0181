"""Queries over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions import scalar as sc
from vitalgrid.operators import evaluation as ev
from vitalgrid.operators.ordering import with_scalars
from vitalgrid.plans.registry import query
from vitalgrid.plans.tables import stage_code
from vitalgrid.plans.waves import rounded
from vitalgrid.sources import tables as src
from vitalgrid.sources.tables import PREDICTIONS_SQL

LABELS = (0, 1, 2, 3, 4)


def staged(spark, d):
    t = src.table(spark, d, "lineitem")
    flags = F.concat("l_returnflag", "l_linestatus")
    names = {a + b: s for (a, b), s in src.STAGE_NAMES.items()}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    y = stage_code(m[flags])
    rows = t.select(y.alias("y"), F.when(F.col("l_quantity") > 25, y).otherwise(F.pmod("l_partkey", F.lit(4)).cast("int")).alias("yhat"), "l_discount", "l_partkey")
    return rows.where("y <> 5")


STAGED_SQL = """st AS (SELECT y, CAST(CASE WHEN l_quantity > 25 THEN y ELSE l_partkey % 4 END AS INTEGER) AS yhat, l_discount, l_partkey FROM (
  SELECT *, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 0 WHEN 'AO' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 ELSE 5 END AS y FROM lineitem) WHERE y <> 5)"""
COUNTS_SQL = f"""{STAGED_SQL}, cc AS (SELECT label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hit FROM (
  SELECT y AS label, 1 AS s, 0 AS p, CAST(y = yhat AS INTEGER) AS h FROM st UNION ALL SELECT yhat, 0, 1, 0 FROM st) GROUP BY label)"""


@query(
    "confusion_matrix",
    "E1",
    f"""WITH {STAGED_SQL} SELECT y, {", ".join(f"count(CASE WHEN yhat = {c} THEN 1 END) AS p{c}" for c in LABELS)},
    {", ".join(f"round(count(CASE WHEN yhat = {c} THEN 1 END) / greatest(count(*), 1), 6) AS share{c}" for c in LABELS)} FROM st GROUP BY y""",
)
def confusion_matrix(spark, d):
    return rounded(ev.confusion(staged(spark, d), "y", "yhat", LABELS))


@query(
    "class_report",
    "E2",
    f"""WITH {COUNTS_SQL}, per AS (SELECT CAST(label AS VARCHAR) AS label, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall,
      CASE WHEN support + predicted > 0 THEN 2.0 * hit / (support + predicted) ELSE 0.0 END AS f1, support FROM cc)
    SELECT label, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support FROM (SELECT * FROM per
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)""",
)
def class_report(spark, d):
    return rounded(ev.class_report(ev.class_counts(staged(spark, d), "y", "yhat")))


@query(
    "agreement_metrics",
    "E3",
    f"""WITH {COUNTS_SQL}, a AS (SELECT sum(hit) / sum(support) AS po, avg(CASE WHEN support > 0 THEN hit / support END) AS ba, sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS pe, CAST(sum(support) AS BIGINT) AS n FROM cc)
    SELECT round(po, 6) AS accuracy, round(ba, 6) AS balanced_accuracy, round((po - pe) / (1 - pe), 6) AS kappa, n FROM a""",
)
def agreement_metrics(spark, d):
    return rounded(ev.agreement(ev.class_counts(staged(spark, d), "y", "yhat")))


_ROC_SQL = f"""{PREDICTIONS_SQL}, g AS (SELECT s1 AS threshold, sum(y) AS p, sum(1 - y) AS q FROM pred WHERE s1 IS NOT NULL GROUP BY s1),
roc AS (SELECT threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "roc_curve",
    "E4",
    f"WITH {_ROC_SQL} SELECT threshold, round(tp / pos, 6) AS tpr, round(fp / neg, 6) AS fpr FROM roc UNION ALL SELECT NULL, 0.0, 0.0",
)
def roc_curve(spark, d):
    return rounded(ev.roc_curve(src.predictions(spark, d), "y", "s1"))


def _auc_sql(table, score, keys=""):
    part = f"PARTITION BY {keys}" if keys else ""
    more = f"{keys}, " if keys else ""
    return f"""(SELECT {more}CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)) END AS auc, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos
      FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {more}{score}) - 1) / 2.0 AS rk FROM {table} WHERE {score} IS NOT NULL) {'GROUP BY ' + keys if keys else ''})"""


@query("roc_auc", "E5 W18", f"WITH {PREDICTIONS_SQL} SELECT round(auc, 6) AS auc, n, pos FROM {_auc_sql('pred', 's1')}")
def roc_auc(spark, d):
    return rounded(ev.auc(src.predictions(spark, d), "y", "s1"))


@query(
    "one_vs_rest_auc",
    "E5",
    f"""WITH {STAGED_SQL}, lg AS (SELECT c, CAST(y_ = c AS INTEGER) AS y, s FROM (SELECT st.y AS y_, c, round(CASE WHEN yhat = c THEN 0.5 ELSE 0.2 END + l_discount, 4) AS s FROM st, range(0, 5) r(c)))
    SELECT c, round(auc, 6) AS auc, n, pos FROM {_auc_sql('lg', 's', 'c')}""",
)
def one_vs_rest_auc(spark, d):
    t = staged(spark, d)
    per = F.array(
        *[
            F.struct(
                F.lit(c).cast("bigint").alias("c"),
                (F.col("y") == c).cast("int").alias("y"),
                F.round(F.when(F.col("yhat") == c, 0.5).otherwise(0.2) + F.col("l_discount"), 4).alias("s"),
            )
            for c in LABELS
        ]
    )
    return rounded(ev.auc(t.select(F.explode(per).alias("p")).select("p.*"), "y", "s", ["c"]))


@query(
    "youden_threshold",
    "E6 T6",
    f"""WITH {_ROC_SQL} SELECT threshold, round((tp * neg - fp * pos) / (pos::DOUBLE * neg), 6) AS j FROM roc ORDER BY tp * neg - fp * pos DESC, threshold DESC LIMIT 1""",
)
def youden_threshold(spark, d):
    return rounded(ev.youden(src.predictions(spark, d), "y", "s1"))


_SWEEP_SQL = f"""{PREDICTIONS_SQL}, t AS (SELECT 0.3::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(0, 41) r(i)),
sw AS (SELECT threshold, (sum(CASE WHEN y = 1 AND s2 >= threshold THEN 1 ELSE 0 END) / sum(y) + sum(CASE WHEN y = 0 AND s2 < threshold THEN 1 ELSE 0 END) / sum(1 - y)) / 2.0 AS ba FROM pred, t GROUP BY threshold)"""


@query("threshold_sweep", "E7 J11", f"WITH {_SWEEP_SQL} SELECT round(threshold, 6) AS threshold, round(ba, 6) AS balanced_accuracy FROM sw")
def threshold_sweep(spark, d):
    return rounded(ev.threshold_sweep(src.predictions(spark, d), "y", "s2"))


@query(
    "best_threshold",
    "E7 T6",
    f"WITH {_SWEEP_SQL} SELECT round(threshold, 6) AS threshold, round(ba, 6) AS balanced_accuracy FROM sw ORDER BY round(ba, 12) DESC, threshold LIMIT 1",
)
def best_threshold(spark, d):
    return rounded(ev.best_by(ev.threshold_sweep(src.predictions(spark, d), "y", "s2"), "threshold", "balanced_accuracy", 0.5))


@query(
    "fixed_threshold_labels",
    "E7 E14",
    f"WITH {PREDICTIONS_SQL} SELECT event_id, CASE WHEN s1 IS NULL THEN NULL WHEN s1 >= 0.35 THEN 1 ELSE 0 END AS y_pred FROM pred",
)
def fixed_threshold_labels(spark, d):
    p = src.predictions(spark, d)
    return p.select("event_id", F.when(F.col("s1").isNotNull(), (F.col("s1") >= 0.35).cast("int")).alias("y_pred"))


@query(
    "regression_errors",
    "E8 W18",
    f"""WITH {PREDICTIONS_SQL}, p AS (SELECT gad7, s2 * 18.37 AS yhat FROM pred),
    r AS (SELECT *, rank() OVER (ORDER BY gad7) + (count(*) OVER (PARTITION BY gad7) - 1) / 2.0 AS ra, rank() OVER (ORDER BY yhat) + (count(*) OVER (PARTITION BY yhat) - 1) / 2.0 AS rb FROM p)
    SELECT round(avg(abs(gad7 - yhat)), 6) AS mae, round(sqrt(avg((gad7 - yhat) * (gad7 - yhat))), 6) AS rmse, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r""",
)
def regression_errors(spark, d):
    p = src.predictions(spark, d).select("gad7", (F.col("s2") * 18.37).alias("yhat"))
    return rounded(with_scalars(ev.regression_errors(p, "gad7", "yhat"), ev.spearman(p, "gad7", "yhat")))


@query(
    "fold_metrics",
    "E9 F7",
    f"""WITH {PREDICTIONS_SQL}, f AS {_auc_sql('pred', 's1', 'fold')} SELECT round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std, count(auc) AS valid_folds FROM f""",
)
def fold_metrics(spark, d):
    f = ev.auc(src.predictions(spark, d), "y", "s1", ["fold"])
    return rounded(f.agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.count("auc").alias("valid_folds")))


@query(
    "reliability_bins",
    "E10",
    f"WITH {PREDICTIONS_SQL} SELECT CAST(least(floor(s2 * 8), 7) AS BIGINT) AS bin, round(avg(s2), 6) AS mean_score, round(avg(y), 6) AS observed_rate, count(*) AS n FROM pred WHERE s2 IS NOT NULL GROUP BY 1",
)
def reliability_bins(spark, d):
    t = ev.reliability_bins(src.predictions(spark, d), "y", "s2")
    return rounded(t.withColumn("bin", F.col("bin").cast("bigint")))


_GRID_SQL = f"""{PREDICTIONS_SQL}, wg AS (SELECT i / 20.0::DOUBLE AS w, y, gad7, round(i / 20.0::DOUBLE * s1 + (1.0 - i / 20.0::DOUBLE) * s2, 9) AS blend FROM pred, range(0, 21) r(i) WHERE s1 IS NOT NULL)"""


@query(
    "ensemble_weight_auc",
    "E11 J11 T6",
    f"WITH {_GRID_SQL}, a AS {_auc_sql('wg', 'blend', 'w')} SELECT round(w, 6) AS w, round(auc, 6) AS auc FROM a ORDER BY round(auc, 12) DESC, w LIMIT 1",
)
def ensemble_weight_auc(spark, d):
    g = ev.weight_grid(src.predictions(spark, d), "s1", "s2")
    return rounded(ev.best_by(ev.auc(g, "y", "blend", ["w"]), "w", "auc", 0.5))


@query(
    "ensemble_weight_mae",
    "E11 J11",
    f"WITH {_GRID_SQL}, a AS (SELECT w, avg(abs(gad7 - 18.37 * blend)) AS mae FROM wg GROUP BY w) SELECT round(w, 6) AS w, round(mae, 6) AS mae FROM a ORDER BY round(mae, 12), w LIMIT 1",
)
def ensemble_weight_mae(spark, d):
    # 21 sums in one aggregate: no copy of the rows
    p = src.predictions(spark, d).where("s1 IS NOT NULL AND s2 IS NOT NULL")
    ws = [i / 20.0 for i in range(21)]
    maes = [F.avg(F.abs(F.col("gad7") - 18.37 * F.round(F.lit(w) * F.col("s1") + F.lit(1.0 - w) * F.col("s2"), 9))) for w in ws]
    arr = p.agg(F.array(*[F.struct(F.round(m, 12).alias("m"), F.lit(w).alias("w")) for m, w in zip(maes, ws)]).alias("a"))
    best = F.array_min("a")
    return rounded(arr.select(best["w"].alias("w"), best["m"].alias("mae")))


@query(
    "calibrated_score",
    "E12 X30 X31",
    f"""WITH {PREDICTIONS_SQL}, b AS (SELECT event_id, 0.35 * s1 + 0.65 * s2 AS raw, 0.35 * (s1 * 23.7 / 1.37) + 0.65 * gad7 * 1.0301 AS g FROM pred WHERE s1 IS NOT NULL)
    SELECT event_id, round(least(greatest(g, 0), 21), 4) AS predicted_gad7, round(1 / (1 + exp(-least(greatest(3.17 * raw - 1.13, -30), 30))), 6) AS probability, 1 / (1 + exp(-least(greatest(3.17 * raw - 1.13, -30), 30))) >= 0.511 AS screened FROM b""",
)
def calibrated_score(spark, d):
    p = src.predictions(spark, d).where("s1 IS NOT NULL")
    raw = sc.blend(F.col("s1"), F.col("s2"), 0.35)
    g = sc.blend(F.col("s1") * 23.7 / 1.37, F.col("gad7") * 1.0301, 0.35)
    prob = sc.sigmoid(3.17 * raw - 1.13)
    return p.select(
        "event_id", F.round(sc.clamp(g, 0, 21), 4).alias("predicted_gad7"), F.round(prob, 6).alias("probability"), (prob >= 0.511).alias("screened")
    )


def feature_long(spark, d):
    t = src.table(spark, d, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("y")
    cols = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    const = F.struct(F.lit("constant").alias("feature"), F.lit(1.0).alias("v"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in cols], const)
    return t.select(y, F.explode(pairs).alias("p")).select("y", "p.feature", "p.v")


_MW_SQL = """lg AS (SELECT y, feature, v FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, l_quantity, l_extendedprice, l_discount, l_tax, 1.0::DOUBLE AS constant FROM lineitem)
  UNPIVOT (v FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax, constant))),
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY feature, v) AS ties FROM lg),
mw AS (SELECT feature, sum(CASE WHEN y = 1 THEN rk END) - sum(y)::DOUBLE * (sum(y) + 1) / 2.0::DOUBLE AS u, sum(y)::DOUBLE * sum(1 - y) AS pq, count(*)::DOUBLE AS n, sum(ties::DOUBLE * ties - 1) AS tc FROM rk GROUP BY feature),
mv AS (SELECT feature, u, n, pq / 12.0 * ((n + 1) - tc / (n * (n - 1))) AS var, abs(u - pq / 2.0) AS gap FROM mw),
mz AS (SELECT *, CASE WHEN var > 1e-6 THEN greatest(gap - 0.5, 0) / sqrt(var) END AS z FROM mv),
mp AS (SELECT feature, u, CAST(n AS BIGINT) AS n, CASE WHEN z IS NULL THEN 1.0 ELSE least(1.0, 2.0 * exp(-z * z / 2.0) / 2.5066282746310002 * (1 / (1 + 0.2316419 * z)) * (0.319381530 + (1 / (1 + 0.2316419 * z)) * (-0.356563782 + (1 / (1 + 0.2316419 * z)) * (1.781477937 + (1 / (1 + 0.2316419 * z)) * (-1.821255978 + (1 / (1 + 0.2316419 * z)) * 1.330274429))))) END::DOUBLE AS p FROM mz)"""


@query("mann_whitney", "E13 W18", f"WITH {_MW_SQL} SELECT feature, round(u, 1) AS u, round(p, 6) AS p_value, n FROM mp")
def mann_whitney(spark, d):
    t = ev.mann_whitney(feature_long(spark, d), "feature", "v", "y")
    return t.select("feature", F.round("u", 1).alias("u"), F.round("p_value", 6).alias("p_value"), "n")


@query(
    "discriminative_features",
    "T3 E13",
    f"WITH {_MW_SQL} SELECT feature, round(p, 6) AS p_value, (SELECT count(*) FROM mp WHERE round(p, 6) > 0.05) AS not_significant FROM mp ORDER BY round(p, 6), feature LIMIT 20",
)
def discriminative_features(spark, d):
    t = ev.mann_whitney(feature_long(spark, d), "feature", "v", "y").select("feature", F.round("p_value", 6).alias("p_value"))
    weak = t.agg(F.count_if(F.col("p_value") > 0.05).alias("not_significant"))
    return with_scalars(t.orderBy("p_value", "feature").limit(20), weak)


@query(
    "subject_errors",
    "E15",
    f"""WITH {PREDICTIONS_SQL} SELECT subject_no, count(*) AS n, round(avg(gad7), 6) AS mean_true, round(avg(s2 * 18.37), 6) AS mean_pred, round(avg(abs(gad7 - s2 * 18.37)), 6) AS mae
    FROM pred JOIN (SELECT subject, row_number() OVER (ORDER BY min(event_id)) - 1 AS subject_no FROM pred GROUP BY subject) USING (subject) GROUP BY subject_no""",
)
def subject_errors(spark, d):
    p = src.predictions(spark, d)
    no = ev.numbered_by_first_seen(p, "subject", "event_id")
    per = p.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("gad7").alias("mean_true"),
        F.avg(F.col("s2") * 18.37).alias("mean_pred"),
        F.avg(F.abs(F.col("gad7") - F.col("s2") * 18.37)).alias("mae"),
    )
    return rounded(per.join(no, "subject").drop("subject"))


@query(
    "class_balance",
    "A8 M9",
    f"""WITH {PREDICTIONS_SQL}, c AS (SELECT y, count(*) AS n FROM pred GROUP BY y) SELECT y, n, round(n * 100.0 / sum(n) OVER (), 6) AS percent, round(max(CASE WHEN y = 1 THEN n END) OVER () / sum(n) OVER (), 6) AS prevalence,
    round(max(CASE WHEN y = 0 THEN n END) OVER () / max(CASE WHEN y = 1 THEN n END) OVER (), 6) AS scale_pos_weight, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS balanced_weight FROM c""",
)
def class_balance(spark, d):
    return rounded(ev.class_balance(src.predictions(spark, d), "y"))


@query(
    "variant_choice",
    "T7 T6",
    f"""WITH {PREDICTIONS_SQL}, a AS (SELECT 'hrv_only' AS variant, auc FROM {_auc_sql('pred', 's1')} UNION ALL SELECT 'hrv_sleep', auc FROM {_auc_sql('pred', 's2')}),
    m AS (SELECT 'hrv_only' AS variant, avg(abs(gad7 - 18.37 * s1)) AS mae FROM pred UNION ALL SELECT 'hrv_sleep', avg(abs(gad7 - 18.37 * s2)) FROM pred)
    SELECT variant, round(auc, 6) AS auc, round(mae, 6) AS mae FROM a JOIN m USING (variant) ORDER BY auc DESC NULLS LAST, mae LIMIT 1""",
)
def variant_choice(spark, d):
    p = src.predictions(spark, d)
    both = F.explode(
        F.array(*[F.struct(F.lit(v).alias("variant"), F.col(c).alias("s")) for v, c in (("hrv_only", "s1"), ("hrv_sleep", "s2"))])
    )
    long = p.select("y", "gad7", both.alias("v")).select("y", "gad7", "v.*")
    a = ev.auc(long, "y", "s", ["variant"]).select("variant", "auc")
    m = long.groupBy("variant").agg(F.avg(F.abs(F.col("gad7") - 18.37 * F.col("s"))).alias("mae"))
    best = a.join(m, "variant").agg(F.max_by(F.struct("variant", "auc", "mae"), F.struct(F.coalesce("auc", F.lit(-1.0)), -F.col("mae"))).alias("b"))
    return rounded(best.select("b.*"))
