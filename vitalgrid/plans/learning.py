"""Model queries over the person-wave and epoch tables; rows-only, seeds fixed."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from vitalgrid.functions import text as tx
from vitalgrid.operators import epochs as ep
from vitalgrid.operators import models as md
from vitalgrid.operators import selection as sel
from vitalgrid.operators import waves as ops
from vitalgrid.operators.ordering import with_scalars
from vitalgrid.plans.epochs import nights
from vitalgrid.plans.registry import query
from vitalgrid.plans.signals import STRESS_FEATURES, stress_features
from vitalgrid.plans.epochs import epoched
from vitalgrid.plans.tables import feedback_lines
from vitalgrid.plans.waves import person_waves
from vitalgrid.session import materialize, scratch_dir
from vitalgrid.sources import files
from vitalgrid.sources import tables as src

FOLDS = 3
#: Fixed value: the total score from which a subject counts as screened positive.
SCREENED_FROM = 5
#: Columns of the person-wave row that are no features.
SKIP = ("subject", "wave", "gad7")


def training_table(spark, d):
    """The person-wave rows with all their features, labels, folds by subject and class weights."""
    t = materialize(person_waves(spark, d).withColumn("y", (F.col("gad7") >= SCREENED_FROM).cast("int")), "training")
    cols = ops.numeric_features(t, [*SKIP, "y"])
    folds = sel.folds_by_size(t, "subject", FOLDS).select("subject", F.col("fold").cast("int").alias("fold"))
    out = sel.class_weight(sel.impute_median(t.select(*SKIP, "y", *cols), cols).join(folds, "subject"), "y")
    return materialize(out.withColumn("row_id", F.col("subject") * 4 + F.col("wave")), "training_ready"), cols


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("stability_selection", "M3 M5 M9 T2")
def stability_selection(spark, d):
    t, cols = training_table(spark, d)
    imp = md.importance_by_fold(t, cols, "y", "fold", FOLDS, "weight", 10, "row_id")
    top = sorted(cols, key=lambda c: (-imp[c], cols.index(c)))[:22]
    return frame(spark, [(i, c, imp[c]) for i, c in enumerate(top)], "pos int, feature string, importance double")


@query("recursive_elimination", "M4 M3")
def recursive_elimination(spark, d):
    t, cols = training_table(spark, d)
    keep = md.eliminate(t, cols, "y", "fold", FOLDS, "weight", most=20, least=15, step=6, trees=8, key="row_id")
    return frame(spark, [(i, c) for i, c in enumerate(keep)], "pos int, feature string")


@query("selected_projection", "P20")
def selected_projection(spark, d):
    t, cols = training_table(spark, d)
    imp = md.importance_by_fold(t, cols, "y", "fold", FOLDS, "weight", 10, "row_id")
    best = set(sorted(cols, key=lambda c: (-imp[c], cols.index(c)))[:15])
    keep = [c for c in cols if c in best]
    v = md.masked_projection(t, cols, keep)
    arr = md.vector_to_array("selected")
    return v.select("subject", "wave", *[arr[i].alias(c) for i, c in enumerate(keep)])


@query("tree_grid_search", "M6 M8")
def tree_grid_search(spark, d):
    """Twelve seeded draws of forest parameters on grouped folds, by AUC; the best draw next to its balanced accuracy."""
    t, cols = training_table(spark, d)
    scores = md.forest_search(t, cols, "y", "fold", FOLDS, "weight", "row_id", own_weights=True)
    best = [i for i, auc in enumerate(scores) if auc == max(scores)]
    balanced = dict(zip(best, scores.judged(md.BalancedAccuracy("y"), best)))
    rows = []
    for i, (draw, auc) in enumerate(zip(md.drawn_parameters(md.FOREST_DRAWS), scores)):
        depth = draw["maxDepth"] or md.DEEPEST
        rows.append((draw["numTrees"], depth, draw["minInstancesPerNode"], float(auc), i in balanced, balanced.get(i)))
    return frame(spark, rows, "trees int, depth int, min_rows int, auc double, best boolean, balanced_accuracy double")


@query("balanced_tree_search", "M6 E6")
def balanced_tree_search(spark, d):
    """Four draws scored by balanced accuracy instead."""
    t, cols = training_table(spark, d)
    few = {"numTrees": (20,), "maxDepth": (None, 10, 20), "minInstancesPerNode": (1, 2)}
    scores = md.forest_search(t, cols, "y", "fold", FOLDS, "weight", "row_id", few, 4, md.BalancedAccuracy("y"))
    rows = [(x["maxDepth"] or md.DEEPEST, x["minInstancesPerNode"], float(a)) for x, a in zip(md.drawn_parameters(few, 4), scores)]
    return frame(spark, rows, "depth int, min_rows int, balanced_accuracy double")


@query("elastic_net_models", "M7 E9")
def elastic_net_models(spark, d):
    t, cols = training_table(spark, d)
    inner = FOLDS - 1  # parameters are chosen on the folds left, numbered from 0
    reg, clf = md.elastic_regression(cols, "gad7", "__inner", inner), md.elastic_classifier(cols, "y", "__inner", inner, "weight")
    out = None
    for f in range(FOLDS):
        train = t.where(F.col("fold") != f).withColumn("__inner", F.pmod(F.col("fold") - f - 1, F.lit(FOLDS)).cast("int"))
        test = t.where(F.col("fold") == f)
        scored = md.probability(clf.fit(train).transform(test).withColumnRenamed("prediction", "y_pred"), "p_ge")
        scored = scored.drop("features", "raw", "rawPrediction", "probability")
        part = reg.fit(train).transform(scored).select("subject", "wave", "gad7", "y", F.col("prediction").alias("gad7_pred"), "p_ge")
        out = part if out is None else out.unionByName(part)
    return out


@query("tree_models", "M8")
def tree_models(spark, d):
    t, cols = training_table(spark, d)
    ests = {
        "forest": md.forest("y", 10, weight="weight"),
        "tree": md.tree_classifier("y"),
        "boosted": GBTClassifier(labelCol="y", featuresCol="features", maxIter=5, maxDepth=3, weightCol="scale", seed=md.SEED),
    }
    t = md.positive_scale(t, "y")
    out = None
    for name, e in ests.items():
        row = lambda s, name=name: md.probability(s, "p").select("subject", "wave", F.lit(name).alias("model"), "p")
        p = md.out_of_fold(t, Pipeline(stages=[md.assembler(cols), e]).fit, "fold", FOLDS, row, "row_id")
        out = p if out is None else out.unionByName(p)
    return out


@query("minority_oversampling", "M10")
def minority_oversampling(spark, d):
    t, cols = training_table(spark, d)
    return md.oversample(t.where("fold <> 0"), "row_id", cols, "y")


@query("platt_calibration", "M11 E12")
def platt_calibration(spark, d):
    p = src.predictions(spark, d)
    slope, icept = md.platt(p, "s1", "y")
    z = F.greatest(F.least(slope * F.col("s1") + icept, F.lit(30.0)), F.lit(-30.0))
    return p.where("s1 IS NOT NULL").select("event_id", (1.0 / (1.0 + F.exp(-z))).alias("p"))


@query("out_of_fold_scores", "M12 M5")
def out_of_fold_scores(spark, d):
    t, cols = training_table(spark, d)
    est = Pipeline(stages=[md.assembler(cols), md.forest("y", 10, weight="weight")])
    return md.out_of_fold(t, est.fit, "fold", FOLDS, lambda s: md.probability(s, "p").select("subject", "wave", "fold", "y", "p"), "row_id")


@query("variant_training", "M13 M7 M8 M11 M12 E11 E12 T7 S16 P17")
def variant_training(spark, d):
    t, cols = training_table(spark, d)
    variants = {"hrv_only": [c for c in cols if not c.startswith("sleep_")], "hrv_sleep": cols}
    _, report, columns = md.compare_variants(t, variants, "gad7", "y", "fold", FOLDS, ["subject", "wave"], trees=10)
    path = scratch_dir(spark, "report")
    best = md.chosen_variant(report).select(F.col("variant").alias("inference_use_variant"))
    full = with_scalars(report, best).withColumn("metrics", F.struct(*report.columns[1:]))
    named = columns.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("fold", "pos", "feature"))).alias("columns"))
    full.select("variant", "inference_use_variant", "metrics").join(named, "variant").write.json(path)
    return report.join(named.select("variant", F.size("columns").alias("columns_chosen")), "variant")


@query("text_preference_model", "M14 X23")
def text_preference_model(spark, d):
    ex = files.parse_feedback(feedback_lines(spark, d)).select("conv_id", "turn", "preview", "label")
    m = md.text_preference(ex)
    if m is None:
        f = tx.response_features("preview")
        return ex.select("conv_id", "turn", tx.heuristic_score(f).alias("score"))
    return md.probability(m.transform(ex), "score").select("conv_id", "turn", F.round("score", 3).alias("score"))


@query("night_batch_scores", "M18 W6 A13 W3 W4")
def night_batch_scores(spark, d):
    n = materialize(nights(spark, d), "nights_scored")
    cols = ["hr", "bvp", "ibi_sd"]
    t = ep.rolling_context(ep.deltas(n, cols, "epoch_no"), ["hr"], ["bvp"], 5, "epoch_no")
    feats = [*cols, *[f"Delta_{c}" for c in cols], "Ctx_RMean_hr", "Ctx_RStd_bvp"]
    t = materialize(t.withColumn("awake", 1 - F.col("sleep")), "night_features")
    m = md.scaled(feats, md.forest("awake", 10)).fit(t.where(F.pmod("subject", F.lit(4)) != 0))
    p = md.probability(m.transform(t), "p_wake").withColumn("pred", F.when(F.col("p_wake") >= 0.35, 0).otherwise(1))
    s = ep.median_smooth(p.select("subject", "epoch_no", "p_wake", "pred"), "pred", "epoch_no")
    return ep.sleep_biomarkers(s.withColumn("sleep", F.col("smoothed").cast("int")))


@query("learning_curve", "M16")
def learning_curve(spark, d):
    t, cols = training_table(spark, d)
    rows = md.learning_curve(t, cols, "y", "fold", FOLDS, "row_id", "weight")
    return frame(spark, rows, "share int, auc double")


@query("boosting_early_stop", "M17")
def boosting_early_stop(spark, d):
    t, cols = training_table(spark, d)
    best, _, held = md.boosted_early_stop(t, cols, "y", "row_id", 12)
    return md.probability(held, "p").select("subject", "wave", "y", F.lit(best).alias("trees"), "p")


@query("stress_classifier", "M8 G15 S12")
def stress_classifier(spark, d):
    """Stages of the subjects that the tree was not fitted on, epoch by epoch."""
    t = materialize(stress_features(epoched(spark, d)), "stress")
    v = md.assembler(STRESS_FEATURES).transform(t)
    m = md.tree_classifier("stage").fit(v.where(F.pmod("subject", F.lit(5)) != 0))
    unseen = m.transform(v.where(F.pmod("subject", F.lit(5)) == 0))
    return unseen.select("subject", "epoch_idx", "stage", F.col("prediction").cast("int").alias("predicted"))
