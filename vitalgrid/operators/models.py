"""Feature selection, model fitting and out-of-fold scoring with Spark ML.

Driver loops run over folds, candidates and column lists, never over rows.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators import evaluation as ev
from vitalgrid.operators import forests
from vitalgrid.operators.ordering import join_per_key, row_index, with_scalars
from vitalgrid.operators.retrieval import nearest
from vitalgrid.operators.selection import class_weight, correlation_kept, hash_part, low_variance_kept
from vitalgrid.session import materialize

SEED = 42


def assembler(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep")


def forest(label: str, trees: int = 20, depth: int = 6, weight: str | None = None, features: str = "features"):
    kw = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(
        labelCol=label, featuresCol=features, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=SEED, **kw
    )


def forest_regressor(label: str, trees: int = 20, depth: int = 6, features: str = "features"):
    return RandomForestRegressor(labelCol=label, featuresCol=features, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=SEED)


def scaled(columns: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[assembler(columns, "raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator])


def elastic_regression(columns: Sequence[str], label: str, fold: str, folds: int) -> CrossValidator:
    """Standardized elastic-net regression with an inner search over given folds."""
    est = LinearRegression(labelCol=label, featuresCol="features", maxIter=50)
    grid = ParamGridBuilder().addGrid(est.elasticNetParam, [0.3, 0.8]).addGrid(est.regParam, [0.05, 0.5]).build()
    return CrossValidator(
        estimator=scaled(columns, est), estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="mae"),
        numFolds=folds, foldCol=fold, parallelism=4, seed=SEED,
    )


def elastic_classifier(columns: Sequence[str], label: str, fold: str, folds: int, weight: str) -> CrossValidator:
    est = LogisticRegression(labelCol=label, featuresCol="features", weightCol=weight, maxIter=50)
    grid = ParamGridBuilder().addGrid(est.elasticNetParam, [0.3, 0.8]).addGrid(est.regParam, [0.01, 0.1]).build()
    return CrossValidator(
        estimator=scaled(columns, est), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label),
        numFolds=folds, foldCol=fold, parallelism=4, seed=SEED,
    )


class BalancedAccuracy(Evaluator):
    """Mean recall of the classes that occur, from one aggregate of (label, hits) counts."""

    def __init__(self, label: str, prediction: str = "prediction") -> None:
        super().__init__()
        self.label, self.prediction = label, prediction

    def grouped(self, dataset: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The score of every key's rows."""
        hit = (F.col(self.label).cast("double") == F.col(self.prediction)).cast("double")
        recalls = dataset.where(F.col(self.label).isNotNull()).groupBy(*keys, self.label).agg(F.avg(hit).alias("r"))
        return recalls.groupBy(*keys).agg(F.avg("r").alias("score"))

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.grouped(dataset, []).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


class RocArea(BalancedAccuracy):
    """Area under the ROC curve of the positive class's votes, of all distinct ones; with a single class nought or one."""

    def grouped(self, dataset: DataFrame, keys: Sequence[str]) -> DataFrame:
        rows = dataset.select(*keys, (F.col(self.label) > 0.5).cast("int").alias("__y"), vector_to_array("rawPrediction")[1].alias("__s"))
        alone = F.when(F.col("pos") == 0, 0.0).otherwise(1.0)
        return ev.auc(rows, "__y", "__s", keys).select(*keys, F.coalesce("auc", alone).alias("score"))


# What the forest's parameters are drawn from, and how many draws are tried.
FOREST_DRAWS = {"numTrees": (100, 200, 300), "maxDepth": (4, 5, 6, 8, 10, None), "minInstancesPerNode": (1, 2, 4)}
DRAWS = 12
#: Stands for no limit of depth in the rows of a search.
DEEPEST = 30


def drawn_parameters(draws: dict[str, Sequence], n: int = DRAWS, seed: int = SEED) -> list[dict]:
    """n different combinations of the listed values, in a seeded random order; all of them if there are fewer."""
    every = [dict(zip(draws, values)) for values in itertools.product(*draws.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


#: Rows of a task that fits forests, and forests fitted at a time.
ROWS_PER_FIT, FITS_AT_ONCE = 1 << 16, 6


def side_by_side(spark: SparkSession, do: Callable, jobs: Sequence) -> list:
    """What ``do`` gives for every job, in order, a few of them at a time: small fits leave most cores idle alone."""
    with ThreadPool(max(1, min(FITS_AT_ONCE, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(do), jobs, chunksize=1)


def few_parts(df: DataFrame, key: str | Sequence[str], rows: int = ROWS_PER_FIT) -> DataFrame:
    """The rows in one partition per so many rows, ordered by a unique key, so fits repeat themselves.

    Every task of a forest sends statistics of all open nodes, however few rows it has; deep trees have about as many
    nodes as rows, so more partitions than needed multiply that.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.repartition(df.count() // rows + 1, *keys).sortWithinPartitions(*keys)


@contextmanager
def held(df: DataFrame, key: str | Sequence[str] | None):
    """The rows kept for several fits, in few partitions; as they are without a unique key."""
    rows = df if key is None else few_parts(df, key).persist()
    try:
        yield rows
    finally:
        if key is not None:
            rows.unpersist()


class Searched(list):
    """The score of every draw, in order.

    best: place of the first best one. scored: (draw, fold, label, rawPrediction, prediction) of all draws' held-out rows.
    nodes: the best draw's forest, fitted on all rows (see ``forests.fitted_nodes``); columns are numbered as given.
    """

    def __init__(self, scores: Sequence[float], best: int, label: str, folds: int, scored: DataFrame, nodes: DataFrame) -> None:
        super().__init__(scores)
        self.best, self.label, self.folds, self.scored, self.nodes = best, label, folds, scored, nodes

    def judged(self, evaluator: Evaluator, draws: Sequence[int]) -> list[float]:
        """Mean score over the folds of some draws' held-out rows."""
        return mean_scores(self.scored, evaluator, draws, self.folds)


def mean_scores(scored: DataFrame, evaluator: Evaluator, draws: Sequence[int], folds: int) -> list[float]:
    """Mean score over the folds of each draw; one plan for all where the evaluator can, as the driver keeps what plans compile to."""
    if hasattr(evaluator, "grouped"):
        found = {(r["draw"], r["fold"]): r["score"] for r in evaluator.grouped(scored.where(F.col("draw").isin(list(draws))), ["draw", "fold"]).collect()}
        return [sum(found.get((m, f)) or 0.0 for f in range(folds)) / folds for m in draws]
    jobs = [(m, f) for m in draws for f in range(folds)]
    one = lambda job: evaluator.evaluate(scored.where((F.col("draw") == job[0]) & (F.col("fold") == job[1])))
    found = dict(zip(jobs, side_by_side(scored.sparkSession, one, jobs)))
    return [sum(found[m, f] for f in range(folds)) / folds for m in draws]


def forest_search(
    df: DataFrame, columns: Sequence[str], label: str, fold: str, folds: int, weight: str, key: str,
    draws: dict[str, Sequence] | None = None, n: int = DRAWS, evaluator: Evaluator | None = None, own_weights: bool = False,
) -> Searched:
    """Random search over forest parameters on given folds: each draw's mean AUC, or score by the evaluator given.

    Every draw's forest of every fold is grown on the rows outside the fold and judged on the fold; the best draw's forest is
    then fitted on all rows. Trees are grown in tasks and stay there. No depth is no limit. own_weights: classes are weighted
    in the sample of each tree ("balanced_subsample") instead of by the rows' weights.
    """
    if unknown := set(draws or FOREST_DRAWS) - set(FOREST_DRAWS):
        raise ValueError(f"no forest parameters that can be drawn: {sorted(unknown)}")
    judge = evaluator or RocArea(label)
    found = [forests.Draw(d.get("numTrees", 20), d.get("maxDepth", 6), d.get("minInstancesPerNode", 2)) for d in drawn_parameters(draws or FOREST_DRAWS, n)]
    rows = df.select(*dict.fromkeys([key, label, weight, fold, *columns]))
    # rows of one key in a fixed order as well
    parts = few_parts(rows, key).sortWithinPartitions(key, F.xxhash64(*rows.columns))
    given = forests.coded(parts, columns, label, weight, fold, folds)
    scored = materialize(forests.held_out_votes(given, found, own_weights, SEED).withColumnRenamed("label", label), "forest_scores")
    scores = mean_scores(scored, judge, range(len(found)), folds)
    best = scores.index(max(scores) if judge.isLargerBetter() else min(scores))
    nodes = materialize(forests.fitted_nodes(given, found[best], own_weights, SEED), "best_forest")
    return Searched(scores, best, label, folds, scored, nodes)


class ColumnSelector(Estimator):
    """Chooses columns from the rows it is fitted on, and from no others.

    Columns without variance go first, then of every close pair the one further from the label; if more than ``most`` are
    left, those least important to forests over the inner folds go step by step.
    """

    def __init__(
        self, columns: Sequence[str], label: str, binary: str, fold: str, weight: str, most: int = 22, least: int = 12,
        trees: int = 20, features: str = "features", key: str | None = None,
    ) -> None:
        super().__init__()
        self.columns, self.label, self.binary, self.fold, self.weight = list(columns), label, binary, fold, weight
        self.most, self.least, self.trees, self.features, self.key = most, least, trees, features, key

    def _fit(self, dataset: DataFrame) -> SelectedColumns:
        kept = low_variance_kept(dataset, self.columns)
        kept = correlation_kept(dataset, kept, self.label)
        if len(kept) > self.most:
            inner = sorted(r[0] for r in dataset.select(self.fold).distinct().collect())  # one row per fold
            numbered = dataset.withColumn("__inner", F.array_position(F.array(*map(F.lit, inner)), F.col(self.fold)) - 1)
            step = max(1, -(-(len(kept) - self.least) // 2))
            kept = eliminate(
                numbered, kept, self.binary, "__inner", len(inner), self.weight, self.most, self.least, step, self.trees, self.key
            )
        return SelectedColumns(kept, self.features)


class SelectedColumns(Model):
    """The chosen columns as a vector."""

    def __init__(self, kept: Sequence[str], features: str) -> None:
        super().__init__()
        self.kept, self.features = list(kept), features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return assembler(self.kept, self.features).transform(dataset)


def importance_by_fold(
    df: DataFrame, columns: Sequence[str], label: str, fold: str, folds: int, weight: str, trees: int = 20, key: str | None = None
) -> dict[str, float]:
    """Mean forest importance over the training parts of the folds, fitted side by side.

    With a unique ``key`` the rows lie in few partitions in its order, so the forests repeat themselves.
    """
    with held(df.select(*dict.fromkeys([*([key] if key else []), label, fold, weight, *columns])), key) as rows:
        vec = assembler(columns).transform(rows)
        fit = lambda f: forest(label, trees=trees, weight=weight).fit(vec.where(F.col(fold) != f)).featureImportances.toArray()
        parts = side_by_side(df.sparkSession, fit, range(folds))
    return {c: sum(float(p[i]) for p in parts) / max(1, folds) for i, c in enumerate(columns)}


def stability_top(
    df: DataFrame, columns: Sequence[str], label: str, fold: str, folds: int, weight: str, k: int = 22, trees: int = 20, key: str | None = None
) -> list[str]:
    if folds < 2:
        return list(columns)
    imp = importance_by_fold(df, columns, label, fold, folds, weight, trees, key)
    return sorted(columns, key=lambda c: (-imp[c], list(columns).index(c)))[:k]


def eliminate(
    df: DataFrame, columns: Sequence[str], label: str, fold: str, folds: int, weight: str, most: int = 22, least: int = 12, step: int | None = None,
    trees: int = 20, key: str | None = None,
) -> list[str]:
    """Recursive elimination: drop the least important columns, keep the size with the best fold AUC.

    The forests of a round, one per fold and one for the importances, are fitted side by side on rows that are held.
    """
    cols = list(columns)
    if len(cols) <= most:
        return cols
    step = step or max(1, min(3, len(cols) // 25))
    best, best_auc = cols, -1.0
    with held(df.select(*dict.fromkeys([*([key] if key else []), label, fold, weight, *cols])), key) as rows:
        while True:
            vec, last = assembler(cols).transform(rows), len(cols) <= least

            def fitted(f: int | None, vec=vec):
                if f is None:
                    return forest(label, trees=trees, weight=weight).fit(vec).featureImportances.toArray()
                m = forest(label, trees=trees, weight=weight).fit(vec.where(F.col(fold) != f))
                return BinaryClassificationEvaluator(labelCol=label).evaluate(m.transform(vec.where(F.col(fold) == f)))

            found = side_by_side(df.sparkSession, fitted, [*([] if last else [None]), *range(folds)])
            auc = sum(found[-folds:]) / folds
            if auc >= best_auc:
                best, best_auc = cols, auc
            if last:
                break
            imp = dict(zip(cols, found[0]))
            drop = min(step, len(cols) - least)
            gone = set(sorted(cols, key=lambda c: imp[c])[:drop])
            cols = [c for c in cols if c not in gone]
    return best if len(best) <= most else stability_top(df, best, label, fold, folds, weight, most, trees, key)


def masked_projection(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Vector column cut to the kept columns."""
    idx = [list(columns).index(c) for c in keep]
    return VectorSlicer(inputCol="features", outputCol="selected", indices=idx).transform(assembler(columns).transform(df))


def probability(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def out_of_fold(df: DataFrame, fit: Callable, fold: str, folds: int, read: Callable, key: str | None = None) -> DataFrame:
    """Predictions for each fold by a model that never saw it; the models are fitted side by side."""
    with held(df, key) as rows:
        models = side_by_side(df.sparkSession, lambda f: fit(rows.where(F.col(fold) != f)), range(folds))
    parts = None
    for f, model in enumerate(models):
        scored = read(model.transform(df.where(F.col(fold) == f)))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a balanced one-feature logistic fit; identity below the minimum support."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    n, kinds = rows.agg(F.count(F.lit(1)), F.count_distinct(label)).first()
    if n < 5 or kinds < 2:
        return 1.0, 0.0
    w = class_weight(rows, label, "__w")
    m = LogisticRegression(labelCol=label, featuresCol="__f", weightCol="__w", maxIter=100).fit(assembler([score], "__f").transform(w))
    return float(m.coefficients[0]), float(m.intercept)


def oversample(df: DataFrame, key: str, columns: Sequence[str], label: str, k: int = 5) -> DataFrame:
    """Minority rows plus interpolated copies towards hash-chosen same-class neighbours, up to class balance.

    Neighbour search runs in blocks; interpolation is a join of a row with one of its neighbours.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    small, large = sorted(sizes, key=lambda c: sizes[c])[0], max(sizes.values())
    minority = df.where(F.col(label) == small)
    need = large - sizes[small]
    if need <= 0 or sizes[small] < 2:
        return df.select(key, label, *columns)
    k = min(k, sizes[small] - 1)
    vec = minority.select(F.col(key).cast("bigint").alias("__k"), F.array(*[F.col(c).cast("double") for c in columns]).alias("__v"))
    near = nearest(vec, "__k", "__v", vec.select(F.col("__k").alias("__n"), F.col("__v").alias("__e")), "__n", "__e", k + 1, metric="distance")
    near = near.where(F.col("__k") != F.col("__n"))
    each, extra = divmod(need, sizes[small])
    # the first rows by hash get one copy more, so the classes balance exactly
    h = F.xxhash64("__k")
    numbered = row_index(vec.select("__k"), [], F.pmod(h, F.lit(4096)), [F.pmod(h, F.lit(4096)), F.col("__k")], "__i")
    count = F.lit(each) + F.when(F.col("__i") < extra, 1).otherwise(0)
    copies = numbered.where(count > 0).select("__k", F.explode(F.sequence(F.lit(1), count)).alias("__c"))
    pick = copies.withColumn("__h", F.pmod(F.xxhash64("__k", "__c"), F.lit(1_000_003)))
    chosen = near.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("rank", "__n"))).alias("__near"))  # k neighbours per row
    pick = pick.join(chosen, "__k").withColumn("__n", F.element_at("__near", (F.pmod("__h", F.size("__near")) + 1).cast("int"))["__n"])
    pair = pick.join(vec.select("__k", "__v"), "__k").join(vec.select(F.col("__k").alias("__n"), F.col("__v").alias("__e")), "__n")
    t = (F.col("__h") % 1000) / 1000.0
    mixed = pair.select(
        F.concat_ws(":", F.lit("copy"), "__k", "__c").alias("__id"),
        F.zip_with("__v", "__e", lambda a, b: a + (b - a) * t).alias("__m"),
    )
    synth = mixed.select(F.col("__id").alias(key), F.lit(small).alias(label), *[F.get("__m", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    real = df.select(F.col(key).cast("string").alias(key), label, *[F.col(c).cast("double").alias(c) for c in columns])
    return real.unionByName(synth)


def boosted_early_stop(df: DataFrame, columns: Sequence[str], label: str, key: str, rounds: int = 20) -> tuple[int, object, DataFrame]:
    """Boosting stopped on a 15 % hold-out of each class, then refit on all rows with that many trees.

    Rows of a class are ordered by a hash of their key; every class gives the first 15 % of its order. Returns the number
    of trees, the refitted model, and the hold-out scored by the first model, which has not seen it.
    """
    order = F.xxhash64(key)
    placed = row_index(df, [label], F.shiftright(order, 52), [order, F.col(key)], "__place")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    held = join_per_key(placed, sizes, [label], key).withColumn("__hold", F.col("__place") < F.floor(0.15 * F.col("__size")))
    vec = assembler(columns).transform(held)
    first = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=3, stepSize=0.3, validationIndicatorCol="__hold", validationTol=0.01, seed=SEED).fit(vec)
    best = first.getNumTrees
    final = GBTClassifier(labelCol=label, featuresCol="features", maxIter=best, maxDepth=3, stepSize=0.3, seed=SEED).fit(vec)
    return best, final, first.transform(vec.where("__hold"))


def positive_scale(df: DataFrame, y: str, name: str = "scale") -> DataFrame:
    """Weights of boosting on unbalanced classes: negatives over positives for a positive row, else one."""
    share = df.agg((F.sum(1 - F.col(y)) / F.nullif(F.sum(y), F.lit(0))).alias("__share"))
    return with_scalars(df, share).withColumn(name, F.when(F.col(y) == 1, F.coalesce("__share", F.lit(1.0))).otherwise(1.0)).drop("__share")


def tree_classifier(label: str, depth: int = 10):
    return DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=depth, seed=SEED)


def text_preference(examples: DataFrame, text: str = "preview", label: str = "label", least: int = 20):
    """Unigram and bigram weights with a logistic model; None below the minimum number of examples."""
    n = examples.limit(least).count()
    if n < least:
        return None
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__t", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        NGram(n=2, inputCol="__t", outputCol="__b"),
        SQLTransformer(statement="SELECT *, concat(__t, __b) AS __g FROM __THIS__"),
        CountVectorizer(inputCol="__g", outputCol="__c", vocabSize=500),
        IDF(inputCol="__c", outputCol="features"),
        LogisticRegression(labelCol=label, featuresCol="features", maxIter=50, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(examples)


def learning_curve(df: DataFrame, columns: Sequence[str], label: str, fold: str, folds: int, key: str, weight: str) -> list[tuple[int, float]]:
    """Mean fold AUC when training on growing hash samples of the training part."""
    vec = assembler(columns).transform(df)
    out = []
    for share in (25, 50, 75, 100):
        aucs = []
        for f in range(folds):
            train = vec.where((F.col(fold) != f) & (hash_part(F.col(key), 100) < share))
            m = forest(label, trees=10, weight=weight).fit(train)
            aucs.append(BinaryClassificationEvaluator(labelCol=label).evaluate(m.transform(vec.where(F.col(fold) == f))))
        out.append((share, sum(aucs) / len(aucs)))
    return out


def fold_scores(df: DataFrame, columns: Sequence[str], label: str, binary: str, fold: str, folds: int, keep: Sequence[str], trees: int, most: int) -> tuple[DataFrame, list[list[str]]]:
    """Scores of four models on every fold, each fold with its own selection of columns, and the columns chosen.

    Selection and models see the other folds only; the scaler is part of the models.
    """
    models = {
        "s_en": LinearRegression(labelCol=label, featuresCol="features", elasticNetParam=0.5, regParam=0.1, maxIter=50),
        "s_rf": forest_regressor(label, trees),
        "p_en": LogisticRegression(labelCol=binary, featuresCol="features", elasticNetParam=0.5, regParam=0.05, weightCol="weight", maxIter=50),
        "p_rf": forest(binary, trees, weight="weight"),
    }

    def one(f: int) -> tuple[list[str], Pipeline, dict]:
        with held(df.where(F.col(fold) != f), keep) as train:
            picked = ColumnSelector(columns, label, binary, fold, "weight", most, min(12, most), trees, "raw").fit(train)
            scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
            base = Pipeline(stages=[picked, scaler]).fit(train)
            seen = base.transform(train)
            return picked.kept, base, {name: est.fit(seen) for name, est in models.items()}

    parts, chosen = None, []
    for f, (kept, base, fits) in enumerate(side_by_side(df.sparkSession, one, range(folds))):
        chosen.append(kept)
        scored = base.transform(df.where(F.col(fold) == f))
        for name, fit in fits.items():
            out = fit.transform(scored)
            value = F.col("prediction") if name[0] == "s" else vector_to_array("probability")[1]
            scored = out.withColumn(name, value).drop("prediction", "rawPrediction", "probability")
        part = scored.select(*keep, label, binary, *models)
        parts = part if parts is None else parts.unionByName(part)
    return parts, chosen


def compare_variants(
    df: DataFrame, variants: dict[str, list[str]], label: str, binary: str, fold: str, folds: int, keep: Sequence[str],
    trees: int = 20, most: int = 22,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Out-of-fold ensemble of linear and forest models per variant, columns selected inside every fold.

    Returns the scores, one report row per variant, and the columns chosen (variant, fold, pos, feature).
    """
    spark = df.sparkSession
    weighted = df if "weight" in df.columns else class_weight(df, binary, "weight")

    def one(name: str) -> tuple[tuple, DataFrame, list[list[str]]]:
        cols = variants[name]
        oof, chosen = fold_scores(weighted, cols, label, binary, fold, folds, keep, trees, most)
        oof = materialize(oof.withColumn("variant", F.lit(name)), f"oof_{name}")
        w_bin = ev.best_by(ev.auc(ev.weight_grid(oof.withColumnRenamed(binary, "y"), "p_en", "p_rf"), "y", "blend", ["w"]), "w", "auc", 0.5).first()
        maes = [F.struct(F.avg(F.abs(F.col(label) - (F.lit(w) * F.col("s_en") + F.lit(1.0 - w) * F.col("s_rf")))).alias("m"), F.lit(w).alias("w")) for w in [i / 20 for i in range(21)]]
        w_reg = oof.agg(F.array_min(F.array(*maes)).alias("b")).first()["b"]
        blend = oof.withColumn("raw", w_bin["w"] * F.col("p_en") + (1 - w_bin["w"]) * F.col("p_rf")).withColumn(
            "score", F.greatest(F.lit(0.0), F.least(F.lit(21.0), w_reg["w"] * F.col("s_en") + (1 - w_reg["w"]) * F.col("s_rf")))
        )
        slope, icept = platt(blend, "raw", binary)
        z = F.greatest(F.least(slope * F.col("raw") + icept, F.lit(30.0)), F.lit(-30.0))
        blend = blend.withColumn("probability_ge5", 1.0 / (1.0 + F.exp(-z)))
        best = ev.youden(blend.withColumnRenamed(binary, "y"), "y", "probability_ge5").first()
        err = ev.regression_errors(blend, label, "score").first()
        line = (name, len(cols), float(w_bin["auc"]), float(w_bin["w"]), float(w_reg["w"]), slope, icept, float(best["threshold"]), float(best["j"]), float(err["mae"]), float(err["rmse"]))
        part = blend.select(*keep, "variant", label, binary, "score", "raw", "probability_ge5", (F.col("probability_ge5") >= best["threshold"]).cast("int").alias("screened"))
        return line, part, chosen

    reports, picked, scored = [], [], None
    for line, part, chosen in side_by_side(spark, one, list(variants)):
        reports.append(line)
        picked += [(line[0], f, i, c) for f, kept in enumerate(chosen) for i, c in enumerate(kept)]
        scored = part if scored is None else scored.unionByName(part)
    report = spark.createDataFrame(
        reports,
        "variant string, n_features int, auc double, weight_binary double, weight_regression double, platt_slope double, platt_intercept double, threshold double, youden_j double, mae double, rmse double",
    )
    columns = spark.createDataFrame(picked, "variant string, fold int, pos int, feature string")
    return scored, report, columns


def chosen_variant(report: DataFrame) -> DataFrame:
    """Largest AUC, ties to the smaller error."""
    return report.agg(F.max_by(F.struct(*report.columns), F.struct(F.coalesce("auc", F.lit(-1.0)), -F.col("mae"))).alias("b")).select("b.*")


