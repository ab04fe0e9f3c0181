"""Forests grown in tasks: against plain recursion, alone and in common, and what a search does with them."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import forests as fo
from vitalgrid.operators import models as md

ONE = {"numTrees": (4,), "maxDepth": (None,), "minInstancesPerNode": (2,)}


def sampled(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n), rng.random(n), np.full(n, 7.0)])
    y = (x[:, 0] + 0.4 * x[:, 1] + rng.normal(scale=0.7, size=n) > 0.5).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    """Keys repeat or are missing; a fold is missing."""
    x, y = sampled()
    data = [(None if i % 50 == 0 else i // 2, *map(float, x[i]), int(y[i]), None if i == 9 else i % 3, 1.0 + int(y[i])) for i in range(len(y))]
    return spark.createDataFrame(data, "row_id int, a double, b double, c double, d double, y int, fold int, weight double")


def search(rows, draws=ONE, n=md.DRAWS, **more):
    return md.forest_search(rows, ["a", "b", "c", "d"], "y", "fold", 3, "weight", "row_id", draws, n, **more)


def naive(codes, y, mass, count, least, depth):
    """The leaves (class shares by row) of a tree that tries every column, first of equal splits."""
    shares = np.array([mass[y == c].sum() for c in range(3)])
    total = shares.sum()
    gini = lambda s: 1 - ((s / s.sum()) ** 2).sum()
    best, split = 1e-12, None
    if (shares > 0).sum() > 1 and depth != 0:
        for column in range(len(codes)):
            for code in range(fo.BINS):
                left = codes[column] <= code
                if min(count[left].sum(), count[~left].sum()) < least:
                    continue
                sides = [np.array([mass[m & (y == c)].sum() for c in range(3)]) for m in (left, ~left)]
                gain = gini(shares) - sum(s.sum() / total * gini(s) for s in sides)
                if gain > best + 1e-13:
                    best, split = gain, left
    if split is None:
        return np.tile(shares / total, (len(y), 1))
    out = np.empty((len(y), 3))
    for m in (split, ~split):
        out[m] = naive(codes[:, m], y[m], mass[m], count[m], least, None if depth is None else depth - 1)
    return out


@pytest.mark.parametrize("least, depth, kind", [(1, None, "rows"), (3, None, "classes"), (2, 3, "own"), (1, 0, "rows")])
def test_a_tree_equals_plain_recursion(monkeypatch, least, depth, kind):
    monkeypatch.setattr(fo, "_features", lambda rngs, tree, columns, many: np.tile(np.arange(columns)[:, None], len(tree)))
    monkeypatch.setattr(fo, "AT_ONCE", 20)
    rng = np.random.default_rng(5)
    codes, y = rng.integers(0, 6, (4, 90)).astype(np.uint8), rng.integers(0, 3, 90)
    weight = rng.random(90) + 0.1 if kind == "rows" else 1.0 + y
    seen = np.arange(0, 90, 2)
    found = [np.zeros((90, 3)) for _ in range(3)]
    node = [np.full(90, t) for t in range(3)]
    for level in fo.levels(codes.ravel(), y.astype(float), weight, seen, range(3), least, depth, 3, kind == "own", 8):
        for t in range(3):
            on = node[t] >= 0
            at = np.where(on, node[t], 0)
            found[t][on] = level.share[:, at[on]].T
            right = codes[level.column[at], np.arange(90)] > level.code[at]
            node[t] = np.where(on & (level.column[at] >= 0), level.left[at] + right, -1)
    for t in range(3):
        bag = np.bincount(np.random.default_rng([8, t]).integers(0, 45, 45), minlength=45)
        kept = seen[bag > 0]
        count, of = bag[bag > 0], y[kept]
        w = 45 / (3 * np.bincount(of, count, 3))[of] if kind == "own" else weight[kept]
        assert found[t][kept] == pytest.approx(naive(codes[:, kept], of, count * w, count, least, depth))


def test_drawn_columns_differ_and_do_not_depend_on_other_trees():
    tree = np.array([0] * 9000 + [1] * 7)
    both = fo._features([np.random.default_rng(t) for t in (1, 2)], tree, 10, 4)
    alone = fo._features([np.random.default_rng(2)], np.zeros(7, np.int64), 10, 4)
    assert (both[:, 9000:] == alone).all() and all(len(set(x)) == 4 for x in both.T)
    assert np.bincount(both.ravel(), minlength=10) == pytest.approx(np.full(10, 9007 * 0.4), rel=0.1)


def test_cut_points_are_those_nearest_to_equal_counts():
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=3000), rng.integers(0, 100, 3000) ** 2.0, np.repeat([1.0, 2.0, 5.0], [1, 3000, 2]), np.array([2.0, np.nan])):
        found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
        want, step, upto = [], counts.sum() / fo.BINS, counts[0]
        target = step
        for i in range(1, len(found)):
            before, upto = upto, upto + counts[i]
            if len(found) <= fo.BINS or abs(before - target) < abs(upto - target):
                want.append((found[i - 1] + found[i]) / 2)
                target += step
        assert fo.cut_points(values) == pytest.approx(want)
    close = np.array([1.0, np.nextafter(1.0, 2), np.inf])
    assert np.searchsorted(fo.cut_points(close), close).tolist() == [0, 1, 2]


def test_codes_in_a_mapped_file(monkeypatch):
    kinds = [pa.int32()] * 3 + [pa.binary(), pa.list_(pa.float64())]
    columns = [[5] * 3, [1, 0, fo.LABEL], [0] * 3, [bytes([3, 4]), bytes([1, 2]), np.array([0.0, 1.0]).tobytes()], [[0.5], [], None]]
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["job", "column", "block", "data", "cuts"])
    for most in (0, 100):
        monkeypatch.setattr(fo, "HELD_BYTES", most)
        job, codes, beside, cuts = fo._held(iter([batch]), (2, 2))
        assert job == 5 and codes.tolist() == [1, 2, 3, 4] and beside[fo.LABEL].tolist() == [0, 1] and cuts[1].tolist() == [0.5]


def test_forests_in_common_equal_forests_alone(rows):
    given = fo.coded(md.few_parts(rows, "row_id"), ["a", "b", "c", "d"], "y", "weight", "fold", 3)
    draws = [fo.Draw(5, None, 1), fo.Draw(3, 2, 1), fo.Draw(2, 4, 3), fo.Draw(4, 40, 1)]
    read = lambda df: sorted((r.fold, r.label, *r.rawPrediction, r.prediction) for r in df.collect())
    together = fo.held_out_votes(given, draws, False, 42)
    for i, draw in enumerate(draws):
        votes = read(together.where(F.col("draw") == i))
        assert votes == read(fo.held_out_votes(given, [draw], False, 42)) and len(votes) == 239
        assert all(sum(v[2:4]) == pytest.approx(draw.trees) and v[4] == (v[3] > v[2]) for v in votes)


def test_a_search_scores_like_forests_of_spark(spark):
    x, y = sampled(3000)
    rows = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), i % 3, 1.0) for i in range(3000)], "row_id int, a double, b double, c double, d double, y int, fold int, weight double")
    got = search(rows, {"numTrees": (30,), "maxDepth": (5,), "minInstancesPerNode": (2,)})
    vec = md.assembler(["a", "b", "c", "d"]).transform(rows.coalesce(1))
    judge = md.BinaryClassificationEvaluator(labelCol="y")
    want = [judge.evaluate(md.forest("y", 30, 5).fit(vec.where(F.col("fold") != f)).transform(vec.where(F.col("fold") == f))) for f in range(3)]
    assert got[0] == pytest.approx(sum(want) / 3, abs=0.01) and got[0] > 0.75


def test_no_tree_of_a_search_lies_on_the_driver(spark, rows, monkeypatch):
    """no forest of Spark ML, whose nodes the driver holds; the jobs of a search do not grow with its depth."""
    monkeypatch.setattr(md.RandomForestClassifier, "_fit", lambda *_: pytest.fail("a forest on the driver"))
    jobs = []
    for depth in (1, None):
        group = f"search-{depth}"
        spark.sparkContext.setJobGroup(group, group)
        assert len(search(rows, ONE | {"maxDepth": (depth,)})) == 1
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1]


def test_the_best_forest_is_fitted_on_all_rows(rows):
    """the search ends with the best draw's forest on all rows, the row without a fold as well."""
    found = search(rows, {"numTrees": (3, 4), "maxDepth": (None, 1), "minInstancesPerNode": (1,)}, 4, own_weights=True)
    assert found.best == found.index(max(found))
    draw = md.drawn_parameters({"numTrees": (3, 4), "maxDepth": (None, 1), "minInstancesPerNode": (1,)}, 4)[found.best]
    nodes = {(r.tree, r.node): r for r in found.nodes.collect()}
    assert {t for t, _ in nodes} == set(range(draw["numTrees"]))
    assert all(nodes[t, 0].n == 240 and nodes[t, 0].share == pytest.approx([0.5, 0.5]) for t in range(draw["numTrees"]))
    hits, all_rows = 0, rows.collect()
    for r in all_rows:
        votes = np.zeros(2)
        for t in range(draw["numTrees"]):
            at = nodes[t, 0]
            while at.column is not None:
                assert at.n == nodes[t, at.left].n + nodes[t, at.left + 1].n
                at = nodes[t, at.left + (r["abcd"[at.column]] > at.threshold)]
            votes += at.share
        hits += int(votes.argmax() == r.y)
    assert hits / len(all_rows) > (0.9 if draw["maxDepth"] is None else 0.6)


def test_scores_of_all_draws_equal_those_of_one(spark):
    """from one plan for all draws and folds; ties, and folds of one class."""
    rng = np.random.default_rng(2)
    data = [(d, f, int(f == 2 or (f < 2 and rng.random() < 0.4)), float(rng.integers(0, 6))) for d in range(2) for f in range(4) for _ in range(50)]
    rows = spark.createDataFrame(data, "draw int, fold int, y int, s double")
    scored = rows.select("*", md.forests.array_to_vector(F.array(6 - F.col("s"), "s")).alias("rawPrediction"), (F.col("s") > 3).cast("double").alias("prediction"))
    for exact, one in ((md.RocArea("y"), md.BinaryClassificationEvaluator(labelCol="y", numBins=0)), (md.BalancedAccuracy("y"), None)):
        want = []
        for d in range(2):
            parts = [scored.where((F.col("draw") == d) & (F.col("fold") == f)) for f in range(4)]
            want.append(sum((one or exact).evaluate(x) for x in parts) / 4)
            assert exact.evaluate(parts[0]) == pytest.approx((one or exact).evaluate(parts[0]))
        assert md.mean_scores(scored, exact, [0, 1], 4) == pytest.approx(want)
    assert md.mean_scores(scored, md.BinaryClassificationEvaluator(labelCol="y"), [1], 4) == pytest.approx(md.mean_scores(scored, md.RocArea("y"), [1], 4))


def test_own_weights_are_those_of_a_trees_sample(rows):
    rows = rows.withColumn("row_id", F.xxhash64("a"))
    other = rows.withColumn("weight", F.lit(3.0) + F.col("a") ** 2)
    assert search(rows, own_weights=True) == search(other, own_weights=True)


def test_rows_are_dealt_by_key_alone(rows, monkeypatch):
    """Values of a column that no split uses do not change which rows a tree samples, in several partitions as well."""
    dealt = md.few_parts
    monkeypatch.setattr(md, "few_parts", lambda df, key: dealt(df, key, 50))
    rows = rows.withColumn("row_id", F.xxhash64("a"))
    assert search(rows) == search(rows.withColumn("d", F.col("d") + 1).repartition(3))


def test_rows_without_class_or_weight_are_an_error(rows):
    for bad in (rows.withColumn("y", F.col("y") - 1), rows.withColumn("weight", F.lit(None).cast("double")), rows.where("false")):
        with pytest.raises(ValueError):
            search(bad)
    with pytest.raises(ValueError):
        search(rows, ONE | {"impurity": ("gini",)})


def test_the_grid_search_gives_the_best_draw_its_balanced_accuracy(spark, rows, monkeypatch):
    """next to the AUC of all draws, the mean recall of the best one's held-out rows."""
    from vitalgrid.plans import learning

    monkeypatch.setattr(md, "FOREST_DRAWS", {"numTrees": (2, 3), "maxDepth": (None, 2), "minInstancesPerNode": (1,)})
    monkeypatch.setattr(learning, "training_table", lambda spark, d: (rows, ["a", "b", "c", "d"]))
    held, run = [], md.forest_search
    monkeypatch.setattr(md, "forest_search", lambda *a, **k: held.append(run(*a, **k)) or held[0])
    got = learning.tree_grid_search(spark, "").collect()
    assert [r.auc for r in got] == held[0] and [r.best for r in got] == [x == max(held[0]) for x in held[0]]
    for i, r in enumerate(got):
        if not r.best:
            assert r.balanced_accuracy is None
            continue
        scored = held[0].scored.where(F.col("draw") == i).collect()
        hit = lambda f, c: [x.prediction == c for x in scored if x.fold == f and x.y == c]
        assert r.balanced_accuracy == pytest.approx(np.mean([np.mean(hit(f, c)) for f in range(3) for c in (0, 1)]))
        assert math.isfinite(r.auc)
