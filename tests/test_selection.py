"""Feature selection at any number of columns and groups."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import conversation as cv
from vitalgrid.operators import selection as sel


def test_one_correlation_at_any_number_of_columns(spark):
    r = random.Random(4)
    rows = [[None if i % 3 == 0 else r.random(), *(r.random() for _ in range(40))] for i in range(200)]
    wide = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(41)))
    pick = lambda n: {(x.a, x.b): x.r for x in sel.correlations(wide, [f"c{i}" for i in range(n)]).collect()}
    few, many = pick(40), pick(41)
    assert len(many) == 820 and all(many[k] == pytest.approx(v) for k, v in few.items())
    assert sel.correlations(wide, ["c0"]).count() == 0


@pytest.mark.parametrize("k", [2, 3, 5])
def test_greedy_folds_equal_the_plain_rule(spark, k):
    r = random.Random(k)
    sizes = {g: r.choice([1, 1, 1, 2, 2, 3, 5, 5, 8, 40]) for g in range(150)}
    rows = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g bigint")
    load, want = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        want[g] = min(range(k), key=lambda i: (load[i], i))
        load[want[g]] += sizes[g]
    got = {x.g: (x.n, x.fold) for x in sel.folds_greedy(rows, "g", k).collect()}
    assert got == {g: (sizes[g], f) for g, f in want.items()}


def test_class_weights_need_no_exchange_of_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "i int, y string")
    got = {x.i: x.weight for x in sel.class_weight(rows, "y").collect()}
    assert got == pytest.approx({1: 4 / 6, 2: 4 / 6, 3: 4 / 6, 4: 2.0})


def test_texts_without_tokens_stay(spark):
    texts = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "k int, text string")
    vocab = cv.vocabulary(texts.where(F.col("text").isNotNull()), "text", 1)
    coded = cv.encode(texts, ["k"], "text", vocab, 8)
    assert {r.k: len(r.ids) for r in coded.collect()} == {1: 3, 2: 0, 3: 0}
    assert {r.k: r.text for r in cv.decode(coded, ["k"], "ids", vocab).collect()} == {1: "b a b", 2: "", 3: ""}


def test_correlations_equal_pairwise_complete_ones(spark):
    """Gaps differ by column, values lie far from nought, a column is constant and one empty; several blocks of columns."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 9)) @ rng.normal(size=(9, 9)) + np.array([0, 1e6, -50, 0, 3, 1e-3, 7, 0, 0])
    x[:, 3] = 2.5
    x[rng.random(x.shape) < 0.3] = np.nan
    x[5, 0], x[:, 8] = np.inf, np.nan
    names = [f"c{i}" for i in range(9)]
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    sel.COLUMN_BLOCK, before = 4, sel.COLUMN_BLOCK
    try:
        got = {(r["a"], r["b"]): r["r"] for r in sel.correlations(df, names).collect()}
    finally:
        sel.COLUMN_BLOCK = before
    want = pd.DataFrame(np.where(np.isinf(x), np.nan, x), columns=names).corr(min_periods=2)
    assert len(got) == 36
    for (a, b), r in got.items():
        if "c3" in (a, b) or "c8" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_three_hundred_columns_in_one_scan(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 300))
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(300)))
    got = sel.correlations(df, df.columns)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    r = {(x["a"], x["b"]): x["r"] for x in got.collect()}
    want = np.corrcoef(x.T)
    assert len(r) == 300 * 299 // 2 and plan.count("MapInArrow") <= 4
    assert max(abs(r[f"c{i}", f"c{j}"] - want[i, j]) for i in range(0, 300, 7) for j in range(i + 1, 300, 11)) < 1e-9
