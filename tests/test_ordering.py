"""The block-wise ordered operators must equal plain windows, also when one key dominates."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalgrid.operators import ordering as o


def skewed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    v = np.round(rng.lognormal(0, 3, n) * rng.choice([-1, 1], n), 2)
    v[rng.random(n) < 0.2] = 7.5
    return pd.DataFrame({"k": key, "i": rng.permutation(n), "v": v})


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=60))
@settings(max_examples=8, deadline=None)
def test_value_bucket_is_monotone(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    got = sorted((r["v"], r["b"]) for r in df.select("v", o.value_bucket("v").alias("b")).collect())
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))


def test_row_index_with_hot_key(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = o.row_index(df, ["k"], F.floor(F.col("i") / 50).cast("bigint"), [F.col("i")]).toPandas()
    want = pdf.sort_values("i").groupby("k").cumcount()
    merged = got.merge(pdf.assign(want=want), on=["k", "i"])
    assert len(merged) == len(pdf) and (merged["idx"] == merged["want"]).all()


def test_running_totals_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(skewed())
    run = lambda d: sorted(
        map(tuple, o.running_totals(d, ["k"], o.value_bucket("v"), [F.col("v"), F.col("i")], {"s": F.lit(1)}).select("k", "i", "s").collect())
    )
    assert run(df.repartition(1)) == run(df.repartition(7, "v")) == run(df.orderBy(F.col("i").desc()))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_equal_numpy(spark, keys):
    pdf = skewed()
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = o.exact_quantiles(spark.createDataFrame(pdf), keys, "v", probs).toPandas()
    groups = pdf.groupby("k")["v"] if keys else [(None, pdf["v"])]
    assert len(got) == len(groups)
    for key, vals in groups:
        row = got[got["k"] == key].iloc[0] if keys else got.iloc[0]
        for n, p in probs.items():
            assert row[n] == pytest.approx(np.quantile(vals, p), abs=1e-9)


def test_quantiles_of_tiny_and_null_groups(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    got = {r["k"]: r["m"] for r in o.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 3.0, "b": 1.5}


@pytest.mark.parametrize("size", [6, 7, 50])
def test_halo_blocks_equal_plain_windows(spark, size):
    pdf = skewed(600)
    df = spark.createDataFrame(pdf)
    df = o.row_index(df, ["k"], F.floor(F.col("i") / 50).cast("bigint"), [F.col("i")])
    rows = o.blocks_with_halo(df, ["k"], "idx", reach=5, size=size)
    w = o.halo_window(["k"], "idx").rowsBetween(-5, 5)
    got = o.home_rows(rows.withColumn("m", F.sum("v").over(w))).select("k", "i", F.round("m", 6).alias("m"))
    plain = Window.partitionBy("k").orderBy("i").rowsBetween(-5, 5)
    want = df.select("k", "i", F.round(F.sum("v").over(plain), 6).alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tied_ranks_equal_pandas(spark):
    pdf = skewed()
    got = o.tied_ranks(spark.createDataFrame(pdf), ["k"], "v").toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).groupby(["k", "v"])["r"].first().reset_index()
    m = got.merge(want, on=["k", "v"])
    assert len(m) == len(got) == len(want) and np.allclose(m["rank"], m["r"])


def test_no_task_holds_a_hot_key(spark):
    """Ordering runs per (key, bucket): the plan has no window over the bare key on rows."""
    df = spark.createDataFrame(skewed())
    plan = o.row_index(df, ["k"], F.floor(F.col("i") / 50).cast("bigint"), [F.col("i")])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__bucket" in plan


def close(n=60_000, seed=3):
    """Half of all values within one per cent of each other, all different; null, infinite, huge and equal ones too."""
    rng = np.random.default_rng(seed)
    v = np.concatenate([100 + rng.random(n // 2), rng.lognormal(0, 4, n // 2 - 6), [0.0, -0.0, 1e300, -1e300, 7.5, 7.5]])
    return pd.DataFrame({"k": rng.integers(0, 2, n) * (np.arange(n) % 3 > 0), "v": rng.permutation(v)})


def test_close_values_are_dealt_over_many_buckets(spark):
    pdf = close()
    df = o.fine_buckets(spark.createDataFrame(pdf), ["k"], "v", "b", most=500).toPandas()
    sizes = df.groupby(["k", "b"]).size()
    assert sizes.max() < 1200 and (o.value_bucket is not None)
    for _, part in df.sort_values("v").groupby("k"):
        assert part["b"].is_monotonic_increasing
        assert part.groupby("v")["b"].nunique().max() == 1


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_of_close_values(spark, monkeypatch, keys):
    monkeypatch.setattr(o, "CLOSE_ROWS", 300)
    pdf = close()
    probs = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.777, "e": 1.0}
    got = o.exact_quantiles(spark.createDataFrame(pdf), keys, "v", probs).toPandas()
    for key, vals in pdf.groupby("k")["v"] if keys else [(None, pdf["v"])]:
        row = got[got["k"] == key].iloc[0] if keys else got.iloc[0]
        for n, p in probs.items():
            assert row[n] == pytest.approx(np.quantile(vals, p), rel=1e-12)


def test_ranks_of_close_values(spark, monkeypatch):
    monkeypatch.setattr(o, "CLOSE_ROWS", 300)
    pdf = close(20_000)
    got = o.tied_ranks(spark.createDataFrame(pdf), ["k"], "v").toPandas()
    want = pdf.assign(v=pdf["v"] + 0.0).assign(r=lambda x: x.groupby("k")["v"].rank()).groupby(["k", "v"])["r"].first().reset_index()
    m = got.assign(v=got["v"] + 0.0).merge(want, on=["k", "v"])
    assert len(m) == len(got) == len(want) and np.allclose(m["rank"], m["r"])


def test_numbering_of_a_whole_table_by_ranges(spark, monkeypatch):
    """No window holds all buckets: with ranges of four buckets, numbers still run through."""
    monkeypatch.setattr(o, "RANGE_BITS", 2)
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    numbered = o.running_totals(df, [], o.value_bucket("v"), [F.col("v"), F.col("i")], {"s": F.lit(1)})
    got = numbered.toPandas().sort_values("s")
    want = pdf.sort_values(["v", "i"])
    assert got["s"].tolist() == list(range(1, len(pdf) + 1)) and got["i"].tolist() == want["i"].tolist()
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "__range" in plan
