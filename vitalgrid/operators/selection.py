"""Column quality, correlation and fold assignment for feature selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.scalar import clamp, finite_or_null
from vitalgrid.operators.ordering import exact_quantiles, join_per_key, running_totals, size_bucket, value_bucket, with_scalars

#: Rows whose means values are taken from, and columns multiplied at once.
CENTRE_ROWS = 1000
COLUMN_BLOCK = 256


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.feature", "p.v")


def column_quality(df: DataFrame, columns: Sequence[str], bad_share: float = 0.5, eps: float = 1e-12) -> DataFrame:
    """Share of missing values and constancy per column, in one aggregate."""
    aggs = []
    for c in columns:
        v = finite_or_null(F.col(c).cast("double"))
        aggs.append(F.struct(F.lit(c).alias("feature"), F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("missing"), F.stddev_pop(v).alias("std")))
    row = df.agg(F.array(*aggs).alias("a"))
    q = row.select(F.explode("a").alias("q")).select("q.*")
    return q.select("feature", "missing", (F.col("missing") > bad_share).alias("mostly_missing"), "std", (F.coalesce("std", F.lit(0.0)) < eps).alias("constant"))


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.var_samp(c).alias("variance")) for c in columns]).alias("a"))
    return row.select(F.explode("a").alias("q")).select("q.*")


def low_variance_kept(df: DataFrame, columns: Sequence[str], least: float = 1e-10) -> list[str]:
    """Columns to keep, in order; all when none reaches the least variance."""
    var = {r["feature"]: r["variance"] for r in variances(df, columns).collect()}  # one row per column
    keep = [c for c in columns if var[c] is not None and var[c] >= least]
    return keep or list(columns)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlation of distinct column pairs, pairs in column order, from one scan at any width.

    A task holds the columns of a batch as a matrix X (missing and infinite values as nought) and their presence as a
    matrix M, and adds up M'M, X'M, (X^2)'M and X'X, block by block of columns: the counts, sums, sums of squares and of
    products of every pair over the rows that have both. Values are taken from the means of the first rows; that only
    keeps the sums small. A column without variation has no correlation. A task keeps columns x columns numbers.
    """
    cols = list(columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    x = df.select(*[finite_or_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    centre = np.array([v or 0.0 for v in x.limit(CENTRE_ROWS).agg(*[F.avg(c) for c in x.columns]).first()])
    sums = x.mapInArrow(_masked_sums(centre), SUMS).groupBy("i").applyInArrow(_added, SUMS)
    pairs = sums.mapInArrow(_lists, "i int, j int, n double, x double, xx double, xy double")
    other = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    both = pairs.where("i < j").join(other, ["i", "j"])
    n = F.col("n")
    vx, vy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y")
    real = (vx > 1e-13 * n * F.col("xx")) & (vy > 1e-13 * n * F.col("yy"))
    r = F.when(real, (n * F.col("xy") - F.col("x") * F.col("y")) / (F.sqrt(vx) * F.sqrt(vy)))
    name = F.array(*[F.lit(c) for c in cols])
    return both.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), r.alias("r"))


SUMS = "i int, n array<double>, x array<double>, xx array<double>, xy array<double>"


def _masked_sums(centre: np.ndarray):
    """For mapInArrow over the columns: per column i the lists of its sums with every column."""
    width = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((width, width)) for _ in range(4)]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            given = np.stack(columns, axis=1).astype(float) - centre
            held = ~np.isnan(given)
            values, mask = np.where(held, given, 0.0), held.astype(float)
            for low in range(0, width, COLUMN_BLOCK):
                rows = slice(low, low + COLUMN_BLOCK)
                total[0][rows] += mask[:, rows].T @ mask
                total[1][rows] += values[:, rows].T @ mask
                total[2][rows] += (values[:, rows] ** 2).T @ mask
                total[3][rows] += values[:, rows].T @ values
        for low in range(0, width, COLUMN_BLOCK):
            at = np.arange(low, min(low + COLUMN_BLOCK, width), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at)] + [pa.array(list(t[at]), pa.list_(pa.float64())) for t in total], names=["i", "n", "x", "xx", "xy"]
            )

    return run


def _added(rows: pa.Table) -> pa.Table:
    """One row from the tasks' rows of a column."""
    names = ["n", "x", "xx", "xy"]
    sums = [np.stack(rows.column(c).to_numpy()).sum(axis=0) for c in names]
    return pa.table([rows.column("i")[:1].combine_chunks()] + [pa.array([s], pa.list_(pa.float64())) for s in sums], names=["i", *names])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, row in enumerate(batch.column(0).to_pylist()):
            parts = [batch.column(c)[i].values.to_numpy() for c in range(1, 5)]
            at = np.arange(len(parts[0]), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), row, np.int32)), pa.array(at), *map(pa.array, parts)], names=["i", "j", "n", "x", "xx", "xy"]
            )


def correlation_kept(df: DataFrame, columns: Sequence[str], target: str, limit: float = 0.85) -> list[str]:
    """Greedy prune over the small correlation table: of each close pair the one further from the target drops."""
    cols = list(columns)
    found = {(x["a"], x["b"]): x["r"] for x in correlations(df, [*cols, target]).collect()}  # one row per column pair
    ty = {c: None if found[c, target] is None else abs(found[c, target]) for c in cols}
    dropped: set[str] = set()
    for a, b in [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]:
        v = found[a, b]
        if a in dropped or b in dropped or v is None or not abs(v) > limit:
            continue
        dropped.add(a if (ty[a] or 0.0) < (ty[b] or 0.0) else b)
    return [c for c in cols if c not in dropped]


def impute_median(df: DataFrame, columns: Sequence[str], bound: float = 1e8) -> DataFrame:
    """Missing and infinite values become the column median, then 0; values clip to the bound."""
    clean = df.withColumns({c: finite_or_null(F.col(c).cast("double")) for c in columns})
    med = exact_quantiles(melt(clean, columns), ["feature"], "v", {"m": 0.5})
    row = med.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"__{c}") for c in columns])
    out = with_scalars(clean, row)
    return out.withColumns({c: clamp(F.coalesce(c, f"__{c}", F.lit(0.0)), -bound, bound) for c in columns}).drop(*[f"__{c}" for c in columns])


def folds_by_size(df: DataFrame, group: str, k: int) -> DataFrame:
    """Deterministic folds of integer groups at any number of groups: position by size descending, modulo k."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(sizes, [], size_bucket("n", value_bucket(group) + (1 << 20), 1 << 21), [F.col("n").desc(), F.col(group)], {"no": F.lit(1)})
    return run.select(group, "n", F.pmod(F.col("no").cast("bigint") - 1, F.lit(k)).alias("fold"))


def fold_of(loads: Sequence[int], n: int, place: int) -> int:
    """Fold of the place-th (from 0) of many groups of n rows, each of which goes to the lightest fold, first on ties.

    Fold f takes its groups at loads L, L + n, L + 2 n, ...; the groups come in order of (load, fold). A load is a
    level (its multiple of n) and a rest, so at each level the folds that have reached it take one group each, in
    order of (rest, fold).
    """
    level = [x // n for x in loads]
    low, high = min(level), max(level) + place + 1
    while high - low > 1:  # the last level with no more than `place` groups below it
        middle = (low + high) // 2
        if sum(max(0, middle - x) for x in level) <= place:
            low = middle
        else:
            high = middle
    here = sorted((loads[f] % n, f) for f in range(len(loads)) if level[f] <= low)
    return here[place - sum(max(0, low - x) for x in level)][1]


def folds_greedy(df: DataFrame, group: str, k: int) -> DataFrame:
    """Groups by size descending (then by group) to the lightest fold.

    The loads depend on how many groups each size has, so only (size, count) pairs reach the driver; a group's fold
    follows from its place among the groups of its size.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()
    load, before = [0] * k, []
    for r in sorted(counts, key=lambda r: -r["n"]):
        n, c = r["n"], r["c"]
        before.append((n, list(load)))
        level = [x // n for x in load]
        full, far = min(level), max(level) + c + 1
        while far - full > 1:
            middle = (full + far) // 2
            full, far = (middle, far) if sum(max(0, middle - x) for x in level) <= c else (full, middle)
        rest = c - sum(max(0, full - x) for x in level)
        some = [f for _, f in sorted((load[f] % n, f) for f in range(k) if level[f] <= full)[:rest]]
        load = [x + n * (max(0, full - level[f]) + (f in some)) for f, x in enumerate(load)]
    run = running_totals(sizes, ["n"], value_bucket(group), [F.col(group)], {"no": F.lit(1)})

    @F.pandas_udf("int")
    def fold(loads: pd.Series, n: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series([fold_of(list(x), int(m), int(p)) for x, m, p in zip(loads, n, place, strict=True)])

    loads = df.sparkSession.createDataFrame(before, "n bigint, __loads array<bigint>")
    placed = join_per_key(run, loads, ["n"], group)
    return placed.select(group, "n", fold("__loads", "n", (F.col("no") - 1).cast("bigint")).alias("fold"))


def class_weight(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Balanced class weights n / (k * n_class), looked up in a map of the few classes: rows don't move."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("__n"))
    tot = counts.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    w = with_scalars(counts, tot).select(F.struct(y, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("w")).alias("e"))
    weights = w.agg(F.map_from_entries(F.collect_list("e")).alias("__weights"))
    out = with_scalars(df.where(F.col(y).isNotNull()), weights)
    return out.withColumn(name, F.element_at("__weights", F.col(y))).drop("__weights")


def hash_part(key, parts: int = 10):
    """Deterministic pseudo-random part of an integer key."""
    small = F.pmod(key, F.lit(2147483648))  # keeps the product inside 64 bits
    return F.pmod(F.pmod(small * F.lit(2654435761), F.lit(4294967296)) / 65536, F.lit(float(parts))).cast("int")
