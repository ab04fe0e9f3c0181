"""Exact nearest vectors by pivots: cells, radii, bounds from the triangle inequality, and the comparisons left.

Few vectors of many features are far from all pivots alike, so bounds alone leave most pairs. What is left is therefore
compared in blocks, by matrix products; their rounding only widens the choice, which plain differences then order.

Distances are Euclidean; for cosines the vectors are brought to unit length first, where the order of distances is the
reverse order of cosines. Bounds keep a small slack, so rounding never loses a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import materialize

#: Most pivots; cells are larger where there are more vectors.
PIVOTS = 256
SLACK = 1e-6
#: Groups of neighbouring shards that a query is sent to, once a group; more where a group would pass the largest shard.
GROUPS = 32
#: Products held at once.
PRODUCTS = 1 << 22

VISIT = "__q long, __v array<double>, reach double, group long"


def scaled(m: np.ndarray, metric: str) -> np.ndarray:
    """Rows as they are compared: for cosines of unit length, a null vector as the origin."""
    m = np.asarray(m, dtype=float)
    if metric != "cosine":
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def choose(v: DataFrame, metric: str) -> np.ndarray:
    """At most PIVOTS vectors, the first by a hash of their id."""
    rows = v.orderBy(F.xxhash64("__id"), "__id").limit(PIVOTS).collect()  # bounded by PIVOTS
    return np.unique(scaled([list(r["__e"]) for r in rows], metric), axis=0) if rows else np.zeros((0, 1))


def placed(v: DataFrame, pivots: np.ndarray, metric: str, shard_rows: int) -> DataFrame:
    """(__id, __e, r, shard): each vector's distance to the pivot of its cell, and its shard.

    The shards of a cell are bands of radius, so a cell that holds most vectors (or copies of one) is cut into tasks of
    bounded size and the bounds tell its shards apart.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(scaled(_rows(batch.column(1)), metric), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cell.astype(np.int64)), pa.array(d[np.arange(len(d)), cell])],
                    ["__id", "__e", "cell", "r"],
                )

    e = v.select("__id", F.col("__e").cast("array<double>").alias("__e"))
    cells = materialize(e.mapInArrow(assign, "__id long, __e array<double>, cell long, r double"), "cells")
    # bands of about shard_rows, from the cell's own quantiles; equal radii are dealt by hash over all bands they fill
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    large = [(r["cell"], -(-r["n"] // shard_rows)) for r in sizes.where(F.col("n") > shard_rows).collect()]  # a row per pivot
    if not large:
        return cells.select("__id", "__e", "r", "cell", F.col("cell").alias("shard"))
    bands = cells.join(F.broadcast(v.sparkSession.createDataFrame(large, "cell long, k long")), "cell", "left")
    cuts = bands.where("k is not null").groupBy("cell").agg(F.percentile_approx("r", [i / 64 for i in range(1, 64)]).alias("cuts"))
    bands = bands.join(F.broadcast(cuts), "cell", "left")  # a row per pivot
    below = F.size(F.filter("cuts", lambda c: c < F.col("r")))
    upto = F.size(F.filter("cuts", lambda c: c <= F.col("r")))
    part = F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) / F.lit(1 << 20)
    band = F.floor((below + part * (upto - below + 1)) * F.col("k") / 64)
    shard = F.col("cell") + F.lit(len(pivots)) * F.when(F.col("k").isNull(), 0).otherwise(F.least(band, F.col("k") - 1))
    return bands.select("__id", "__e", "r", "cell", shard.cast("long").alias("shard"))


def radii(vectors: DataFrame) -> DataFrame:
    """A row per shard: its cell, number of vectors, least and largest radius."""
    return vectors.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))


def grouping(table: list, pivots: np.ndarray, largest: int | None = None) -> np.ndarray:
    """The group of each shard: shards along the main axis of their pivots, about as many vectors in each group."""
    cell, low, n = (np.array([r[c] for r in table]) for c in ("cell", "low", "n"))
    around = pivots - pivots.mean(axis=0)
    along = (around @ np.linalg.svd(around, full_matrices=False)[2][0])[cell]
    order = np.lexsort((low, cell, along))
    size = -(-int(n.sum()) // GROUPS)
    before = np.cumsum(n[order]) - n[order]
    group = np.empty(len(table), dtype=np.int64)
    group[order] = before // max(1, size if largest is None else min(size, largest))
    return group


def in_groups(vectors: DataFrame, pivots: np.ndarray, shards: DataFrame, largest: int | None = None) -> DataFrame:
    """(__id, __e, group): the placed vectors, by the group of their shard."""
    table = shards.orderBy("shard").collect()  # one row per shard
    pairs = [(r["shard"], int(g)) for r, g in zip(table, grouping(table, pivots, largest) if table else [])]
    groups = vectors.sparkSession.createDataFrame(pairs, "shard long, group long")
    return vectors.join(F.broadcast(groups), "shard").select("__id", "__e", "group")


def visits(q: DataFrame, pivots: np.ndarray, shards: DataFrame, k: int, metric: str, largest: int | None = None) -> DataFrame:
    """(__q, __v, reach, group) for groups with a shard that may hold one of a query's k nearest, and the k-th's upper bound.

    The table of shards (a few numbers for each SHARD_ROWS vectors) goes to every task.
    """
    table = shards.orderBy("shard").collect()  # one row per shard
    if not table:
        return q.sparkSession.createDataFrame([], VISIT)
    group = grouping(table, pivots, largest)
    by_group = np.argsort(group, kind="stable")
    names, starts = np.unique(group[by_group], return_index=True)
    cell, n = np.array([r["cell"] for r in table]), np.array([r["n"] for r in table])
    low, high = np.array([r["low"] for r in table]), np.array([r["high"] for r in table])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                to_pivot = distances(scaled(_rows(part.column(1)), metric), pivots)
                # a pivot is a vector itself; beside those, whole shards within their radius
                upper = to_pivot[:, cell] + high[None, :]
                order = np.argsort(upper, axis=1)
                enough = np.cumsum(n[order], axis=1) >= k
                last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(cell) - 1)
                reach = upper[np.arange(len(upper)), order[np.arange(len(upper)), last]]
                reach = np.where(enough.any(axis=1), reach, np.inf)
                if pivots.shape[0] >= k:
                    reach = np.minimum(reach, np.partition(to_pivot, k - 1, axis=1)[:, k - 1])
                reach = reach * (1 + SLACK) + SLACK
                home = to_pivot.min(axis=1)
                d = to_pivot[:, cell]
                least = np.maximum(np.maximum(d - high, low - d), (d - home[:, None]) / 2)
                i, j = np.nonzero(np.logical_or.reduceat((least <= reach[:, None])[:, by_group], starts, axis=1))
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(reach[i]), pa.array(names[j])],
                    ["__q", "__v", "reach", "group"],
                )

    e = q.select("__q", F.col("__v").cast("array<double>").alias("__v"))
    return e.mapInArrow(ask, VISIT)


def compared(left: pa.Table, right: pa.Table, k: int, metric: str) -> pa.Table:
    """The k best vectors of one group for each query that visits it.

    Products of blocks choose, with room for their rounding, the vectors that can be among the k best; only those are
    compared as they are defined. By distance, vectors out of a query's reach are left out first.
    """
    found: tuple[list, list, list] = ([], [], [])
    if left.num_rows and right.num_rows:
        ids, names = left.column("__id").to_numpy(), right.column("__q").to_pylist()
        vectors, queries = scaled(_rows(left.column("__e")), metric), scaled(_rows(right.column("__v")), metric)
        reach = right.column("reach").to_numpy()
        size = (vectors * vectors).sum(axis=1)
        rounding = (vectors.shape[1] + 8) * np.finfo(float).eps
        step = max(1, PRODUCTS // len(vectors))
        for start in range(0, len(queries), step):
            asked = queries[start : start + step]
            own = (asked * asked).sum(axis=1)
            far = -(asked @ vectors.T) if metric == "cosine" else own[:, None] + size[None, :] - 2.0 * (asked @ vectors.T)
            room = 2 * rounding * (own + size[np.isfinite(size)].max(initial=0.0))
            limit = np.full(len(asked), np.inf) if metric == "cosine" else reach[start : start + step] ** 2 + room
            for i, q in enumerate(asked):
                rows = np.flatnonzero(far[i] <= limit[i])
                if len(rows) > k:
                    left_over = far[i][rows]
                    rows = rows[left_over <= np.partition(left_over, k - 1)[k - 1] + 2 * room[i]]
                part = vectors[rows]
                s = (part * q).sum(axis=1) if metric == "cosine" else -((part - q) ** 2).sum(axis=1)
                best = np.lexsort((ids[rows], -s))[:k]
                found[0].extend([names[start + i]] * len(best))
                found[1].extend(ids[rows][best].tolist())
                found[2].extend(s[best].tolist())
    types = [pa.int64(), pa.int64(), pa.float64()]
    return pa.Table.from_arrays(
        [pa.array(x, t) for x, t in zip(found, types, strict=True)], names=["__q", "__id", "similarity"]
    )
