"""Random forests whose trees are grown side by side in tasks and never lie on the driver.

Rows become codes once: every column is cut at no more than BINS - 1 points, from the training rows of a fold. A task holds
the codes of all rows (a byte a value, in a mapped file beyond HELD_BYTES) and grows some trees of a fold, level by level,
on the tree's own sample. What a tree draws depends on its number and the seed only: the forest of a draw with fewer trees or
less depth is the first trees of a larger one, cut at that depth. So trees that differ in no more are grown once.
"""

from __future__ import annotations

import math
import mmap
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import materialize

#: Codes of a column, and rows of a block of codes.
BINS, BLOCK = 32, 1 << 14
#: Tasks that grow trees, and sampled rows of the trees that a task grows side by side.
JOBS, TOGETHER = 48, 1 << 17
#: Sampled rows, of whole nodes, whose splits are looked for at once.
AT_ONCE = 1 << 15
#: Bytes of codes that a task holds in memory; more of them lie in a file that it maps.
HELD_BYTES = 1 << 26
#: Gain in purity below which a split is none.
LEAST_GAIN = 1e-12
#: Columns that come beside the coded ones.
LABEL, WEIGHT, FOLD = -3, -2, -1

_VALUES = "column int, part int, block int, data binary, fold binary"
_CODES = "fold int, column int, block int, data binary, cuts array<double>"
_SUMS = "draw int, fold int, block int, job int, label binary, votes binary"
_SCORED = "draw int, fold int, label double, votes array<double>"
NODES = "tree int, node long, left long, column int, threshold double, n long, share array<double>"


@dataclass(frozen=True)
class Draw:
    """A forest's parameters; no depth is no limit."""

    trees: int
    depth: int | None
    least: int


@dataclass(frozen=True)
class Coded:
    """Rows as codes, once for every fold from the rows outside it and once, as fold ``folds``, from all rows."""

    table: DataFrame
    rows: int
    columns: int
    classes: int
    folds: int


@dataclass(frozen=True)
class Job:
    """Trees of a fold that one task grows."""

    fold: int
    first: int
    end: int


def cut_points(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 points between distinct values: all, or those nearest to equal counts of rows."""
    found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(found) < 2:
        return np.empty(0)
    at = np.arange(len(found) - 1)
    if len(at) > BINS - 1:
        upto = np.cumsum(counts)
        middle, wanted, last = (upto[:-1] + upto[1:]) / 2, upto[-1] / BINS, -1
        picked = []
        for target in wanted * np.arange(1, BINS):
            last = max(int(np.searchsorted(middle, target, side="right")), last + 1)
            if last >= len(middle):
                break
            picked.append(last)
        at = np.array(picked, dtype=np.int64)
    low, high = found[at], found[at + 1]
    middle = low / 2 + high / 2
    return np.where(np.isfinite(middle) & (middle >= low) & (middle < high), middle, low)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (label, weight, fold, columns): a row for each column and block of rows."""
    from pyspark import TaskContext

    part, held, size, block = TaskContext.get().partitionId(), [], 0, 0

    def out() -> pa.RecordBatch:
        rows = np.concatenate(held, axis=1)
        fold = rows[2].astype(np.float32).tobytes()
        n, blank = len(rows), pa.nulls(len(rows), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(n, dtype=np.int32) + LABEL), blank.fill_null(part), blank.fill_null(block),
                pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([None] * 3 + [fold] * (n - 3), pa.binary()),
            ],
            names=["column", "part", "block", "data", "fold"],
        )

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64))
            size += batch.num_rows
        if size >= BLOCK:
            yield out()
            held, size, block = [], 0, block + 1
    if size:
        yield out()


def _codes(folds: int):
    """For applyInArrow over the blocks of a column: its codes and cut points for every fold and for all rows."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("block", "ascending")])
        column = rows.column("column")[0].as_py()
        values = np.concatenate([np.frombuffer(x.as_py()) for x in rows.column("data")])
        kinds = [(None, values, None)]
        if column >= 0:
            fold = np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in rows.column("fold")])
            kinds = []
            for f in range(folds + 1):
                cuts = cut_points(values if f == folds else values[(fold != f) & ~np.isnan(fold)])
                kinds.append((f, np.searchsorted(cuts, values).astype(np.uint8), cuts.tolist()))
        out = [(f, column, i // BLOCK, x[i : i + BLOCK].tobytes(), cuts if i == 0 else None) for f, x, cuts in kinds for i in range(0, len(x), BLOCK)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()))
        names = ["fold", "column", "block", "data", "cuts"]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)

    return run


def coded(rows: DataFrame, columns: Sequence[str], label: str, weight: str, fold: str, folds: int) -> Coded:
    """The rows' codes, written to the shared folder. Rows keep the order of their partitions."""
    y, w = F.col(label).cast("double"), F.col(weight).cast("double")
    wrong = y.isNull() | (y < 0) | (y != F.floor(y)) | w.isNull() | F.isnan(w) | (w < 0)
    n, most, bad = rows.agg(F.count(F.lit(1)), F.max(y), F.sum(wrong.cast("int"))).first()
    if not n or bad:
        raise ValueError(f"{bad or 0} of {n} rows have no class from 0 on, or no weight")
    given = rows.select(y.alias("__y"), w.alias("__w"), F.col(fold).cast("double").alias("__f"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    table = given.mapInArrow(_values, _VALUES).groupBy("column").applyInArrow(_codes(folds), _CODES)
    return Coded(materialize(table, "forest_codes"), n, len(columns), max(2, int(most) + 1), folds)


def _held(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int]) -> tuple[int, np.ndarray, dict, dict]:
    """The job of a task, its codes by column, the columns beside them and the cut points."""
    rows, columns = sizes
    if rows * columns > HELD_BYTES:
        with tempfile.TemporaryFile() as f:
            f.truncate(rows * columns)
            codes = np.frombuffer(mmap.mmap(f.fileno(), rows * columns), np.uint8)
    else:
        codes = np.empty(rows * columns, np.uint8)
    beside, cuts, job = {c: np.empty(rows) for c in (LABEL, WEIGHT, FOLD)}, {}, -1
    for batch in batches:
        for j, column, block, data, points in zip(*[batch.column(c) for c in ("job", "column", "block", "data", "cuts")]):
            job, column, at = j.as_py(), column.as_py(), block.as_py() * BLOCK
            x = np.frombuffer(data.as_buffer(), np.uint8 if column >= 0 else np.float64)
            if column < 0:
                beside[column][at : at + len(x)] = x
                continue
            codes[column * rows + at : column * rows + at + len(x)] = x
            if points.is_valid:
                cuts[column] = np.array(points.as_py())
    return job, codes, beside, cuts


@dataclass
class Level:
    """Nodes of one depth, ordered by tree: what their rows are, and how they are split into the next depth's nodes."""

    tree: np.ndarray
    size: np.ndarray
    share: np.ndarray
    column: np.ndarray  # -1 for a leaf
    code: np.ndarray  # the largest that goes left
    left: np.ndarray


def _features(rngs: list, tree: np.ndarray, columns: int, many: int) -> np.ndarray:
    """Different random columns for every node, from its tree's own numbers."""
    each = np.bincount(tree, minlength=len(rngs))
    u = np.concatenate([r.random((n, many)) for r, n in zip(rngs, each)])
    out = np.empty((many, len(tree)), np.int32)
    for first in range(0, len(tree), 1 << 12):
        some = u[first : first + (1 << 12)]
        node, pick = np.arange(len(some)), np.tile(np.arange(columns, dtype=np.int32), (len(some), 1))
        for j in range(many):
            at = j + (some[:, j] * (columns - j)).astype(np.int64)
            out[j, first : first + len(some)] = pick[node, at]
            pick[node, at] = pick[:, j]
    return out


def levels(
    codes: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, trees: Sequence[int], least: int, depth: int | None,
    classes: int, own_weights: bool, seed: int,
) -> Iterator[Level]:
    """Trees on samples of the rows, with replacement, depth by depth: in every node the best split by Gini impurity of the
    root of the number of columns, drawn at random, if both sides keep ``least`` sampled rows; until no split is left.

    own_weights: classes are weighted by n / (k * n_class) of the tree's own sample instead of the rows' weights.
    """
    total_rows, n = len(y), len(rows)
    columns = len(codes) // total_rows
    many = math.ceil(math.sqrt(columns))
    rngs = [np.random.default_rng([seed, t]) for t in trees]
    bags = [np.bincount(r.integers(0, n, n), minlength=n) for r in rngs]
    at = [np.flatnonzero(b) for b in bags]
    node = np.repeat(np.arange(len(bags)), [len(x) for x in at])
    row, count = rows[np.concatenate(at)], np.concatenate([b[x] for b, x in zip(bags, at)]).astype(np.float64)
    kind = y[row].astype(np.int64)
    # sums are of whole numbers where the rows of a class weigh the same
    of_class = [weight[rows][y[rows] == c] for c in range(classes)]
    plain = own_weights or all(len(x) == 0 or x.min() == x.max() for x in of_class)
    scale = np.ones((classes, len(bags)))
    if own_weights:
        have = np.bincount(node * classes + kind, count, len(bags) * classes).reshape(-1, classes).T
        scale = n / ((have > 0).sum(axis=0) * np.maximum(have, 1))
    elif plain:
        scale *= np.array([x[0] if len(x) else 1.0 for x in of_class])[:, None]
    mass = count if plain else count * weight[row]
    tree = np.arange(len(bags))
    for level in range(10**9):
        nodes = len(tree)
        part = np.bincount(node * classes + kind, mass, nodes * classes).reshape(-1, classes).T
        size = part.sum(axis=0) if plain else np.bincount(node, count, nodes)
        total = part * scale[:, tree]
        whole = total.sum(axis=0)
        now = Level(tree, size, total / np.where(whole > 0, whole, 1), np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, -1))
        open_ = (size >= 2 * least) & ((total > 0).sum(axis=0) > 1) & (depth is None or level < depth)
        if not open_.any():
            yield now
            return
        # the rows of nodes that may be split, by node
        place = np.cumsum(open_) - 1
        stay = open_[node]
        row, node, kind, mass, count = row[stay], place[node[stay]], kind[stay], mass[stay], count[stay]
        part, total, size, own = part[:, open_], total[:, open_], size[open_], tree[open_]
        features, column, code = _features(rngs, own, columns, many), np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        starts = np.searchsorted(node, np.arange(len(own) + 1))
        some = np.append(np.flatnonzero(np.diff(starts[:-1] // AT_ONCE, prepend=-1)), len(own))
        for a, b in zip(some[:-1], some[1:]):
            r = slice(starts[a], starts[b])
            column[a:b], code[a:b] = _best_splits(
                codes, total_rows, row[r], node[r] - a, kind[r], mass[r], None if plain else count[r], features[:, a:b], part[:, a:b], scale[:, own[a:b]], size[a:b], least
            )
        split = column >= 0
        now.column[open_], now.code[open_] = column, code
        pair = 2 * (np.cumsum(split) - 1)
        now.left[open_] = np.where(split, pair, -1)
        yield now
        if not split.any():
            return
        stay = split[node]
        row, node, kind, mass, count = row[stay], node[stay], kind[stay], mass[stay], count[stay]
        right = codes[column[node] * total_rows + row] > code[node]
        node = pair[node] + right
        order = np.sort((node << 32) | np.arange(len(node))) & 0xFFFFFFFF
        row, node, kind, mass, count = row[order], node[order], kind[order], mass[order], count[order]
        tree = np.repeat(own[split], 2)


def _best_splits(codes, total_rows, row, node, kind, mass, count, features, part, scale, size, least) -> tuple[np.ndarray, np.ndarray]:
    """Column and largest left code of every node's best split, -1 where no drawn column gives one.

    Of the cells (node, code) only those with rows are looked at: what lies left of a cell's end is a running sum.
    """
    classes, nodes = part.shape
    masses = [np.where(kind == c, mass, 0.0) for c in range(classes)]
    before = np.cumsum(part, axis=1) - part
    sized = np.cumsum(size) - size
    whole = (part * scale).sum(axis=0)
    alone = ((part * scale) ** 2).sum(axis=0) / whole
    best, column, code = alone + LEAST_GAIN * whole, np.full(nodes, -1), np.zeros(nodes, np.int64)
    cell = node * BINS
    for drawn in features:
        key = cell + codes[drawn[node].astype(np.int64) * total_rows + row]
        held = [np.bincount(key, m, nodes * BINS) for m in masses]
        filled = sum(held) if count is None else np.bincount(key, count, nodes * BINS)
        cells = np.flatnonzero(filled)
        of = cells // BINS
        left_size = np.cumsum(filled[cells]) - sized[of]
        score, left, right = np.zeros(len(cells)), np.zeros(len(cells)), np.zeros(len(cells))
        squares = np.zeros((2, len(cells)))
        for c in range(classes):
            low = np.cumsum(held[c][cells]) - before[c][of]
            high = (part[c][of] - low) * scale[c][of]
            low *= scale[c][of]
            left += low
            right += high
            squares[0] += low * low
            squares[1] += high * high
        fits = (left_size >= least) & (size[of] - left_size >= least) & (left > 0) & (right > 0)
        np.divide(squares[0], left, out=score, where=fits)
        score += np.divide(squares[1], right, out=np.zeros(len(cells)), where=fits)
        most = np.maximum.reduceat(score, np.flatnonzero(np.diff(of, prepend=-1)))
        better = most > best
        if not better.any():
            continue
        hit = np.flatnonzero((score == most[of]) & better[of])[::-1]
        code[of[hit]] = cells[hit] % BINS  # the first of a node comes last
        column[better], best[better] = drawn[better], most[better]
    return column, code


def _dealt(given: Coded, jobs: Sequence[Job]) -> DataFrame:
    """The codes, each fold's to its jobs, one job to a task."""
    mine = {f: [i for i, j in enumerate(jobs) if j.fold == f] for f in {j.fold for j in jobs}}
    to = F.when(F.col("fold").isNull(), F.sequence(F.lit(0), F.lit(len(jobs) - 1)))
    for f, numbers in mine.items():
        to = to.when(F.col("fold") == f, F.array(*map(F.lit, numbers)))
    table = given.table.where(F.col("fold").isNull() | F.col("fold").isin(list(mine)))
    return table.select(F.explode(to).alias("job"), "column", "block", "data", "cuts").repartitionById(len(jobs), "job")


def _together(first: int, end: int, rows: int) -> Iterator[range]:
    """Trees that are grown side by side."""
    step = max(1, TOGETHER // max(1, rows))
    return (range(t, min(end, t + step)) for t in range(first, end, step))


def _jobs(folds: Sequence[int], trees: int) -> list[Job]:
    step = max(1, -(-trees * len(folds) // JOBS))
    return [Job(f, t, min(trees, t + step)) for t in range(0, trees, step) for f in folds]


def held_out_votes(given: Coded, draws: Sequence[Draw], own_weights: bool, seed: int) -> DataFrame:
    """(draw, fold, label, rawPrediction, prediction): every draw's forest on every fold's rows, grown on the other rows.

    A tree's vote is the share of each class in the row's leaf. Trees that several draws have in common are grown once.
    """
    jobs = _jobs(range(given.folds), max(d.trees for d in draws))
    sizes, classes = (given.rows, given.columns), given.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, codes, beside, _ = _held(batches, sizes)
        if number < 0:
            return
        job, fold = jobs[number], beside[FOLD]
        seen = np.flatnonzero((fold != job.fold) & ~np.isnan(fold))
        asked = np.flatnonzero(fold == job.fold)
        if not len(asked):
            return
        if not len(seen):
            raise ValueError(f"no rows outside fold {job.fold}")
        for least in sorted({d.least for d in draws}):
            mine = [(i, d) for i, d in enumerate(draws) if d.least == least and d.trees > job.first]
            votes = {i: np.zeros((classes, len(asked))) for i, _ in mine}
            for trees in _together(job.first, min(job.end, max((d.trees for _, d in mine), default=0)), len(seen)):
                wanted = [(i, d) for i, d in mine if d.trees > trees[0]]
                deepest = None if any(d.depth is None for _, d in wanted) else max(d.depth for _, d in wanted)
                # places are trees by asked rows
                share = np.zeros((classes, len(trees) * len(asked)))
                place = np.arange(share.shape[1])
                node = np.repeat(np.arange(len(trees)), len(asked))

                def count(some: list[tuple[int, Draw]], trees=trees, share=share) -> None:
                    for i, d in some:
                        votes[i] += share.reshape(classes, len(trees), -1)[:, : max(0, d.trees - trees[0])].sum(axis=1)

                depth = -1
                for depth, level in enumerate(levels(codes, beside[LABEL], beside[WEIGHT], seen, trees, least, deepest, classes, own_weights, seed)):
                    share[:, place] = level.share[:, node]
                    count([x for x in wanted if x[1].depth == depth])
                    on = level.column[node] >= 0
                    place, node = place[on], node[on]
                    right = codes[level.column[node] * sizes[0] + asked[place % len(asked)]] > level.code[node]
                    node = level.left[node] + right
                count([x for x in wanted if x[1].depth is None or x[1].depth > depth])
            for i, _ in mine:
                for at in range(0, len(asked), BLOCK):
                    some = slice(at, at + BLOCK)
                    label = beside[LABEL][asked[some]].tobytes() if job.first == 0 else None
                    out = [[i], [job.fold], [at // BLOCK], [job.first], [label], [votes[i][:, some].tobytes()]]
                    kinds = [pa.int32()] * 4 + [pa.binary()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["draw", "fold", "block", "job", "label", "votes"])

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("job")
        label = np.frombuffer(rows.column("label")[0].as_py())
        votes = np.zeros((classes, len(label)))
        for x in rows.column("votes"):
            votes += np.frombuffer(x.as_py()).reshape(classes, -1)
        ends = np.arange(len(label) + 1, dtype=np.int32) * classes
        one = lambda c: pa.array(np.full(len(label), rows.column(c)[0].as_py(), np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(votes.T).ravel()))
        return pa.table([one("draw"), one("fold"), pa.array(label), lists], names=["draw", "fold", "label", "votes"])

    sums = _dealt(given, jobs).mapInArrow(run, _SUMS).groupBy("draw", "fold", "block").applyInArrow(added, _SCORED)
    most = F.array_position("votes", F.array_max("votes")) - 1
    return sums.select("draw", "fold", "label", array_to_vector("votes").alias("rawPrediction"), most.cast("double").alias("prediction"))


def fitted_nodes(given: Coded, draw: Draw, own_weights: bool, seed: int) -> DataFrame:
    """The nodes of a forest on all rows: rows with a value up to the threshold go to ``left``, others to the node after it."""
    jobs = _jobs([given.folds], draw.trees)
    sizes, classes = (given.rows, given.columns), given.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, codes, beside, cuts = _held(batches, sizes)
        if number < 0:
            return
        points = np.full((sizes[1], BINS), np.nan)
        for c, x in cuts.items():
            points[c, : len(x)] = x
        job, every = jobs[number], np.arange(sizes[0])
        for trees in _together(job.first, job.end, sizes[0]):
            used = np.zeros(len(trees), np.int64)
            for level in levels(codes, beside[LABEL], beside[WEIGHT], every, trees, draw.least, draw.depth, classes, own_weights, seed):
                each = np.bincount(level.tree, minlength=len(trees))
                first = used - (np.cumsum(each) - each)  # of a tree at this depth
                inner = level.column >= 0
                below = np.bincount(level.tree[inner], minlength=len(trees)) * 2
                left = level.left + (used + each - (np.cumsum(below) - below))[level.tree]
                threshold = np.where(inner, points[level.column, level.code], np.nan)
                ends = np.arange(len(level.tree) + 1, dtype=np.int32) * classes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((level.tree + trees[0]).astype(np.int32)), pa.array(np.arange(len(level.tree)) + first[level.tree]),
                        pa.array(left, mask=~inner), pa.array(level.column.astype(np.int32), mask=~inner), pa.array(threshold, mask=~inner),
                        pa.array(level.size.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(level.share.T).ravel())),
                    ],
                    names=["tree", "node", "left", "column", "threshold", "n", "share"],
                )
                used += each

    return _dealt(given, jobs).mapInArrow(run, NODES)
