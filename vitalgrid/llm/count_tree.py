"""Exact join of texts by the Jaccard similarity of their shingle sets, with a tree over count vectors.

A set's shingles are hashed into groups; the counts per group are a point. The overlap of two sets is at most the sum
of the smaller coordinate in every group, which prunes pairs of points, and of a point and a tree node's corner, before
the sets themselves are compared.

The join is cut into pages that Spark can shuffle by the same grouping, made finer: two sets of a and b shingles with a
similarity of p percent or more differ in at most D = (a + b) (100 - p) / (100 + p) shingles. Cut the hash range into
m > D equal groups: at most D groups differ. A page is a group's content, (m, group, its shingles). Put all pages into
one order, fullest first: the first page that two linked sets share has at most D pages before it in either, so it is
among the first D + 1 of both, and those are all a set is listed on. Full pages come first because a page of one or two
common shingles is shared by chance, and one of many shingles is not.

1. Equal sets are one class, known by a 128-bit hash of the set; from then on a class is the row number of one of its
   rows. Copies that a task has listed before are not listed again.
2. One shuffle deals pages; those with one row are dropped as they stream by.
3. On every page each class is compared with the page's first class only.
4. Pages whose classes are not yet one component are searched by points: they are cut into blocks of bounded size, and
   a tree over each pair of blocks gives pairs of different components that may link. First a spanning forest of them is
   verified, then, on pages still open, every pair that was not tried before.

A pair is verified by its points, then by its sets; a class that meets many others sends its text once for each few
hundred of them. All links that matter to the components are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import KEY, keyed, slices
from vitalgrid.llm.components import components
from vitalgrid.llm.shingles import mixed, shingle_sets
from vitalgrid.session import materialize

#: Coordinates of a point, points per leaf of a tree, classes per block, and pairs that share one sent text.
COORDINATES = 256
LEAF = 256
POINT_BLOCK = 4096
PAIRS_PER_TEXT = 256
#: Rows of two longs (and a hash table's overhead) that a join may broadcast.
BROADCAST_ROWS = 500_000
#: Classes of which a task remembers that they are listed.
LISTED = 200_000


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def needed(total, percent: int):
    """The smallest overlap that links two sets with ``total`` shingles together."""
    return -(-percent * total // (100 + percent))


def point(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles % np.uint64(COORDINATES)).astype(np.int64), minlength=COORDINATES)


def packed(counts: np.ndarray) -> bytes:
    """A point in as few bytes a coordinate as its largest needs: 1, 2 or 4."""
    top = int(counts.max())
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    """Points as rows of the narrowest type that holds them all."""
    width = max(map(len, points)) // COORDINATES
    kinds = {1: "<u1", 2: "<u2", 4: "<u4"}
    out = np.empty((len(points), COORDINATES), kinds[width])
    for i, p in enumerate(points):
        out[i] = np.frombuffer(p, kinds[len(p) // COORDINATES])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the smaller coordinates, the bound of the overlap."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def levels(n: int, percent: int) -> list[tuple[int, int]]:
    """(m, D) for the partners that a set of n shingles can have, by the size of the larger of the two.

    Larger sets b have one m for each power of two of the shingles they may differ in.
    """
    largest = 100 * n // percent
    bits_of = lambda b: max(1, (2 * b * (100 - percent) // (100 + percent)).bit_length())
    out = []
    for bits in range(bits_of(n), bits_of(largest) + 1):
        m = (1 << bits) + (1 << bits >> 2)
        top = ((1 << bits) * (100 + percent) - 1) // (2 * (100 - percent)) if percent < 100 else largest
        differ = (n + min(largest, top)) * (100 - percent) // (100 + percent)
        out.append((m, min(differ, m - 1)))
    return out


def page_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The keys of the pages a set is listed on: the first D + 1 of each level, fullest first, then by key."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    keys = []
    spread = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
    for m, most in levels(len(shingles), percent):
        group = ((shingles >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        tag = group[starts].astype(np.uint64) * np.uint64(2 * m + 1) + np.uint64(m)
        found = mixed(np.add.reduceat(spread, starts) + mixed(tag))
        if len(starts) <= most:  # too few are filled: the empty ones count as well
            empty = np.setdiff1d(np.arange(m), group[starts]).astype(np.uint64)
            found = np.append(found, mixed(mixed(empty * np.uint64(2 * m + 1) + np.uint64(m))))
            sizes = np.append(sizes, np.zeros(len(empty), np.int64))
        keys.append(found[np.lexsort((found, -sizes))[: most + 1]])
    return np.concatenate(keys)


def _sets(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        listed: set[bytes] = set()
        for batch in slices(batches, 1, 1 << 20):
            sets = shingle_sets(batch.column(1), size)
            marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            pages = []
            for mark, s in zip(marks, sets, strict=True):
                pages.append(None if mark in listed else page_keys(s, percent).view(np.int64))
                if len(listed) < LISTED:
                    listed.add(mark)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(marks, pa.binary()),
                    pa.array(pages, pa.list_(pa.int64())),
                    pa.array([packed(point(s)) for s in sets], pa.binary()),
                ],
                names=["doc_id", "h", "n_shingles", "mark", "pages", "point"],
            )

    return run


def _shared_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (page, row) sorted by page: the rows of pages with more than one.

    One row is held back between batches, so a page of any length streams by.
    """
    held: tuple[int, int] | None = None  # the last row seen, and not yet known to share its page
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        page, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        before = np.concatenate([[last is not None and page[0] == last], page[1:] == page[:-1]])
        after = np.concatenate([before[1:], [False]])
        keep = before | after
        pages, rows = page[keep], row[keep]
        if held is not None and before[0]:
            pages, rows = np.append(pages, held[0]), np.append(rows, held[1])
        last = int(page[-1])
        held = None if before[-1] else (last, int(row[-1]))
        if len(pages):
            yield pa.RecordBatch.from_arrays([pa.array(pages), pa.array(rows)], names=["page", "row"])


class CountTree:
    """A tree over count vectors in flat arrays: a node keeps the largest coordinates and the smallest set below it.

    Leaves are runs of at most LEAF rows; every further level joins two nodes to one. Queries go down together.
    """

    def __init__(self, points: np.ndarray, percent: int):
        self.percent = percent
        parts = [np.arange(len(points))]
        while max(map(len, parts)) > LEAF:
            parts = [half for rows in parts for half in self._halves(points, rows)]
        self.rows = np.concatenate(parts)
        self.ends = np.cumsum([0, *map(len, parts)])
        self.points = points[self.rows]
        self.sizes = self.points.sum(axis=1, dtype=np.int64)
        corners = np.array([self.points[a:b].max(axis=0) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)])
        least = np.array([self.sizes[a:b].min() for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)])
        self.levels = [(corners, least)]
        while len(corners) > 1:
            odd = len(corners) % 2
            pad = np.concatenate([corners, corners[-1:]]) if odd else corners
            low = np.concatenate([least, least[-1:]]) if odd else least
            corners, least = np.maximum(pad[::2], pad[1::2]), np.minimum(low[::2], low[1::2])
            self.levels.append((corners, least))

    @staticmethod
    def _halves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) < 2:
            return [rows]
        inside = points[rows]
        axis = int((inside.max(axis=0).astype(np.int64) - inside.min(axis=0)).argmax())
        order = rows[np.argsort(inside[:, axis], kind="stable")]
        return [order[: len(order) // 2], order[len(order) // 2 :]]

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) numbers, in parts, of the pairs whose overlap may reach what links them."""
        sizes = queries.sum(axis=1, dtype=np.int64)
        stack = [(len(self.levels) - 1, 0, np.arange(len(queries)))]
        while stack:
            level, node, asking = stack.pop()
            corners, least = self.levels[level]
            may = overlap(queries[asking], corners[node]) >= needed(sizes[asking] + least[node], self.percent)
            asking = asking[may]
            if not len(asking):
                continue
            if level:
                below = range(2 * node, min(2 * node + 2, len(self.levels[level - 1][0])))
                stack += [(level - 1, child, asking) for child in below]
                continue
            a, b = int(self.ends[node]), int(self.ends[node + 1])
            for start in range(0, len(asking), 64):
                some = asking[start : start + 64]
                bound = overlap(queries[some][:, None, :], self.points[None, a:b, :])
                q, r = np.nonzero(bound >= needed(sizes[some][:, None] + self.sizes[None, a:b], self.percent))
                if len(q):
                    yield some[q], self.rows[a + r]


class Forest:
    """Components that grow together."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def candidates(
    groups: np.ndarray, sides: np.ndarray, points: np.ndarray, alone: bool, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components whose points allow a link, within a block or between two sides.

    A pair has at most one row in the largest component, so two rows of that are never looked at.
    """
    kinds, counts = np.unique(groups, return_counts=True)
    large = groups == kinds[counts.argmax()]
    left, right = (np.ones(len(groups), bool),) * 2 if alone else (sides == 0, sides == 1)
    rounds = [(left & ~large, right)]
    if not alone:
        rounds.append((left & large, right & ~large))
    for ask, among in rounds:
        rows, asking = np.flatnonzero(among), np.flatnonzero(ask)
        if not len(rows) or not len(asking):
            continue
        for q, r in CountTree(points[rows], percent).near(points[asking]):
            i, j = asking[q], rows[r]
            keep = groups[i] != groups[j]
            if alone:  # two rows outside the largest component would come twice
                keep &= large[j] | (i < j)
            if keep.any():
                yield i[keep], j[keep]


def _search(percent: int, forest_only: bool):
    """For mapInArrow over (page, i, j, side, node, component, point) sorted by the first three.

    Pairs (a, b) of nodes that may link, of each pair of blocks: a spanning forest of them, or all.
    """

    def block(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sides, nodes, groups = (part.column(c).to_numpy() for c in ("side", "node", "component"))
        alone = part.column("i")[0].as_py() == part.column("j")[0].as_py()
        points = unpacked(part.column("point").to_pylist())
        forest, out = Forest(), []
        for i, j in candidates(groups, sides, points, alone, percent):
            if forest_only:
                chosen = [
                    k for k, (x, y) in enumerate(zip(groups[i].tolist(), groups[j].tolist(), strict=True)) if forest.join(x, y)
                ]
                i, j = i[chosen], j[chosen]
            out.append((nodes[i], nodes[j]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []  # of the block pair that may go on in the next batch: bounded by two blocks

        def finished(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = block(pa.Table.from_batches(rows).combine_chunks())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if open_rows and tuple(key[start]) != last:
                    yield from finished(open_rows)
                    open_rows = []
                open_rows.append(batch.slice(start, end - start))
                last = tuple(key[start])
        if open_rows:
            yield from finished(open_rows)

    return run


def _bound(percent: int):
    """For mapInArrow over (a, point_a, b, point_b): the pairs whose points allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (unpacked(batch.column(k).to_pylist()) for k in (1, 3))
            total = left.sum(axis=1, dtype=np.int64) + right.sum(axis=1, dtype=np.int64)
            keep = overlap(left, right) >= needed(total, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _check_pairs(size: int, percent: int):
    """For mapInArrow over (a, way, b, text) sorted, a row without b first that has a's own text: the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in slices(batches, 3, 1 << 20):
            found = []
            for a, b, shingles in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(3), size), strict=True
            ):
                if b is None:
                    left = shingles
                elif linked(left, shingles, percent):
                    found.append((a, b))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if a count proves it small; else the join shuffles both sides."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, h (text hash), n_shingles and, for sets with shingles, ``component`` (one of its classes) per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h"))
    schema = "doc_id long, h long, n_shingles long, mark binary, pages array<long>, point binary"
    sets = rows.mapInArrow(_sets(size, percent), schema).withColumn("row", F.monotonically_increasing_id())
    sets = materialize(sets, "shingle-sets")
    filled = sets.where("n_shingles > 0")
    copies = filled.groupBy("mark").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1")
    class_of = materialize(filled.select("row", "mark").join(_small(copies.drop("n")), "mark").select("row", "node"), "classes")
    class_of = _small(class_of)
    joined = components(_links(rows, sets, class_of, size, percent))
    named = sets.select("doc_id", "h", "n_shingles", "row").join(class_of, "row", "left")
    named = named.withColumn("node", F.coalesce("node", "row")).join(_small(joined), "node", "left")
    return named.select(
        "doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component")
    )


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of ``percent`` or more).

    Null, empty and blank texts have no shingles and link with nothing, not even each other. Rows with equal doc_id get
    the component of their own text's class. A null doc_id takes part like any other and never names a component that
    holds another. Empty table: no rows. A very long text is one set, held by one task at a time. Other columns are
    ignored, whatever their names.
    """
    grouped = _grouped(docs, size, percent)
    least = grouped.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "component", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The first document (doc_id, null first, then text hash) of every component, with the columns given, each once.

    Null, empty and blank texts have no shingles and all stay. Rows equal in doc_id and text are one document: one of
    them stays. Empty table: no rows. Texts are not shuffled where the documents that go are few enough to be broadcast.
    Names after two underscores are reserved.
    """
    key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("h").alias("__h")]
    grouped = _grouped(docs, size, percent).where("n_shingles > 0")
    grouped = materialize(grouped.groupBy("component", *key).agg(F.count(F.lit(1)).alias("n")), "grouped")
    first = grouped.groupBy("component").agg(F.min(F.struct(*KEY)).alias("p"), F.count(F.lit(1)).alias("k"))
    first = first.where("k > 1").select("component", F.col("p.__id").alias("id"), F.col("p.__h").alias("h"))
    later = grouped.join(first, "component").where("__id <> id or __h <> h").select(*KEY)
    twice = grouped.where("n > 1").select(*KEY)
    apart = _small(materialize(later.unionByName(twice).distinct(), "not-alone"))
    last = _small(materialize(twice.join(later, KEY, "left_anti"), "rows-twice"))
    rows = keyed(docs)
    kept = rows.join(apart, KEY, "left_anti").unionByName(rows.join(last, KEY, "left_semi").dropDuplicates(KEY))
    return kept.select(*docs.columns)


def _links(rows: DataFrame, sets: DataFrame, class_of: DataFrame, size: int, percent: int) -> DataFrame:
    """Linked pairs (a, b) of classes that give the components."""
    listed = sets.where("n_shingles > 0 and pages is not null").select(F.explode("pages").alias("page"), "row")
    dealt = listed.repartition("page").sortWithinPartitions("page")
    shared = materialize(dealt.mapInArrow(_shared_pages, "page long, row long"), "shared-pages")
    members = shared.join(class_of, "row", "left").select("page", F.coalesce("node", "row").alias("node")).distinct()
    members = materialize(members, "page-members")
    first = members.groupBy("page").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top")
    members = materialize(members.join(first.select("page", "a"), "page"), "page-firsts")
    star = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    tried = materialize(star, "star")
    nodes = members.select("node").distinct()
    known = sets.select(F.col("row").alias("node"), "doc_id", "h", "point").join(_small(nodes), "node", "left_semi")
    known = materialize(known, "class-points")
    points = known.select("node", "point")
    texts = materialize(_texts(rows, known), "class-texts")
    links = _verified(tried, points, texts, size, percent)
    members = members.select("page", "node")
    for forest_only in (True, False):
        left_open = _open(members, components(links))
        placed = _blocks(left_open, POINT_BLOCK).join(points, "node")
        placed = placed.select("page", "i", "j", "side", "node", "component", "point")
        placed = placed.repartition("page", "i", "j").sortWithinPartitions("page", "i", "j")
        pairs = placed.mapInArrow(_search(percent, forest_only), "a long, b long").distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "tree-pairs")
        links = links.unionByName(_verified(pairs, points, texts, size, percent))
        tried = tried.unionByName(pairs)
    return links


def _verified(pairs: DataFrame, points: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; only pairs that pass the points' bound get texts."""
    left = points.select(F.col("node").alias("a"), F.col("point").alias("point_a"))
    right = points.select(F.col("node").alias("b"), F.col("point").alias("point_b"))
    placed = pairs.join(right, "b").join(left, "a").select("a", "point_a", "b", "point_b")
    near = materialize(placed.mapInArrow(_bound(percent), "a long, b long"), "near-pairs")
    ways = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_TEXT).cast("int").alias("ways"))
    near = near.join(ways, "a").withColumn("way", F.pmod(F.xxhash64("b"), "ways").cast("int"))
    own = ways.select("a", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    own = own.join(texts.withColumnRenamed("node", "a"), "a").select("a", "way", F.lit(None).cast("long").alias("b"), "text")
    other = near.join(texts.withColumnRenamed("node", "b"), "b").select("a", "way", "b", "text")
    met = own.unionByName(other).repartition("a", "way").sortWithinPartitions("a", "way", F.col("b").asc_nulls_first())
    return materialize(met.mapInArrow(_check_pairs(size, percent), "a long, b long"), "links")


def _texts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """A text for each class: that of the row it is named after."""
    wanted = known.select("node", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "h")
    named = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "h", "text")
    # rows equal in doc_id and text give the same class the same text
    return named.join(_small(wanted), ["id", "h"]).groupBy("node").agg(F.first("text").alias("text"))


def _open(members: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (page, node, component, n) of the pages of three and more classes that lie in several components.

    Pages with the same classes count once; the two classes of a page of two have been compared.
    """
    placed = members.join(_small(known), "node", "left").withColumn("component", F.coalesce("component", "node"))
    pages = (
        placed.groupBy("page")
        .agg(
            F.min("component").alias("c1"),
            F.max("component").alias("c2"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("node") % (1 << 40)).alias("h1"),
            F.sum(F.xxhash64("node", F.lit(1)) % (1 << 40)).alias("h2"),
        )
        .where("c1 <> c2 and n > 2")
    )
    once = pages.groupBy("n", "h1", "h2").agg(F.min("page").alias("page"))
    return materialize(placed.join(once.select("page", "n"), "page"), "open-pages")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Every pair of blocks of each page, i <= j; ``side`` tells which of the two a row is from."""
    cut = rows.withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select(
        "page",
        "node",
        "component",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
