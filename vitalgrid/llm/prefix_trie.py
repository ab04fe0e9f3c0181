"""Prefix trie of conversations: which first turns are shared, by whom, and what sharing them saves.

A prefix of d turns is named by a 128-bit digest: four 32-bit lanes, each the sum of one hash of (position, turn) over
the positions up to d. Sums of lanes are running sums, so a very long conversation is digested in blocks and not in one
task. Distinct digests are the nodes; members, smallest member and turns below are counted in parts before a node's
rows meet.

Node tables. A node with at least ``heavy`` turns at or below it is heavy. Below the heavy ones the trie falls apart
into subtrees of fewer than ``heavy`` turns, so of fewer nodes; subtrees are dealt over shards by the digest of their
top. A shard enumerates its digests and gives each a slot by a minimal perfect hash (levels of bit sets: keys alone at
their place stay, the rest try the next level; a slot is a place's rank). A digest is looked up by its slot and counts
as found only if the slot holds the same 128 bits, so a parent in another shard is not taken for one of this shard's.
Counts are scattered into flat arrays by slot, and children, leaves and savings are added up through the array of parent
slots, deepest nodes first.

The heavy nodes hold what the shards hand up. There are at most (turns / heavy) of them at any depth, but they may form
a very long path, so their sums double in reach each round (2^k levels below), by joins.

A node's list of ends is hashed as a stream in conv_id order; a list may be long, memory is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.operators.ordering import row_index
from vitalgrid.session import materialize

HEAVY = 1 << 17
#: Nodes per shard aimed at; a shard holds one subtree more at most.
SHARD = 1 << 17
MASK = (1 << 32) - 1
NODE = ["p1", "p2"]
PARENT = ["q1", "q2"]
#: Positions of a conversation that are ordered and summed together.
BLOCK = 4096


def base_and_head(conv: Column) -> tuple[Column, Column]:
    """The conversation whose first turns are taken, and how many of them: crc32 of the decimal id, modulo 9."""
    return conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (1-based, by turn, nulls first, then role and text), hashes and bytes of each turn."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("tie"),
        F.xxhash64(role, text).alias("d1"),
        F.xxhash64(F.lit(1), role, text).alias("d2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    bucket = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    numbered = row_index(rows, ["conv_id"], bucket, order, "k")
    return numbered.select("conv_id", (F.col("k") + 1).alias("k"), "d1", "d2", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, pos, hashes and bytes of the rebuilt conversations: the first turns of the base, then the own rest."""
    sizes = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    base, head = base_and_head(F.col("conv_id"))
    plan = sizes.select("conv_id", base.alias("base"), head.cast("long").alias("h"))
    heads = turns.where("k <= 8").select(F.col("conv_id").alias("base"), "k", "d1", "d2", "bytes")
    first = plan.join(heads, "base").where("k <= h").select("conv_id", F.col("k").alias("pos"), "d1", "d2", "bytes")
    base_sizes = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = (
        plan.join(base_sizes, "base", "left")
        .select("conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    )
    rest = turns.join(taken, "conv_id").where("k > h")
    rest = rest.select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("pos"), "d1", "d2", "bytes")
    return first.unionByName(rest)


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row per rebuilt conversation and depth, from 0: conv_id, depth, digests of prefix and parent, length, bytes."""
    turns = materialize(numbered_turns(conversations), "turns")
    rows = materialize(rebuilt(turns), "rebuilt")
    lane = lambda i: F.xxhash64(F.lit(i), "pos", "d1", "d2").bitwiseAND(F.lit(MASK))
    lanes = rows.withColumns({f"t{i}": lane(i) for i in range(4)})
    lanes = lanes.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK).cast("long"))
    # whole numbers: a block adds at most 2^44, and block totals are reduced before they are added
    totals = lanes.groupBy("conv_id", "block").agg(*[(F.sum(f"t{i}") % (1 << 32)).alias(f"o{i}") for i in range(4)])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"o{i}": F.coalesce(F.sum(f"o{i}").over(earlier), F.lit(0)) for i in range(4)})
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = lanes.withColumns({f"s{i}": F.sum(f"t{i}").over(inside) for i in range(4)})
    summed = local.join(totals, ["conv_id", "block"])
    summed = summed.withColumns(
        {f"s{i}": (F.col(f"s{i}") + F.col(f"o{i}")) % (1 << 32) for i in range(4)}
        | {f"b{i}": (F.col(f"s{i}") + F.col(f"o{i}") - F.col(f"t{i}")) % (1 << 32) for i in range(4)}
    )
    pack = lambda a, b: F.shiftleft(F.col(a), 32).bitwiseOR(F.col(b))
    lengths = rows.groupBy("conv_id").agg(F.max("pos").alias("length"))
    everyone = turns.select("conv_id").distinct().join(lengths, "conv_id", "left")
    everyone = materialize(everyone.select("conv_id", F.coalesce("length", F.lit(0)).alias("length")), "lengths")
    zero = F.lit(0).cast("long")
    root = everyone.select(
        "conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"),
        F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), "length", zero.alias("bytes"),
    )
    below = summed.join(everyone, "conv_id").select(
        "conv_id", F.col("pos").cast("long").alias("depth"), pack("s0", "s1").alias("p1"), pack("s2", "s3").alias("p2"),
        pack("b0", "b1").alias("q1"), pack("b2", "b3").alias("q2"), "length", "bytes",
    )
    return materialize(root.unionByName(below), "prefixes")


def node_counts(rows: DataFrame) -> DataFrame:
    """A row per distinct prefix: members, smallest member, turns at and below it, bytes of its last text."""
    return rows.groupBy(*NODE, "depth").agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        F.min("bytes").alias("bytes"),
        F.min("q1").alias("q1"),
        F.min("q2").alias("q2"),
    )


# ---- minimal perfect hash ----


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each 128-bit key (two columns of unsigned 64-bit words) for a level."""
    x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD6E8FEB86659FD93) & (2**64 - 1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0 .. n - 1 for n distinct 128-bit keys, and the slots' own keys to verify a lookup.

    A level has twice as many places as keys left. A key alone at its place stays there; its slot is the number of
    taken places before it. Keys that no level has separated after ``levels`` are kept in a dictionary.
    """

    def __init__(self, keys: np.ndarray, levels: int = 40) -> None:
        self.places: list[tuple[int, np.ndarray, int]] = []
        self.rest: dict[tuple[int, int], int] = {}
        left, at = keys, 0
        for level in range(levels):
            if not len(left):
                break
            width = 2 * len(left)
            place = (_mixed(left, level) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(place, minlength=width)[place] == 1
            taken = np.zeros(width, dtype=bool)
            taken[place[alone]] = True
            rank = np.where(taken, np.cumsum(taken) - 1, -1)
            self.places.append((width, rank, at))
            at += int(alone.sum())
            left = left[~alone]
        for key in left:
            self.rest[(int(key[0]), int(key[1]))] = at
            at += 1
        self.keys = np.zeros((len(keys), 2), dtype=np.uint64)
        self.keys[self._candidates(keys)] = keys

    def _candidates(self, keys: np.ndarray) -> np.ndarray:
        """The slot a key would have; -1 where no level has one."""
        slots = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (width, rank, at) in enumerate(self.places):
            if not len(left):
                break
            found = rank[(_mixed(keys[left], level) % np.uint64(width)).astype(np.int64)]
            slots[left[found >= 0]] = found[found >= 0] + at
            left = left[found < 0]
        if self.rest:
            for i in left:
                slots[i] = self.rest.get((int(keys[i, 0]), int(keys[i, 1])), -1)
        return slots

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key that is in the table, -1 for any other."""
        slots = self._candidates(keys)
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        same = (self.keys[slots] == keys).all(axis=1)  # slot -1 reads the last key and is never taken
        return np.where(same & (slots >= 0), slots, -1)


def _words(table: pa.Table, names: list[str]) -> np.ndarray:
    columns = [table.column(c).fill_null(0).to_numpy().astype(np.int64).view(np.uint64) for c in names]
    return np.stack(columns, axis=1)


def _shard(table: pa.Table) -> pa.Table:
    """Adds slot, children, leaves, savings and the parent's smallest member to the nodes of one shard."""
    keys = _words(table, NODE)
    index = PerfectHash(keys)
    slot = index.lookup(keys)
    size = len(keys)
    if len(np.unique(slot)) != size or (size and slot.min() < 0):
        raise ValueError("two prefixes have one digest")
    parent_known = ~table.column("q1").is_null().to_numpy()
    found = np.where(parent_known, index.lookup(_words(table, PARENT)), -1)

    def scattered(values: np.ndarray) -> np.ndarray:
        flat = np.zeros(size, dtype=np.int64)
        flat[slot] = values
        return flat

    number = lambda c: table.column(c).to_numpy().astype(np.int64)
    conv, convs, depth = scattered(number("conv_id")), scattered(number("n_convs")), scattered(number("depth"))
    saved = scattered((number("n_convs") - 1) * number("bytes"))
    parent = np.full(size, -1, dtype=np.int64)
    parent[slot] = found
    inside = parent >= 0
    children = np.bincount(parent[inside], minlength=size)
    leaves = (children == 0).astype(np.int64)
    # deepest first: a node is complete before it is added to its parent
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = np.where(inside, conv[parent], 0)
    out = {c: table.column(c).combine_chunks() for c in [*NODE, "depth", *PARENT, "conv_id", "n_convs"]}
    out |= {
        "parent_conv_id": pa.array(above[slot], mask=~inside[slot]),
        "n_children": pa.array(children[slot]),
        "n_leaves": pa.array(leaves[slot]),
        "saved_tokens": pa.array(saved[slot]),
        "shard": table.column("shard").combine_chunks(),
        "slot": pa.array(slot),
        "top": pa.array(~inside[slot]),
    }
    return pa.table(out)


SHARDED = (
    "p1 long, p2 long, depth long, q1 long, q2 long, conv_id long, n_convs long, parent_conv_id long, "
    "n_children long, n_leaves long, saved_tokens long, shard int, slot long, top boolean"
)


def sharded(nodes: DataFrame, heads: DataFrame, rows: DataFrame, shard_size: int) -> DataFrame:
    """The light nodes, each in the shard of its subtree's top.

    A node's top is on the path of its smallest member, right below that conversation's last heavy node.
    """
    light = nodes.join(heads.select(*NODE, "depth"), [*NODE, "depth"], "left_anti")
    deepest = rows.join(heads.select(*NODE, "depth"), [*NODE, "depth"]).groupBy("conv_id").agg(F.max("depth").alias("last"))
    deepest = rows.select("conv_id", "depth", *NODE).join(
        deepest.select("conv_id", (F.col("last") + 1).alias("depth")), ["conv_id", "depth"]
    )
    tops = deepest.select("conv_id", F.struct(*NODE).alias("under"))
    shards = F.lit(max(1, -(-light.count() // shard_size)))
    shard = F.pmod(F.coalesce(F.xxhash64("under"), F.lit(0)), shards).cast("int")  # no heavy node: one shard holds all
    dealt = light.join(tops, "conv_id", "left")
    dealt = dealt.withColumn("shard", F.when(F.col("under").isNotNull(), shard).otherwise(0))
    columns = [*NODE, "depth", *PARENT, "conv_id", "n_convs", "bytes", "shard"]
    return dealt.select(*columns).groupBy("shard").applyInArrow(_shard, SHARDED)


def _crown(heads: DataFrame, light: DataFrame) -> DataFrame:
    """Children, leaves and savings of the heavy nodes: what the shards hand up, then sums that double in reach."""
    parent = [F.col(q).alias(p) for q, p in zip(PARENT, NODE)]
    handed = light.where("top and q1 is not null").groupBy(*parent).agg(
        F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("savings")
    )
    own = heads.where("q1 is not null").groupBy(*parent).agg(F.count(F.lit(1)).alias("heavy_kids"))
    heads = heads.join(handed, NODE, "left").join(own, NODE, "left").fillna(0, ["kids", "leaves", "savings", "heavy_kids"])
    heads = heads.withColumn("n_children", F.col("kids") + F.col("heavy_kids"))
    state = heads.select(
        *NODE, "depth", "conv_id", "n_convs", *PARENT, "n_children",
        (F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("n_leaves"),
        (F.col("savings") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        F.col("q1").alias("u1"), F.col("q2").alias("u2"),
    )
    state = materialize(state, "crown")
    # (u1, u2): the ancestor 2^k levels up; sums cover fewer than 2^k levels below
    while state.where("u1 is not null").limit(1).count():
        sent = state.where("u1 is not null").groupBy(F.col("u1").alias("p1"), F.col("u2").alias("p2")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
        )
        up = state.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        state = state.join(sent, NODE, "left").fillna(0, ["more_leaves", "more_saved"]).join(up, ["u1", "u2"], "left")
        state = materialize(
            state.select(
                *NODE, "depth", "conv_id", "n_convs", *PARENT, "n_children",
                (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
                (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"),
                F.col("v1").alias("u1"), F.col("v2").alias("u2"),
            ),
            "crown",
        )
    return state.drop("u1", "u2")


def _digest_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conv_id; a digest per node, one open at a time."""
    node, state, out = None, None, []
    for batch in batches:
        for p1, p2, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (p1, p2) == node:
                state.update(b",%d" % conv)
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = (p1, p2), hashlib.sha256(b"%d" % conv)
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(("p1", "p2", "ends_sha256"), r)) for r in out])
            out = []
    if node is not None:
        out.append((*node, state.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(("p1", "p2", "ends_sha256"), r)) for r in out])


def conversation_trie(conversations: DataFrame, heavy: int = HEAVY, shard_size: int = SHARD) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, shard, slot.

    ``shard`` and ``slot`` tell where the node table holds it; both are null for heavy nodes. Null roles and texts are
    empty ones. Turns are ordered by number (null first), then role, then the text's SHA-256, so repeated rows stand
    side by side and each is a turn. Rows without conv_id belong to no conversation and are left out. Very long texts
    are hashed where they are read and never shuffled. A conversation without turns after rebuilding ends at the root.
    Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = prefixes(conversations.select("conv_id", "turn", "role", "text"))
    nodes = materialize(node_counts(rows), "nodes")
    heads = materialize(nodes.where(F.col("weight") >= heavy), "heavy")
    light = materialize(sharded(nodes, heads, rows, shard_size), "slots")
    crown = _crown(heads, light)
    above = heads.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
    parts = light.drop("top").unionByName(
        crown.withColumns({c: F.lit(None).cast(t) for c, t in (("parent_conv_id", "long"), ("shard", "int"), ("slot", "long"))})
    )
    # parents are heavy for these only; the rest have theirs from the shard, and need no key to meet
    lacking = parts.where("parent_conv_id is null and q1 is not null").join(above, PARENT, "left")
    lacking = lacking.withColumn("parent_conv_id", F.col("above")).drop("above")
    whole = parts.where("parent_conv_id is not null or q1 is null").unionByName(lacking)
    ends = rows.where("depth = length").select(*NODE, "conv_id")
    ends = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    ends = ends.mapInArrow(_digest_streams, "p1 long, p2 long, ends_sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "shard", "slot",
    )
