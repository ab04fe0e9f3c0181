"""BM25 over stored impacts with a stop rule: lists that cannot change a query's best k are not read through.

A posting's impact is what its term adds to a section's score per occurrence in the query; it is computed once, when the
lists are built. Sections are dealt over shards of bounded size, and a shard has one list per term, in section order,
with the list's largest impact. Queries meet shards in blocks. In a shard a query takes its lists by the most they can
add; once what the rest can add together is less than the k-th best score so far, no new section can come up. From then
on only sections already met, and still able to reach that score, are looked up in the remaining lists, which are the
long lists of frequent terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_SECTIONS = 1 << 16
QUERY_BLOCK = 256
#: Scores are ranked to nine places; sections closer than this to the bound are kept in the running.
SLACK = 1e-7

FOUND = "__q long, __section long, score double, met long"


class Lists:
    """The lists of one shard: per term, places of sections (ascending) and their impacts."""

    def __init__(self, terms: list[str], sections: list[np.ndarray], impacts: list[np.ndarray]) -> None:
        self.sections = np.unique(np.concatenate(sections)) if sections else np.zeros(0, np.int64)
        self.lists = {}
        for term, keys, impact in zip(terms, sections, impacts, strict=True):
            self.lists[term] = (np.searchsorted(self.sections, keys), impact)
        #: A negative impact (a corpus in which most words are in most sections) has no useful bound.
        self.bounded = all(len(i) == 0 or i.min() >= 0 for _, i in self.lists.values())

    @staticmethod
    def _looked_up(lists: list, places: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, int]:
        """The scores with what the lists add, and how many places were compared, from the shorter side."""
        score = score.copy()
        for _, weight, own, impacts in lists:
            at = np.searchsorted(own, places)
            at[at == len(own)] = 0
            hit = own[at] == places
            score[hit] += weight * impacts[at[hit]]
        return score, sum(min(len(own), len(places)) for _, _, own, _ in lists)

    def best(self, query: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Section keys and scores of the k best positive scores, and how many postings and sections were looked at."""
        lists = [(w * float(self.lists[t][1].max()), w, *self.lists[t]) for t, w in query if t in self.lists]
        lists.sort(key=lambda x: -x[0])
        rest = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0.0)
        score, seen = np.zeros(len(self.sections)), np.zeros(len(self.sections), bool)
        least, met, n, since = -np.inf, 0, 0, 0
        while n < len(lists) and not (self.bounded and least - SLACK > rest[n]):
            _, weight, places, impacts = lists[n]
            score[places] += weight * impacts
            seen[places] = True
            met += len(places)
            since += len(places)
            n += 1
            if self.bounded and since >= 2 * k * (len(lists) - n):
                # a few that lead so far are looked up in the other lists, once that costs no more than the reading
                # since the last time: their k-th best is a bound early on
                left = np.flatnonzero(seen)
                if len(left) >= k:
                    some = min(len(left), 2 * k)
                    lead = left[np.argpartition(score[left], len(left) - some)[len(left) - some :]]
                    whole, looked = self._looked_up(lists[n:], lead, score[lead])
                    met, since = met + looked, 0
                    least = max(least, np.partition(whole, len(whole) - k)[len(whole) - k])
        left = np.flatnonzero(seen)
        for m in range(n, len(lists)):
            left = left[score[left] + rest[m] >= least - SLACK]
            score[left], looked = self._looked_up(lists[m : m + 1], left, score[left])
            met += looked
            now = score[left]
            if len(now) >= k:
                least = max(least, np.partition(now, len(now) - k)[len(now) - k])
        left = left[score[left] > 0]
        order = np.lexsort((self.sections[left], -np.round(score[left], 9)))[:k]
        return self.sections[left[order]], score[left[order]], met


def impacts(posts: DataFrame, lengths: DataFrame, weights: DataFrame, avgdl: float, key: str, k1: float, b: float) -> DataFrame:
    """(key, term, impact) of the given terms' postings; those that carry their section's ``dl`` need no lengths."""
    near = posts.join(weights.select("term", "idf"), "term")
    if "dl" not in posts.columns:
        near = near.join(lengths, key)
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(avgdl))
    return near.select(key, "term", (F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + norm))).alias("impact"))


def best_sections(terms: DataFrame, lists: DataFrame, n_sections: int, n_queries: int, key: str, k: int) -> DataFrame:
    """Per query and shard the k best sections: __q, __section, score and met (postings and sections looked at).

    ``terms`` has (__q, term, w), ``lists`` (key, term, impact). A shard's postings go to its tasks once per block of
    queries; both sides of a task are bounded by the sizes of shards and blocks.
    """
    shards = max(1, -(-n_sections // SHARD_SECTIONS))
    tasks = terms.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_queries // QUERY_BLOCK), min(n_queries, -(-tasks // shards)))
    shard, block = F.pmod(F.xxhash64(key), F.lit(shards)), F.pmod(F.xxhash64("__q"), F.lit(blocks))
    held = lists.groupBy(shard.alias("__shard"), "term").agg(
        F.array_sort(F.collect_list(F.struct(F.col(key).cast("long").alias("s"), "impact"))).alias("__l")
    )
    held = held.select(
        "__shard",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__block"),
        "term",
        F.col("__l.s").alias("s"),
        F.col("__l.impact").alias("i"),
    )
    asked = terms.select(block.alias("__block"), "__q", "term", F.col("w").cast("double").alias("w"))
    asked = asked.withColumn("__shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float, int]] = []
        if left.num_rows and right.num_rows:
            arrays = [[np.asarray(x.values) for x in left.column(c)] for c in ("s", "i")]
            shard_lists = Lists(left.column("term").to_pylist(), *arrays)
            queries: dict[int, list[tuple[str, float]]] = {}
            for q, term, w in zip(*(right.column(c).to_pylist() for c in ("__q", "term", "w")), strict=True):
                queries.setdefault(q, []).append((term, w))
            for q, wanted in queries.items():
                sections, scores, met = shard_lists.best(wanted, k)
                out += [(q, int(s), float(x), met) for s, x in zip(sections, scores, strict=True)]
        names = ["__q", "__section", "score", "met"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return held.groupBy("__block", "__shard").cogroup(asked.groupBy("__block", "__shard")).applyInArrow(meet, FOUND)
