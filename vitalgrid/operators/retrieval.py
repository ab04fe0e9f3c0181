"""Search over section and vector tables: inverted index, BM25, nearest vectors, fusion, re-rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions import phrases as ph
from vitalgrid.functions import text as tx
from vitalgrid.operators import maxscore
from vitalgrid.operators import pivots as pv
from vitalgrid.operators.ordering import with_scalars
from vitalgrid.session import materialize

# BM25 parameters, the floor of negative idf, and the fusion constant.
K1, B, FLOOR, RRF_K = 1.5, 0.75, 0.25, 60
BROADCAST_ROWS = 200_000
QUERY_BLOCK = 2048
SHARD_ROWS = 100_000
#: Sections whose terms one task counts.
SECTIONS_PER_TASK = 2048


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side only after counting that it is small; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


# ------------------------------------------------------------ index


def in_tasks_of_sections(sections: DataFrame, key: str) -> DataFrame:
    """Rows dealt by section, a bounded number of sections to a task, so that counts inside a section need no shuffle."""
    parts = -(-sections.count() // SECTIONS_PER_TASK)
    return sections.repartition(max(1, parts), key)


def postings(sections: DataFrame, key: str, text: str) -> DataFrame:
    """Term counts per section: texts move once by section, postings do not."""
    dealt = in_tasks_of_sections(sections.select(key, F.col(text).alias("__text")), key)
    return dealt.select(key, F.explode(tx.search_tokens("__text")).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def measured_postings(sections: DataFrame, key: str, text: str) -> DataFrame:
    """Term counts per section beside its token count ``dl``: texts move once by section, postings do not.

    A task has a bounded number of sections. A plan that runs its input twice, such as a sort by ranges, should read
    these from a table.
    """
    dealt = in_tasks_of_sections(sections.select(key, tx.search_tokens(text).alias("__t")), key)
    dealt = dealt.withColumn("dl", F.sum(F.size("__t")).over(Window.partitionBy(key)))
    return dealt.select(key, "dl", F.explode("__t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def section_lengths(posts: DataFrame, key: str) -> DataFrame:
    """Token count per section, from its postings."""
    return posts.groupBy(key).agg(F.sum("tf").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_weights(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """Document frequency and idf per term; negative idf becomes a share of the mean idf.

    Postings are counted once, into a table of terms that the mean and the result both read.
    """
    counts = materialize(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term_counts")
    df = with_scalars(counts, stats.select("n_docs"))
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    out = with_scalars(raw, mean)
    return out.select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def write_index(posts: DataFrame, path: str, key: str) -> None:
    """Postings in segments: a file holds the sections of one task of ``postings``, sorted by term.

    No posting moves for it, and a frequent term is in every segment, its rare ones in few. A segment's terms are in
    order, so a reader skips the row groups without its term.
    """
    posts.sortWithinPartitions("term", key).write.parquet(path)


# ------------------------------------------------------------ BM25


def bm25(queries: DataFrame, qkey: str, qtext: str, posts: DataFrame, lengths: DataFrame, key: str, k: int) -> DataFrame:
    """Top-k sections per query, positive scores only, ranked from 1; ``key`` and ``qkey`` are whole numbers.

    Postings of the queried terms move once, as impacts, to shards of sections; a shard leaves long lists unread where
    they cannot change the best k (``operators.maxscore``) and sends k rows a query on.
    """
    scored = scored_sections(queries, qkey, qtext, posts, lengths, key, k)
    top = Window.partitionBy(qkey).orderBy(F.round("score", 9).desc(), key)
    ranked = scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select(qkey, key, "score", "rank")


def scored_sections(queries: DataFrame, qkey: str, qtext: str, posts: DataFrame, lengths: DataFrame, key: str, k: int) -> DataFrame:
    """The k best sections of every shard per query, with ``met``: the postings and sections looked at there."""
    n_sections, avgdl = corpus_stats(lengths).first()
    stats = queries.sparkSession.range(1).select(F.lit(n_sections).cast("long").alias("n_docs"))
    terms = (
        queries.select(F.col(qkey).cast("long").alias("__q"), F.explode(tx.search_tokens(qtext)).alias("term"))
        .groupBy("__q", "term")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    terms = materialize(terms, "query_terms")
    wanted = broadcast_if_small(terms.select("term").distinct())
    weights = materialize(term_weights(posts, stats).join(wanted, "term", "left_semi"), "query_weights")
    n_queries = terms.agg(F.count_distinct("__q")).first()[0]
    if not n_sections or not n_queries:
        return terms.select(F.col("__q").alias(qkey), F.col("__q").alias(key), F.lit(0.0).alias("score"), F.col("w").alias("met")).limit(0)
    lists = maxscore.impacts(posts, lengths, broadcast_if_small(weights), avgdl, key, K1, B)
    found = maxscore.best_sections(terms, lists, n_sections, n_queries, key, k)
    return found.select(F.col("__q").alias(qkey), F.col("__section").alias(key), "score", "met")


# ------------------------------------------------------------ nearest vectors


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _similarity(q, vecs, metric):
    v = np.asarray(vecs, dtype=float)
    if metric == "cosine":
        return _unit(q) @ _unit(v).T
    # negative squared distance
    return 2.0 * (q @ v.T) - (q * q).sum(1)[:, None] - (v * v).sum(1)[None, :]


def _keep_best(qids, q, ids, vecs, k, best, metric):
    """Merge one batch of vectors into the k best (similarity, id) of each query; equal ones by id."""
    sims = _similarity(q, vecs, metric)
    ids = np.asarray(ids)
    take = min(k, sims.shape[1])
    for i in range(len(qids)):
        s = sims[i]
        cut = np.partition(s, len(s) - take)[len(s) - take]
        where = np.flatnonzero(s >= cut)
        if len(where) > take:
            where = where[np.lexsort((ids[where], -s[where]))[:take]]
        best[i] = sorted(best[i] + [(-float(s[j]), int(ids[j])) for j in where])[:k]


def _frame(qids, best):
    rows = [(q, i, -s) for q, b in zip(qids, best) for s, i in b]
    return pd.DataFrame(rows, columns=["__q", "__id", "similarity"]).astype({"__q": "int64", "__id": "int64", "similarity": "float64"})


_PARTIAL = "__q bigint, __id bigint, similarity double"


def nearest(
    queries: DataFrame, qkey: str, qvec: str, vectors: DataFrame, key: str, vec: str, k: int, metric: str = "cosine", block: int = QUERY_BLOCK
) -> DataFrame:
    """Exact top-k per query by cosine or distance, ranked from 1.

    Vectors stay where they are: each task keeps k candidates per query and only those move. More
    queries than one block holds meet the shards of vectors that can hold a neighbour.
    """
    q = queries.select(F.col(qkey).cast("bigint").alias("__q"), F.col(qvec).alias("__v"))
    v = vectors.select(F.col(key).cast("bigint").alias("__id"), F.col(vec).alias("__e"))
    head = q.limit(block + 1).collect()  # never more than one block
    if len(head) <= block:
        if not head:
            part = q.sparkSession.createDataFrame([], _PARTIAL)
        else:
            qids = [r["__q"] for r in head]
            q_mat = np.asarray([list(r["__v"]) for r in head], dtype=float)

            def scan(batches):
                best = [[] for _ in qids]
                for pdf in batches:
                    if len(pdf):
                        _keep_best(qids, q_mat, pdf["__id"].to_numpy(), np.stack(pdf["__e"].to_numpy()), k, best, metric)
                yield _frame(qids, best)

            part = v.mapInPandas(scan, _PARTIAL)
    else:
        part = _by_pivots(q, v, k, metric)
    w = Window.partitionBy("__q").orderBy(F.col("similarity").desc(), "__id")
    ranked = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("__q").alias(qkey), F.col("__id").alias(key), "similarity", "rank")


def _by_pivots(q: DataFrame, v: DataFrame, k: int, metric: str, shard: int = SHARD_ROWS) -> DataFrame:
    """Queries meet only the groups of shards that can hold one of their k nearest, by the triangle inequality.

    Vectors go to the cell of their nearest pivot (a bounded number of vectors, the first by hash), large cells in
    several shards, in order of their distance to the pivot. Each shard leaves a row of its radii: with the pivots these
    bound from above the distance of a query's k-th neighbour, and from below that of any vector of a shard. A query is
    sent once to each group of neighbouring shards that it may need, and compared there in blocks. A task meets at most
    about ``shard`` vectors and as many queries; more queries come in blocks, each with its copy of the vectors.
    Cosines go by distances of unit vectors.
    """
    pivots = pv.choose(v, metric)
    placed = pv.placed(v, pivots, metric, shard)
    shards = materialize(pv.radii(placed), "shards")
    blocks = max(1, -(-q.count() // shard))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    vectors = pv.in_groups(placed, pivots, shards, shard).withColumn("block", each)
    asked = pv.visits(q, pivots, shards, k, metric, shard).withColumn("block", F.pmod(F.xxhash64("__q"), F.lit(blocks)).cast("int"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return pv.compared(left, right, k, metric)

    return vectors.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(meet, _PARTIAL)


def parents_of(children: DataFrame, links: DataFrame, sections: DataFrame, qkey: str, child: str, parent: str) -> DataFrame:
    """First-hit order of distinct parents; parents that are not stored drop."""
    hits = children.join(links, child).groupBy(qkey, parent).agg(F.min("rank").alias("__r"))
    stored = hits.join(sections.select(parent), parent, "left_semi")
    w = Window.partitionBy(qkey).orderBy("__r")  # at most k rows per query
    return stored.select(qkey, parent, F.row_number().over(w).alias("rank"))


def fuse(vector: DataFrame, lexical: DataFrame, qkey: str, parent: str) -> DataFrame:
    """Reciprocal rank fusion; ties keep the vector list's order, then the lexical list's."""
    both = vector.select(qkey, parent, "rank", F.lit(0).alias("list")).unionByName(
        lexical.select(qkey, parent, "rank", F.lit(1).alias("list"))
    )
    s = both.groupBy(qkey, parent).agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("__first")
    )
    w = Window.partitionBy(qkey).orderBy(F.round("score", 12).desc(), "__first")  # at most both lists per query
    return s.select(qkey, parent, "score", F.row_number().over(w).alias("rank"))


def hybrid(vector: DataFrame, lexical: DataFrame, qkey: str, parent: str, k: int) -> DataFrame:
    """Fusion of both lists; a query without vector hits keeps its k best lexical hits."""
    has_vector = vector.select(qkey).distinct().withColumn("__v", F.lit(True))
    out = fuse(vector, lexical, qkey, parent).join(has_vector, qkey, "left")
    return out.where(F.col("__v").isNotNull() | (F.col("rank") <= k)).drop("__v")


def rerank(cands: DataFrame, qkey: str, qtext: str, parent: str, content: str, title: str, top: int = 3) -> DataFrame:
    """Keyword overlap re-rank to the top few; short lists keep their order."""
    qwords = F.filter(F.array_distinct(tx.words(F.lower(F.col(qtext)))), lambda w: ~w.isin(*ph.RERANK_STOP_WORDS))

    def total(ws):
        hits = tx.bind(
            F.lower(F.col(content)),
            lambda t: F.aggregate(
                ws, F.lit(0.0), lambda a, w: a + (F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)
            ),
        )
        named = tx.bind(F.lower(F.col(title)), lambda t: F.size(F.filter(ws, lambda w: F.contains(t, w))))
        return hits + 5.0 * named

    scored = cands.withColumn("overlap", tx.bind(qwords, total))
    w = Window.partitionBy(qkey)  # at most both candidate lists per query
    n = F.count(F.lit(1)).over(w)
    order = F.when(F.col("__n") > top, -F.col("overlap")).otherwise(F.lit(0.0))
    ranked = scored.withColumn("__n", n).withColumn("pos", F.row_number().over(w.orderBy(order, "rank")))
    return ranked.where(F.col("pos") <= top).drop("__n")


def assembled(top: DataFrame, qkey: str, content: str, label: str, least: float | None = None) -> DataFrame:
    """Context text and distinct source labels per query from its few re-ranked sections."""
    rows = top if least is None or "section_score" not in top.columns else top.where(F.col("section_score") >= least)
    g = rows.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(content).alias("c"), F.col(label).alias("l")))).alias("__s"))
    return g.select(
        qkey,
        F.array_join(F.transform("__s", lambda s: s["c"]), "\n\n---\n\n").alias("context"),
        F.array_distinct(F.transform("__s", lambda s: s["l"])).alias("sources"),
    )
