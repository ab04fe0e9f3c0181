"""Queries over section, vector and question tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions import phrases as ph
from vitalgrid.functions import text as tx
from vitalgrid.operators import retrieval as rt
from vitalgrid.operators.ordering import with_scalars
from vitalgrid.plans.messages import sql_list, words
from vitalgrid.plans.registry import query
from vitalgrid.plans.waves import rounded
from vitalgrid.session import materialize, scratch_dir
from vitalgrid.sources import tables as src

TOP_CHILDREN = 6


def sections(spark, d):
    return src.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def questions(spark, d):
    return src.table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))


def question_vectors(spark, d):
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec"))
    return questions(spark, d).join(e, "item_id")


def child_links(spark, d):
    return src.table(spark, d, "embeddings").select("vec_id", (F.floor(F.col("vec_id") / 2) * 5).alias("doc_id"))


TOKENS_SQL = r"""toks AS (SELECT doc_id, CASE WHEN len(k) = 0 THEN [''] ELSE k END AS k FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]\d+\.\d+|[a-z0-9]{2,}'), lambda t: NOT (regexp_matches(t, '^\d+$') AND length(t) < 3)) AS k FROM documents)),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(k) AS term FROM toks) GROUP BY doc_id, term),
dl AS (SELECT doc_id, len(k) AS dl FROM toks),
cs AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
raw_idf AS (SELECT term, count(*) AS df, ln(max(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, cs GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf)"""
BM25_SQL = (
    TOKENS_SQL
    + r""", qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]\d+\.\d+|[a-z0-9]{2,}'), lambda t: NOT (regexp_matches(t, '^\d+$') AND length(t) < 3))) AS term FROM benchmark) GROUP BY item_id, term),
bs AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), cs GROUP BY item_id, doc_id),
lex AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs) WHERE rank <= 12 AND score > 0)"""
)
NEAR_SQL = f"""nn AS (SELECT * FROM (SELECT b.item_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity,
   row_number() OVER (PARTITION BY b.item_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
   FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v) WHERE rank <= {TOP_CHILDREN})"""
PARENT_SQL = """par AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY r) AS rank FROM (
   SELECT item_id, (vec_id // 2) * 5 AS doc_id, min(rank) AS r FROM nn GROUP BY 1, 2) WHERE doc_id IN (SELECT doc_id FROM documents))"""
FUSE_SQL = """fused AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, first_list, first_rank) AS rank FROM (
   SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l) AS first_list, arg_min(rank, l) AS first_rank FROM (SELECT item_id, doc_id, rank, 0 AS l FROM par UNION ALL SELECT item_id, doc_id, rank, 1 FROM lex) GROUP BY item_id, doc_id))"""
HYBRID_SQL = f"{BM25_SQL}, {NEAR_SQL}, {PARENT_SQL}, {FUSE_SQL}, hyb AS (SELECT * FROM fused WHERE item_id IN (SELECT item_id FROM par) OR rank <= {TOP_CHILDREN})"


def index(spark, d):
    """The stored index: texts are tokenized once, whatever reads the postings later."""
    path = scratch_dir(spark, "index")
    rt.write_index(rt.postings(sections(spark, d), "doc_id", "text"), path, "doc_id")
    return spark.read.parquet(path)


@query("inverted_index", "R1 X1 S13", f"WITH {TOKENS_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM post GROUP BY term")
def inverted_index(spark, d):
    return index(spark, d).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")
    )


@query(
    "corpus_statistics",
    "A18",
    f"WITH {TOKENS_SQL} SELECT term, df, round(idf, 6) AS idf, n_docs, round(avgdl, 6) AS avgdl FROM idf, cs",
)
def corpus_statistics(spark, d):
    posts = index(spark, d)
    stats = rt.corpus_stats(rt.section_lengths(posts, "doc_id"))
    w = rt.term_weights(posts, stats)
    return rounded(with_scalars(w, stats))


def lexical(spark, d):
    posts = materialize(rt.measured_postings(sections(spark, d), "doc_id", "text"), "postings")
    return rt.bm25(questions(spark, d), "item_id", "question", posts, rt.section_lengths(posts, "doc_id"), "doc_id", 2 * TOP_CHILDREN)


@query("bm25_search", "R2 T4 A18", f"WITH {BM25_SQL} SELECT item_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM lex")
def bm25_search(spark, d):
    return rounded(lexical(spark, d), places=5)


def children(spark, d):
    v = src.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rt.nearest(question_vectors(spark, d), "item_id", "qvec", v, "vec_id", "embedding", TOP_CHILDREN)


@query("nearest_children", "J7 D13", f"WITH {NEAR_SQL} SELECT item_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM nn")
def nearest_children(spark, d):
    return rounded(children(spark, d))


def vector_parents(spark, d):
    return rt.parents_of(children(spark, d), child_links(spark, d), sections(spark, d), "item_id", "vec_id", "doc_id")


@query("parent_expansion", "J6 S13", f"WITH {NEAR_SQL}, {PARENT_SQL} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM par")
def parent_expansion(spark, d):
    return vector_parents(spark, d)


@query("rank_fusion", "J8", f"WITH {BM25_SQL}, {NEAR_SQL}, {PARENT_SQL}, {FUSE_SQL} SELECT item_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM fused")
def rank_fusion(spark, d):
    return rounded(rt.fuse(vector_parents(spark, d), lexical(spark, d), "item_id", "doc_id"), places=9)


def hybrid(spark, d):
    return rt.hybrid(vector_parents(spark, d), lexical(spark, d), "item_id", "doc_id", TOP_CHILDREN)


@query("hybrid_retrieval", "R3 J6 J7 J8 R2", f"WITH {HYBRID_SQL} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM hyb")
def hybrid_retrieval(spark, d):
    return hybrid(spark, d).select("item_id", "doc_id", "rank")


RERANK_SQL = f"""{HYBRID_SQL}, qw AS (SELECT item_id, list_filter(list_distinct({words('lower(text)')}), lambda w: NOT list_contains({sql_list(ph.RERANK_STOP_WORDS)}, w)) AS ws FROM benchmark),
cand AS (SELECT hyb.item_id, hyb.doc_id, hyb.rank, d.text, d.source, d.lang, ws, count(*) OVER (PARTITION BY hyb.item_id) AS n FROM hyb JOIN documents d USING (doc_id) JOIN qw USING (item_id)),
ov AS (SELECT *, list_sum(list_transform(ws, lambda w: CAST((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w) AS DOUBLE))) + 5.0 * len(list_filter(ws, lambda w: contains(lower(source), w))) AS overlap FROM cand),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN n > 3 THEN -overlap ELSE 0 END, rank) AS pos FROM ov) WHERE pos <= 3)"""


def reranked(spark, d):
    c = hybrid(spark, d).join(sections(spark, d), "doc_id").join(questions(spark, d), "item_id")
    return rt.rerank(c, "item_id", "question", "doc_id", "text", "source")


@query("keyword_rerank", "T5 U2", f"WITH {RERANK_SQL} SELECT item_id, doc_id, CAST(pos AS INTEGER) AS pos, overlap FROM rr")
def keyword_rerank(spark, d):
    return reranked(spark, d).select("item_id", "doc_id", "pos", F.col("overlap").alias("overlap"))


@query(
    "retrieved_context",
    "R4 X17 X18 U3 R3 T5",
    f"""WITH {RERANK_SQL}, lb AS (SELECT item_id, pos, text, lang || ' — ' || source || ' (' || left(source, 40) || ')' AS l FROM rr), sl AS (SELECT item_id, l, min(pos) AS p FROM lb GROUP BY item_id, l)
    SELECT lb.item_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context, any_value(s) AS sources FROM lb JOIN (SELECT item_id, string_agg(l, '|' ORDER BY p) AS s FROM sl GROUP BY item_id) USING (item_id) GROUP BY lb.item_id""",
)
def retrieved_context(spark, d):
    lab = tx.source_label(F.col("lang"), F.lit(None).cast("string"), F.col("source"), F.col("source"))
    a = rt.assembled(reranked(spark, d).withColumn("label", lab), "item_id", "text", "label", least=0.45)
    return a.select("item_id", "context", F.array_join("sources", "|").alias("sources"))
