"""Ordered message operators and chat-table rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions import phrases as ph
from vitalgrid.functions import text as tx
from vitalgrid.operators.ordering import (
    blocks_with_halo,
    halo_window,
    home_rows,
    join_per_key,
    row_index,
    running_totals,
    size_bucket,
)


def numbered(messages: DataFrame) -> DataFrame:
    """0-based position of each message in its conversation; one long conversation spreads over blocks."""
    return row_index(messages, ["conv_id"], F.floor(F.col("turn") / 256).cast("bigint"), [F.col("turn")], "n_prior")


def with_recent(messages: DataFrame, n: int = 6) -> DataFrame:
    """Each message with the (at most n) messages before it, oldest first."""
    rows = blocks_with_halo(numbered(messages), ["conv_id"], "n_prior", reach=n)
    w = halo_window(["conv_id"], "n_prior").rowsBetween(-n, -1)
    return home_rows(rows.withColumn("recent", F.collect_list(F.struct("role", "text")).over(w)))


def context_text(recent: Column, width: int = 300) -> Column:
    """Recent user and assistant messages as prefixed lines, or None when there are none."""
    said = F.filter(recent, lambda m: m["role"].isin("user", "assistant"))
    lines = F.transform(
        said, lambda m: F.concat(F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), F.substring(m["text"], 1, width))
    )
    return F.when(F.size(said) == 0, "None").otherwise(F.array_join(lines, "\n"))


def tail_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """Last n messages per conversation and the number of exchanges, from positions and counts."""
    size = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    rows = join_per_key(numbered(messages), size, ["conv_id"], "turn")
    return rows.where(F.col("n_prior") >= F.col("n_messages") - n).withColumn("exchanges", F.floor(F.col("n_messages") / 2))


def route(query, prior: Column, verdict, soft_confirmed: Column) -> Column:
    """Ordered decision: guard, crisis, conversational, then the classifier's verdict."""
    return (
        F.when(tx.is_trivial(query), "guard")
        .when(tx.is_crisis(query) | (tx.is_soft_signal(query) & soft_confirmed), "crisis")
        .when(tx.is_conversational(query, prior), "conversational")
        .otherwise(tx.verdict_route(verdict))
    )


def post_processed(response, route_col: Column, lang: Column, key: Column) -> Column:
    fixed = tx.strip_opener(response)
    return tx.ensure_question(fixed, route_col, lang, key)


def vocabulary(texts: DataFrame, column: str, min_freq: int = 2) -> DataFrame:
    """Token ids after the special tokens, by count descending and token.

    Ids come from block totals: the block is the count and the token's first two characters, so the
    many tokens with one count do not meet in one task.
    """
    counts = (
        texts.select(F.explode(tx.word_tokens(column)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_freq)
    )
    wide = 1 << 21  # above every code point
    second = F.ascii(F.substring("token", 2, 1)).cast("bigint")
    bucket = size_bucket("n", F.ascii("token").cast("bigint") * wide + second, wide * wide)
    run = running_totals(counts, [], bucket, [F.col("n").desc(), F.col("token")], {"no": F.lit(1)})
    return run.select("token", "n", (F.col("no") - 1 + len(ph.SPECIAL_TOKENS)).cast("bigint").alias("id"))


def encode(texts: DataFrame, keys: Sequence[str], column: str, vocab: DataFrame, max_len: int) -> DataFrame:
    """Token ids in order, unknown tokens as UNK, cut to max_len; the vocabulary joins on the token."""
    toks = texts.select(*keys, F.posexplode_outer(F.slice(tx.word_tokens(column), 1, max_len)).alias("__pos", "__tok"))
    known = vocab.select(F.col("token").alias("__tok"), F.col("id").alias("__tid"))
    ids = toks.join(known, "__tok", "left").withColumn("__tid", F.coalesce("__tid", F.lit(ph.UNK).cast("bigint")))
    # an encoded text holds at most max_len ids; a text without tokens has none
    placed = F.when(F.col("__pos").isNotNull(), F.struct("__pos", "__tid"))
    return ids.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(placed)), lambda s: s["__tid"]).alias("ids")
    )


def decode(rows: DataFrame, keys: Sequence[str], ids: str, vocab: DataFrame) -> DataFrame:
    words = F.filter(ids, lambda i: ~i.isin(ph.PAD, ph.BOS, ph.EOS))
    flat = rows.select(*keys, F.posexplode_outer(words).alias("__pos", "__tid"))
    known = vocab.select(F.col("token").alias("__tok"), F.col("id").alias("__tid"))
    word = flat.join(known, "__tid", "left").withColumn("__tok", F.coalesce("__tok", F.lit("[UNK]")))
    placed = F.when(F.col("__pos").isNotNull(), F.struct("__pos", "__tok"))
    return word.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(placed)), lambda s: s["__tok"]), " ").alias("text")
    )


def evaluation_rollup(scored: DataFrame) -> DataFrame:
    """Totals and per-category averages of scored cases, one row per category plus the grand total."""
    q = F.col("quality_score")
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(q >= 0.6).alias("passed"),
        F.avg(q).alias("avg_quality"),
        F.avg(F.when(F.col("llm_quality") >= 0, F.col("llm_quality"))).alias("avg_judged"),
        F.count_if(~F.col("no_banned_opener")).alias("violations"),
        F.count_if(F.col("crisis_handled")).alias("crisis_correct"),
        F.count_if(F.col("category") == "crisis").alias("crisis_total"),
    ]
    return scored.rollup("category").agg(*aggs).withColumn("category", F.coalesce("category", F.lit("all")))


def feedback_summary(examples: DataFrame, least: int = 20) -> DataFrame:
    n = F.count(F.lit(1))
    return examples.agg(
        n.alias("total"),
        F.count_if(F.col("label") == 1).alias("thumbs_up"),
        F.count_if(F.col("label") == 0).alias("thumbs_down"),
        F.greatest(F.lit(0), F.lit(least) - n).alias("need_for_model"),
        F.when(n >= least, "model").otherwise("heuristic").alias("mode"),
    )
