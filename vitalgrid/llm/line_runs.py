"""Repeated runs of lines, found with a suffix array over line ids, later copies deleted.

Built-in functions only. The corpus is one sequence of line ids per document; blank lines are left out. Suffixes are
ranked by prefix doubling: a suffix's rank at level k orders it by its first 2^k lines, and the rank at level k + 1
comes from the pair (rank at i, rank at i + 2^k). A rank is the first place of its bucket in the suffix array, so a
bucket is refined by itself: new rank = old rank + suffixes of the bucket with a smaller second rank. Suffixes alone in
their bucket repeat nothing longer and leave.

A run counts from ``min_words`` words. Blank lines aside every line has a word, so a shortest such run has at most
``min_words`` lines, and levels beyond that are not needed: the array is sorted as deep as any answer looks. Two runs
of l lines (2^k <= l < 2^(k+1)) are equal when their level-k ranks agree at both the first and the last 2^k lines: such
runs are the intervals of the array whose common prefixes have l lines or more. Every line of a maximal repeated run
lies in a shortest run that starts or ends inside it, so the union of these, each but its first occurrence, is the
union of all later copies of maximal runs.

Hot lines: counts are taken before any ordering, ordered sums are split by ranges of the second rank, joins may be
split by Spark, and no window holds more than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import KEY, keyed, text_or_empty, without_numbers
from vitalgrid.operators.ordering import running_totals
from vitalgrid.session import materialize

TRIM = " \t\x0b\x0c\r"
MIN_WORDS = 50


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per non-blank line: row key, pos (among those), line (its number), id, and the lengths of the shortest
    runs from it and to it.

    Rows equal in doc_id and text are one document.
    """
    words = r"[^\x20\x09-\x0D]+"
    each = F.filter(
        F.transform(
            F.split(text_or_empty(), "\n"),
            lambda x, i: F.struct(
                i.alias("line"),
                F.xxhash64(F.btrim(x, F.lit(TRIM))).alias("id"),
                F.regexp_count(x, F.lit(words)).alias("n"),
            ),
        ),
        lambda s: s["n"] > 0,
    )
    rows = keyed(docs.select("doc_id", "text")).select(*KEY, each.alias("lines")).dropDuplicates(KEY)
    lines = rows.select(*KEY, F.posexplode("lines").alias("pos", "l")).select(*KEY, "pos", "l.line", "l.id", "l.n")
    doc = Window.partitionBy(*KEY)
    lines = lines.withColumn("upto", F.sum("n").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumns({"before": F.col("upto") - F.col("n"), "all": F.sum("n").over(doc)})
    ahead = F.count(F.lit(1)).over(doc.orderBy("before").rangeBetween(0, min_words - 1))
    back = F.count(F.lit(1)).over(doc.orderBy("upto").rangeBetween(1 - min_words, 0))
    return lines.select(
        *KEY,
        "pos",
        "line",
        "id",
        F.when(F.col("all") - F.col("before") >= min_words, ahead).cast("int").alias("ahead"),
        F.when(F.col("upto") >= min_words, back).cast("int").alias("back"),
    )


def first_ranks(lines: DataFrame) -> DataFrame:
    """Level 0: positions whose line occurs more than once, ranked by line id."""
    counts = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    upto = running_totals(counts, [], F.shiftright("id", 48), [F.col("id")], {"upto": F.col("n")})
    ranks = upto.select("id", (F.col("upto") - F.col("n")).cast("long").alias("rank"))
    return lines.join(ranks, "id").select(*KEY, "pos", "line", "rank", "ahead", "back")


def next_ranks(ranks: DataFrame, reach: int) -> DataFrame:
    """From prefixes of ``reach`` lines to twice as many; positions whose longer prefix occurs once are gone."""
    second = ranks.select(*KEY, (F.col("pos") - reach).alias("pos"), F.col("rank").alias("rank2"))
    pairs = ranks.select(*KEY, "pos", "rank", "ahead", "back").join(second, [*KEY, "pos"])
    buckets = pairs.groupBy("rank", "rank2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    upto = running_totals(buckets, ["rank"], F.shiftright("rank2", 16), [F.col("rank2")], {"upto": F.col("n")})
    new = upto.select("rank", "rank2", (F.col("rank") + F.col("upto") - F.col("n")).cast("long").alias("new"))
    return pairs.join(new, ["rank", "rank2"]).select(*KEY, "pos", F.col("new").alias("rank"), "ahead", "back")


def later_copies(ranks: DataFrame, ends: DataFrame, reach: int) -> DataFrame:
    """Runs of reach .. 2 reach - 1 lines whose content occurred before: row key, start, length.

    An occurrence that overlaps its run's first one (lines repeated in a row) is no copy of it: the first stays whole.
    """
    fits = lambda c: F.col(c).between(reach, 2 * reach - 1)
    ahead = ranks.where(fits("ahead")).select(*KEY, F.col("pos").alias("start"), F.col("ahead").alias("length"))
    back = ends.where(fits("back")).select(
        *KEY, (F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("length")
    )
    head = ranks.select(*KEY, F.col("pos").alias("start"), F.col("rank").alias("head"))
    runs = ahead.unionByName(back).distinct().join(head, [*KEY, "start"])
    if reach > 1:
        tail = ranks.select(*KEY, F.col("pos").alias("at"), F.col("rank").alias("tail"))
        runs = runs.withColumn("at", F.col("start") + F.col("length") - reach).join(tail, [*KEY, "at"]).drop("at")
    else:
        runs = runs.withColumn("tail", F.col("head"))
    place = F.struct(*KEY, "start")
    first = runs.groupBy("length", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    again = runs.join(first.where("n > 1"), ["length", "head", "tail"])
    same_row = (F.col("first.__id") == F.col("__id")) & (F.col("first.__h") == F.col("__h"))
    again = again.where(~(same_row & (F.col("start") < F.col("first.start") + F.col("length"))))
    return again.select(*KEY, "start", "length")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, lines_too: bool = False) -> DataFrame:
    """Per row key ``__gone``, the numbers of the lines to delete, and ``__in_runs``, how many of them lie in runs.

    With ``lines_too`` single lines count as runs as well, however short: every line that occurred before goes.
    """
    lines = materialize(line_table(docs, min_words), "lines")
    first = ranks = materialize(first_ranks(lines), "ranks")
    ends = first.where("back is not null").select(*KEY, "pos", "back")
    runs, reach = materialize(later_copies(ranks, ends, 1), "runs"), 1
    while 2 * reach <= min_words:
        ranks = materialize(next_ranks(ranks, reach), "ranks")
        reach *= 2
        runs = runs.unionByName(materialize(later_copies(ranks, ends, reach), "runs"))
    places = runs.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
    gone = first.select(*KEY, "pos", "line").join(places.distinct(), [*KEY, "pos"]).select(*KEY, "line", F.lit(1).alias("run"))
    if lines_too:
        # the buckets of level 0 are equal lines; all but a bucket's first place go
        place = F.struct(*KEY, "pos")
        heads = first.groupBy("rank").agg(F.min(place).alias("head"))
        later = first.join(heads, "rank").where(place != F.col("head")).select(*KEY, "line", F.lit(0).alias("run"))
        gone = gone.unionByName(later).groupBy(*KEY, "line").agg(F.max("run").alias("run"))
    return gone.groupBy(*KEY).agg(F.array_sort(F.collect_list("line")).alias("__gone"), F.sum("run").alias("__in_runs"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, keep_emptied: bool = True) -> DataFrame:
    """The documents without later copies of repeated line runs; ``n_chars`` follows the text where it is there.

    The order of occurrences is (doc_id, text hash, line); the first stays. Null text stays null, an empty one empty.
    A document all of whose lines go keeps an empty text, or goes if ``keep_emptied`` is off; documents that came without
    words stay either way. Rows equal in doc_id and text are one document and get equal results, a row each. Empty table:
    no rows. A very long text is cut in linear time in one task. Other columns are kept as they are; names after two
    underscores are reserved.
    """
    cut = _cut(docs, min_words)
    if not keep_emptied:
        cut = cut.where(F.col("__gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select(*docs.columns)


def _cut(docs: DataFrame, min_words: int, lines_too: bool = False) -> DataFrame:
    joined = keyed(docs).join(deleted_lines(docs, min_words, lines_too), KEY, "left")
    some = F.col("__gone").isNotNull()
    out = joined.withColumn("text", F.when(some, without_numbers(F.col("text"), "\n", "__gone")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, lines_too: bool = False) -> DataFrame:
    """Per document: doc_id, n_removed lines, n_in_runs of them in runs of ``min_words`` words, and the text that is left
    (null: empty). With ``lines_too`` every repeated line goes, in a run or not. Cases as in without_repeats."""
    return _cut(docs.select("doc_id", "text"), min_words, lines_too).select(
        "doc_id",
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__in_runs", F.lit(0)).cast("long").alias("n_in_runs"),
        text_or_empty().alias("text"),
    )
