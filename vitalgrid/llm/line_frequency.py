"""Quality rules: text measures of each document, and lines that too many documents of a host share.

Built-in functions only. Equal three-word windows, lines and texts are told by 64-bit hashes.

Lines are normalised (outer blanks, case, digits), hashed, and counted in distinct documents per host; copies of a text
under other doc_ids are documents like any other. A line in more documents than the limit goes, except from the first document (lowest
doc_id) of the host, so no content leaves the corpus altogether. A document left with too small a share of its
characters is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import KEY, keyed, text_or_empty, without_numbers
from vitalgrid.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Documents of one host that may share a line, and the share of characters a document must keep.
MAX_DOCUMENTS = 100
MIN_LEFT = 0.15


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(" \t\x0b\x0c\r"))), "[0-9]+", "0")


def _covered(positions: Column, width: int) -> Column:
    """Places covered by windows of ``width`` at the ascending positions."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct(
        (a["n"] + p + width - F.greatest(p, a["end"])).alias("n"), (p + width).alias("end")
    )
    return F.aggregate(positions, start, step, lambda a: a["n"])


def with_measures(docs: DataFrame) -> DataFrame:
    """Adds the measures and the base verdict, their names after two underscores, which are reserved."""
    out = docs.withColumn("__t", text_or_empty())
    out = out.withColumn("__w", F.array_remove(F.split("__t", BLANKS), ""))
    out = out.withColumns(
        {
            "__n_words": F.size("__w").cast("long"),
            "__word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "__n_symbols": F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"),
            "__l": F.filter(F.split("__t", "\n"), lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != ""),
            "__i": F.when(F.size("__w") >= 3, F.sequence(F.lit(0), F.size("__w") - 3)).otherwise(
                F.array().cast("array<int>")
            ),
        }
    )
    word = lambda i: F.get("__w", i)
    out = out.withColumns(
        {
            "__n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__g": F.transform("__i", lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))),
        }
    ).drop("__l")
    out = out.withColumn("__any", F.size(F.array_distinct("__g")) < F.size("__g")).drop("__i")
    # windows in hash order; those with an equal neighbour repeat
    out = out.withColumn(
        "__s",
        F.when(F.col("__any"), F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    ).drop("__g", "__w")
    same = lambda x, j: (x["g"] == F.get("__s", j - 1)["g"]) | (x["g"] == F.get("__s", j + 1)["g"])
    repeats = F.filter("__s", lambda x, j: F.coalesce(same(x, j), F.lit(False)))
    out = out.withColumn(
        "__n_repeat_words",
        F.when(F.col("__any"), _covered(F.sort_array(F.transform(repeats, lambda x: x["i"])), 3))
        .otherwise(0)
        .cast("long"),
    ).drop("__s", "__any", "__t")
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    return out.withColumn("__failed", failed)


def frequent_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Per row key: ``__lost`` characters in lines above the limit, and the numbers ``__lines`` of those lines.

    Counts go through distinct (host, line, document) rows first, so a line that a third of all documents share is
    summed in parts before its group meets.
    """
    lines = keyed(docs).select(
        *KEY,
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.posexplode(F.split(text_or_empty(), "\n")).alias("at", "line"),
    )
    lines = lines.withColumn("normal", normal_line(F.col("line"))).where(F.col("normal") != "")
    lines = materialize(
        lines.select(*KEY, "at", "host", F.xxhash64("normal").alias("hash"), F.length("line").alias("chars")), "lines"
    )
    counts = (
        lines.select("host", "hash", *KEY)
        .distinct()
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("documents"), F.min("__id").alias("first"))
        .where(F.col("documents") > max_documents)
    )
    hits = lines.join(counts, ["host", "hash"]).where(F.col("__id") != F.col("first"))
    per_row = hits.groupBy(*KEY).agg(  # a set, for rows that are there twice
        F.array_sort(F.collect_set(F.struct("at", "chars"))).alias("places")
    )
    lost = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    return per_row.select(*KEY, lost.alias("__lost"), F.transform("places", lambda x: x["at"]).alias("__lines"))


def _kept(min_left: float) -> Column:
    lost = F.coalesce(F.col("__lost"), F.lit(0))
    return ~F.col("__failed") & ((lost == 0) | (F.col("__chars") - lost >= min_left * F.col("__chars")))


def _judged(docs: DataFrame, max_documents: int) -> DataFrame:
    """doc_id, row key, measures and the lines lost, without the text."""
    source = docs.select("doc_id", "text", "source")
    measures = with_measures(keyed(source).withColumn("__chars", F.length(text_or_empty()))).drop("text", "source")
    return measures.join(frequent_lines(source, max_documents), KEY, "left")


def quality_verdicts(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per document: doc_id, the measures, base_failed, kept and frequent_chars; no text is shuffled.

    Null text: no words, not kept. Null host: a host of its own. Rows equal in doc_id and text get equal verdicts, a
    row each. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _judged(docs, max_documents).select(
        "doc_id",
        *[F.col(f"__{n}").alias(n) for n in names],
        F.col("__failed").alias("base_failed"),
        _kept(min_left).alias("kept"),
        F.coalesce(F.col("__lost"), F.lit(0)).cast("long").alias("frequent_chars"),
    )


def keep_good(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """The kept documents with the columns given, their frequent lines taken out of ``text`` (and ``n_chars``).

    Null, blank and empty texts have no words and go. Null host: a host of its own. Rows equal in doc_id and text are
    one document and stay or go together. Empty table: no rows. Very long texts are split once into lines; other columns
    are kept as they are, and names after two underscores are reserved.
    """
    verdicts = _judged(docs, max_documents).select(*KEY, _kept(min_left).alias("__kept"), "__lines")
    # written, since a condition on it would be worked out anew below every projection it passes
    verdicts = materialize(verdicts, "verdicts").where("__kept").dropDuplicates(KEY)
    lost = F.col("__lines").isNotNull()
    out = keyed(docs).join(verdicts, KEY)
    out = out.withColumn("text", F.when(lost, without_numbers(F.col("text"), "\n", "__lines")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*docs.columns)
