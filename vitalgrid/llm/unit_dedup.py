"""Repeated lines or paragraphs: normalised units are hashed, the earliest of equal ones stays, the rest go.

Built-in functions only. A unit's digest is two 64-bit hashes of its normalised text (lower case, runs of anything but
letters and digits as one blank). Digests are grouped over the whole corpus; occurrences rank by (doc_id, text hash,
unit number). Removed units keep their original offsets: code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import KEY, keyed, text_or_empty, without_numbers
from vitalgrid.session import materialize

#: What parts units; each is a fixed string, so offsets follow from lengths.
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}


def normal_unit(unit: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))


def unit_table(docs: DataFrame, separator: str, min_words: int) -> DataFrame:
    """A row per unit of at least ``min_words`` words: row key, number, start, end, digest.

    A unit with no letter or digit is no unit and stays. Rows equal in doc_id and text are one document.
    """
    cut = F.split(text_or_empty(), separator)
    each = F.transform(
        F.transform(cut, lambda u: F.struct(F.length(u).alias("size"), normal_unit(u).alias("normal"))),
        lambda s: F.struct(
            s["size"].alias("size"),
            ((s["normal"] != "") & (F.size(F.split(s["normal"], " ")) >= min_words)).alias("long"),
            F.xxhash64(s["normal"]).alias("d1"),
            F.xxhash64(F.lit(1), s["normal"]).alias("d2"),
        ),
    )
    rows = keyed(docs.select("doc_id", "text")).select(*KEY, each.alias("units")).dropDuplicates(KEY)
    units = rows.select(*KEY, F.posexplode("units").alias("number", "u")).select(*KEY, "number", "u.*")
    before = Window.partitionBy(*KEY).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + len(separator)).over(before), F.lit(0)).cast("int")
    units = units.withColumn("start", start).where("long")
    return units.select(*KEY, "number", "start", (F.col("start") + F.col("size")).alias("end"), "d1", "d2")


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 0) -> DataFrame:
    """Per row key: ``__gone``, the removed units with number, start and end, in order, and their ``__numbers``."""
    units = materialize(unit_table(docs, SEPARATORS[unit], min_words), "units")
    place = F.struct(*KEY, "number")
    first = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = units.join(first, ["d1", "d2"]).where(place != F.col("first"))
    gone = F.sort_array(F.collect_list(F.struct("number", "start", "end")))
    grouped = again.groupBy(*KEY).agg(gone.alias("__gone"))
    return grouped.withColumn("__numbers", F.transform("__gone", lambda g: g["number"]))


def without_repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 0) -> DataFrame:
    """Per document: doc_id, n_removed, removed (``start:end``, comma-joined) and the text that is left.

    Every repeated unit goes; ``min_words`` leaves those with fewer words (between blanks) alone, and is off by default.
    Null text counts as empty. A document all of whose units go has an empty text. Rows equal in doc_id and text are
    one document and get equal results, a row each. Empty table: no rows. A very long text is split and joined in
    linear time in one task. Other columns are ignored, whatever their names.
    """
    separator = SEPARATORS[unit]
    joined = keyed(docs.select("doc_id", "text")).join(repeated_units(docs, unit, min_words), KEY, "left")
    spans = F.transform("__gone", lambda g: F.concat_ws(":", g["start"], g["end"]))
    some = F.col("__gone").isNotNull()
    return joined.select(
        "doc_id",
        F.when(some, F.size("__gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(some, F.array_join(spans, ",")).otherwise("").alias("removed"),
        F.when(some, without_numbers(F.col("text"), separator, "__numbers")).otherwise(text_or_empty()).alias("text"),
    )
