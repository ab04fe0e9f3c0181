"""Keyed text-table operators: record validation and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message_key(c: Column | str) -> Column:
    return F.lower(F.trim(c))


def word_count(c: Column | str) -> Column:
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def valid_pairs(df: DataFrame) -> DataFrame:
    """Non-empty message and a title of two to four words."""
    title = F.trim("title")
    return df.where((F.trim("message") != "") & (title != "") & word_count("title").between(2, 4))


def new_by_message(fresh: DataFrame, existing: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """First fresh row of every normalized message that is not stored yet.

    The first row is found by an aggregate with map-side combine, so a message repeated in a third
    of the rows does not gather in one task.
    """
    cols = fresh.columns
    keyed = fresh.withColumn("__k", message_key("message"))
    best = keyed.groupBy("__k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__r"))
    if existing is not None:
        seen = existing.select(message_key("message").alias("__k")).distinct()
        best = best.join(seen, "__k", "left_anti")
    return best.select(*[F.col(f"__r.{c}").alias(c) for c in cols])
