"""Small helpers of the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule: a word is a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for tokenizers and memo tables.

    Functions travel to the workers by value, so their module globals are new for every task.
    """
    name = "_vitalgrid_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` of the given string column; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = taken = 0
        for i, n in enumerate(sizes):
            if taken and taken + n > most_bytes:
                yield batch.slice(start, i - start)
                start, taken = i, 0
            taken += int(n)
        yield batch.slice(start)


#: Names of the row key's columns.
KEY = ["__id", "__h"]


def keyed(docs: DataFrame) -> DataFrame:
    """Adds a never-null row key from doc_id and text; rows equal in both share it, and share every decision."""
    return docs.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__h": F.xxhash64("text")}
    )


def without_numbers(text: Column, separator: str, numbers: str) -> Column:
    """The text without its parts at the numbers of the named column (ascending, from 0, each once).

    Linear in the text, however many parts go: the numbers become a mask of one byte a part.
    """
    gap = lambda n, i: F.repeat(F.lit("0"), n - F.coalesce(F.get(numbers, i - 1), F.lit(-1)) - 1)
    mask = F.concat(F.array_join(F.transform(numbers, gap), "1"), F.lit("1")).cast("binary")
    parts = F.split(text, separator)
    kept = F.transform(
        F.array(mask), lambda m: F.filter(parts, lambda part, i: F.substring(m, i + 1, 1) != F.lit(b"1"))
    )
    return F.array_join(F.get(kept, F.lit(0)), separator)
