"""Epoch segmentation and ordered operators over samples, epochs and nights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.operators.ordering import blocks_with_halo, dealt, halo_window, home_rows, join_per_key, row_index

EPOCH_SECONDS = 30
EPOCH_KEYS = ("subject", "epoch_idx")


def epoch_window():
    """All rows of one epoch; an epoch has a fixed number of samples, so this is bounded."""
    return Window.partitionBy(*EPOCH_KEYS)


def segment(df: DataFrame, bucket, order: Sequence, stage, rate: int = 1, unscored: int = 5) -> DataFrame:
    """Number the samples of each subject and cut them into whole scored epochs.

    The label is the stage of the first sample; a trailing partial epoch and unscored epochs drop.
    """
    per = EPOCH_SECONDS * rate
    count = df.count()  # no column is read
    idx = row_index(df, ["subject"], bucket, order, "sample_idx", count)
    rows = idx.withColumns(
        {
            "epoch_idx": F.floor(F.col("sample_idx") / per),
            "pos": F.pmod("sample_idx", F.lit(per)),
            "__stage": stage,
        }
    )
    w = epoch_window()
    rows = dealt(rows, EPOCH_KEYS, count).withColumns(
        {"__n": F.count(F.lit(1)).over(w), "stage": F.max(F.when(F.col("pos") == 0, F.col("__stage"))).over(w)}
    )
    return rows.where((F.col("__n") == per) & (F.col("stage") != unscored)).drop("__n", "__stage")


def align_by_position(epochs: DataFrame, labels: DataFrame) -> DataFrame:
    """Epochs with the label of the same position; whichever side is longer is cut."""
    return epochs.join(labels, list(EPOCH_KEYS))


def deltas(df: DataFrame, columns: Sequence[str], idx: str = "epoch_idx") -> DataFrame:
    """Change against the previous epoch; the first epoch repeats the second's change."""
    keys = ["subject"]
    rows = blocks_with_halo(df, keys, idx, reach=1)
    w = halo_window(keys, idx)
    out = {
        f"Delta_{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c), F.lit(0.0)) for c in columns
    }
    return home_rows(rows.withColumns(out))


def rolling_context(df: DataFrame, means: Sequence[str], stds: Sequence[str], reach: int = 5, idx: str = "epoch_idx") -> DataFrame:
    """Centred mean and deviation over +-reach epochs, cut at the ends of the night."""
    keys = ["subject"]
    rows = blocks_with_halo(df, keys, idx, reach=reach)
    w = halo_window(keys, idx).rowsBetween(-reach, reach)
    out = {f"Ctx_RMean_{c}": F.avg(c).over(w) for c in means}
    out |= {f"Ctx_RStd_{c}": F.stddev_pop(c).over(w) for c in stds}
    return home_rows(rows.withColumns(out))


def dense_epochs(df: DataFrame, idx: str = "epoch_idx") -> DataFrame:
    """Renumber the kept epochs of each subject from 0 and carry their count.

    Epoch numbers are already ordered, so the bucket is a run of 1024 of them.
    """
    out = row_index(df, ["subject"], F.floor(F.col(idx) / 1024).cast("bigint"), [F.col(idx)], "epoch_no")
    n = df.groupBy("subject").agg(F.count(F.lit(1)).alias("n_epochs"))
    return join_per_key(out, n, ["subject"], idx)


def relative_position(no="epoch_no", n="n_epochs"):
    return F.col(no) / F.greatest(F.lit(1), F.col(n) - 1)


def median_smooth(df: DataFrame, column: str, idx: str, kernel: int = 7, name: str = "smoothed") -> DataFrame:
    """Running median with zeros beyond both ends, over a bounded window."""
    half = kernel // 2
    keys = ["subject"]
    rows = blocks_with_halo(df, keys, idx, reach=half)
    w = halo_window(keys, idx).rowsBetween(-half, half)
    seen = F.collect_list(F.col(column).cast("double")).over(w)
    padded = F.array_sort(F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size(seen))))
    return home_rows(rows.withColumn(name, F.element_at(padded, half + 1)))


def sleep_biomarkers(df: DataFrame, sleep: str = "sleep", no: str = "epoch_no", seconds: int = 30) -> DataFrame:
    """TST, SOL, WASO in minutes and efficiency per night, as one algebraic aggregate."""
    is_sleep = F.col(sleep) == 1
    per = seconds / 60.0
    agg = df.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_sleep).alias("asleep"),
        F.min(F.when(is_sleep, F.col(no))).alias("first"),
        F.max(F.when(is_sleep, F.col(no))).alias("last"),
    )
    none = F.col("asleep") == 0
    waso = (F.col("last") - F.col("first") + 1 - F.col("asleep")) * per
    return agg.select(
        "subject",
        F.round(F.col("asleep") * per, 1).alias("tst_minutes"),
        F.when(none, F.col("n") * per).otherwise(F.round(F.col("first") * per, 1)).alias("sol_minutes"),
        F.when(none, 0.0).otherwise(F.round(waso, 1)).alias("waso_minutes"),
        F.round(F.col("asleep") * 100.0 / F.col("n"), 1).alias("sleep_efficiency_pct"),
    )
