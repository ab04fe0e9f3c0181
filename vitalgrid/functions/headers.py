"""Header rules: which column is the subject, the time, the score; what role a table plays.

The rules work on an array column of header names, so they run over any number of tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header names and markers.
SUBJECT_PRIORITY = ("deviceid", "device_id", "participant_id", "subject_id", "user_id", "pid", "id")
SUBJECT_MARKERS = ("participant", "subject", "device", "user")
TIME_MARKERS = ("timestamp", "datetime", "segment_start", "segment_end", "start_time", "time", "date", "day")
SCORE_ITEM_MARKERS = ("item", "question", "q1", "q2", "gad1", "gad2")
SCORE_TOTAL_MARKERS = ("total", "score", "sum", "gad7", "gad_7", "gad-7")
SCORE_EXACT = ("gad7", "gad_7", "gad", "gad_total")
HRV_MARKERS = ("sdnn", "rmssd", "lf_hf", "lf/hf", "nn50", "pnn50")
SLEEP_MARKERS = ("waso", "sleep diary", "bedtime", "wake_time", "sleeponset")
WIDE_COLUMNS = ("GAD7_1", "GAD7_2", "GAD7_F")


def normalize(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


def has_any(name: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(name, F.lit(m))
    return out


def _first(cols: Column, rule) -> Column:
    return F.get(F.filter(cols, rule), F.lit(0))


def subject_column(cols: Column) -> Column:
    ranked = [_last(cols, p) for p in SUBJECT_PRIORITY]
    return F.coalesce(
        *ranked,
        _first(cols, lambda c: has_any(normalize(c), SUBJECT_MARKERS) & ~F.contains(normalize(c), F.lit("item"))),
    )


def _last(cols: Column, name: str) -> Column:
    # a repeated normalized header resolves to its last occurrence
    return F.try_element_at(F.filter(cols, lambda c: normalize(c) == name), F.lit(-1))


def time_column(cols: Column, text_cols: Column) -> Column:
    marked = _first(cols, lambda c: has_any(normalize(c), TIME_MARKERS) & F.array_contains(text_cols, c))
    return F.coalesce(marked, _first(cols, lambda c: F.contains(normalize(c), F.lit("time")) | (normalize(c) == "date")))


def score_items(cols: Column) -> Column:
    """Item columns in the order of their normalized names."""
    items = F.filter(cols, lambda c: normalize(c).rlike(r"^gad7?[_\-]?[0-9]+$"))
    keyed = F.transform(items, lambda c: F.struct(normalize(c).alias("n"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def score_column(cols: Column) -> Column:
    def total(c):
        n = normalize(c)
        return F.contains(n, F.lit("gad")) & ~has_any(n, SCORE_ITEM_MARKERS) & has_any(n, SCORE_TOTAL_MARKERS)

    return F.coalesce(_first(cols, total), _first(cols, lambda c: normalize(c).isin(*SCORE_EXACT)))


def table_role(cols: Column) -> Column:
    low = F.transform(cols, F.lower)
    joined = F.array_join(low, " ")
    gad = F.contains(joined, F.lit("gad"))
    phq = F.contains(joined, F.lit("phq"))
    isi = F.exists(low, lambda c: c.startswith("isi") | F.contains(c, F.lit("_isi"))) | F.contains(joined, F.lit(" isi"))
    quest = gad | phq | isi
    hrv = has_any(joined, HRV_MARKERS) | F.contains(joined, F.lit("heart rate variability"))
    return (
        F.when(hrv & quest, "mixed")
        .when(quest, "questionnaire")
        .when(hrv, "hrv")
        .when(has_any(joined, SLEEP_MARKERS), "sleep_diary")
        .otherwise("other")
    )


def is_wide_survey(cols: Column, with_device: bool = False) -> Column:
    upper = F.transform(cols, F.upper)
    need = (*WIDE_COLUMNS, "DEVICEID") if with_device else WIDE_COLUMNS
    out = F.lit(True)
    for c in need:
        out = out & F.array_contains(upper, c)
    return out
