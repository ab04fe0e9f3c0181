"""Person-wave features: 14-day windows per subject, rich statistics, labels and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.ordering import exact_quantiles, join_per_key, running_totals, time_bucket
from vitalgrid.session import materialize

# Columns dropped before aggregation, and the columns that get the full statistics.
REDUNDANT_COLUMNS = ("lf", "pnn20", "sdsd", "distance", "calories")
RICH_PREFIXES = ("missingness_score", "HR", "ibi", "sdnn", "rmssd", "pnn50", "hf", "lf/hf")
LABEL_MARKERS = ("gad", "phq", "isi")
WAVE_DAYS = 14


def feature_name(column: str, stat: str, prefix: str = "") -> str:
    return f"{prefix}{column.replace('/', '_per_').replace('@', '_')}_{stat}"


def numeric_features(df: DataFrame, skip: Sequence[str]) -> list[str]:
    """Numeric columns that may become features: no ids, no redundant columns, no labels."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [
        c
        for c, t in df.dtypes
        if (t in numeric or t.startswith("decimal"))
        and c not in skip
        and c not in REDUNDANT_COLUMNS
        and not any(m in c.lower() for m in LABEL_MARKERS)
    ]


def is_rich(column: str) -> bool:
    return column in RICH_PREFIXES or any(column.startswith(p) for p in RICH_PREFIXES if p != "lf/hf")


def first_edition(survey: DataFrame, order: str = "file_order") -> DataFrame:
    """One survey row per subject, the first in the carried ingest order."""
    rest = [c for c in survey.columns if c not in ("subject", order)]
    best = survey.groupBy("subject").agg(F.min_by(F.struct(*rest), order).alias("__s"))
    return best.select("subject", *[F.col(f"__s.{c}").alias(c) for c in rest])


def subject_span(segments: DataFrame) -> DataFrame:
    """First and last segment time per subject.

    Written out: later joins then know its real size, broadcast it only while it is small, and do
    not read the segments again.
    """
    spans = segments.groupBy("subject").agg(F.min("seg_time").alias("t0"), F.max("seg_time").alias("t_last"))
    return materialize(spans, "spans")


def wave_of(ts, t0):
    """1, 2 for the first two half-open 14-day windows, 3 for everything later."""
    day = F.make_dt_interval(F.lit(WAVE_DAYS))
    return F.when(ts < t0, None).when(ts < t0 + day, 1).when(ts < t0 + day + day, 2).otherwise(3)


def assign_waves(segments: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    spans = subject_span(segments) if spans is None else spans
    return join_per_key(segments, spans, ["subject"], "seg_time").withColumn("wave", wave_of(F.col("seg_time"), F.col("t0")))


def is_day(ts):
    return F.hour(ts).between(8, 19)


def rich_stats(
    rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], bucket, order, more: Sequence = (), carry: Sequence[str] = ()
) -> DataFrame:
    """Full statistics of each metric per key, without holding a key in one task.

    The slope runs over the position among non-null values, so positions come from running counts.
    ``more`` aggregates over ``carry`` columns ride along in the same pass.
    """
    keys = list(keys)
    order = list(order)
    pos = {f"__i_{m}": F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in metrics}
    used = list(dict.fromkeys([*metrics, *order, *carry]))
    indexed = running_totals(rows.select(*keys, *used, bucket.alias("__at")), keys, F.col("__at"), [F.col(c) for c in order], pos)
    aggs = list(more)
    for m in metrics:
        v = F.col(m)
        n, mean, std = F.count(v), F.avg(v), F.stddev_pop(v)
        # position only where the value is present
        i = F.when(v.isNotNull(), F.col(f"__i_{m}") - 1)
        aggs += [
            mean.alias(feature_name(m, "mean")),
            std.alias(feature_name(m, "std")),
            F.min(v).alias(feature_name(m, "min")),
            F.max(v).alias(feature_name(m, "max")),
            F.when(F.abs(mean) > 1e-12, std / F.abs(mean)).alias(feature_name(m, "cv")),
            F.when(n > 0, n).alias(feature_name(m, "count")),
            F.when(n > 2, F.regr_slope(v, i)).alias(feature_name(m, "slope")),
        ]
    base = indexed.groupBy(*keys).agg(*aggs)
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("__p"))
    long = long.select(*keys, "__p.metric", "__p.v")
    q = exact_quantiles(long, [*keys, "metric"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = q.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("metric") == m, e)).alias(feature_name(m, s))
            for m in metrics
            for s, e in (("median", F.col("q2")), ("iqr", F.col("q3") - F.col("q1")))
        ]
    )
    return base.join(wide, keys, "left")


def lite_stats(metric: str) -> list:
    v = F.col(metric)
    n = F.count(v)
    return [
        F.avg(v).alias(feature_name(metric, "mean")),
        F.stddev_pop(v).alias(feature_name(metric, "std")),
        F.when(n > 0, n).alias(feature_name(metric, "count")),
    ]


def day_night_stats(metric: str, ts: str = "seg_time") -> list:
    v = F.col(metric)
    day, night = F.when(is_day(ts), v), F.when(~is_day(ts), v)
    out = []
    for name, c in (("day", day), ("night", night)):
        out.append(F.avg(c).alias(feature_name(metric, f"{name}_mean")))
        out.append(F.when(F.count(c) > 1, F.stddev_pop(c)).alias(feature_name(metric, f"{name}_std")))
    out.append((F.avg(day) - F.avg(night)).alias(feature_name(metric, "day_minus_night_mean")))
    return out


def coverage(ts: str = "seg_time") -> list:
    micros = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
    return [
        F.count(F.lit(1)).alias("n_segments"),
        F.greatest(F.lit(0.0), micros / 86_400_000_000.0).alias("window_span_days"),
    ]


def demographics(columns: Sequence[str]) -> list:
    out = [F.col(c).cast("double").alias(f"demo_{c}") for c in columns]
    h, w = F.col("height"), F.col("weight")
    out.append(F.when(h > 1e-6, w / F.pow(h / 100.0, F.lit(2.0))).alias("demo_bmi"))
    return out


def diary_by_wave(diary: DataFrame, spans: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Mean and deviation of diary measures per wave, windows compared by calendar date."""
    d0 = F.to_date("t0")
    wave = (
        F.when(F.col("diary_date") < d0, None)
        .when(F.col("diary_date") < F.date_add(d0, WAVE_DAYS), 1)
        .when(F.col("diary_date") < F.date_add(d0, 2 * WAVE_DAYS), 2)
        .otherwise(3)
    )
    rows = diary.join(spans.select("subject", "t0"), "subject").withColumn("wave", wave).where("wave IS NOT NULL")
    aggs = []
    for m in measures:
        v = F.col(f"`{m}`")
        aggs.append(F.avg(v).alias(feature_name(m, "mean", "sleep_")))
        aggs.append(F.when(F.count(F.lit(1)) > 1, F.stddev_pop(v)).alias(feature_name(m, "std", "sleep_")))
    return rows.groupBy("subject", "wave").agg(*aggs)


def person_wave_table(
    segments: DataFrame,
    survey: DataFrame,
    diary: DataFrame | None,
    rich: Sequence[str],
    lite: Sequence[str],
    day_night: Sequence[str],
    demo: Sequence[str],
    measures: Sequence[str] = (),
) -> DataFrame:
    """One row per subject and wave that has segments and a score."""
    spans = subject_span(segments)
    people = first_edition(survey)
    score = F.element_at(F.array("gad7_1", "gad7_2", "gad7_f"), F.col("wave"))
    labels = people.join(spans, "subject").select(
        "subject", "t0", "gad7_1", "gad7_2", "gad7_f", *demographics(demo)
    )
    # positions, statistics and quantiles all read these: parsed and joined once
    waved = assign_waves(segments, spans).select("subject", "wave", "seg_time", "event_id", *rich, *lite)
    waved = materialize(waved, "waved")
    more = [*coverage(), *[a for m in lite for a in lite_stats(m)], *[a for m in day_night for a in day_night_stats(m)]]
    full = rich_stats(
        waved, ["subject", "wave"], rich, time_bucket("seg_time", 6 * 3600), ["seg_time", "event_id"], more, [*lite, *day_night]
    )
    out = (
        full.join(labels, "subject")
        .withColumn("gad7", score)
        .where(F.col("gad7").isNotNull())
        .drop("t0", "gad7_1", "gad7_2", "gad7_f")
    )
    if diary is not None:
        out = out.join(diary_by_wave(diary, spans, measures), ["subject", "wave"], "left")
    return out


def person_table(waves: DataFrame, label_mode: str = "mean", cutoff: float = 5.0) -> DataFrame:
    """Collapse waves to one row per subject."""
    skip = {"subject", "wave", "gad7"}
    feats = [c for c in waves.columns if c not in skip and not c.startswith("demo_")]
    demo = [c for c in waves.columns if c.startswith("demo_")]
    label = F.max("gad7") if label_mode == "max" else F.avg("gad7")
    aggs = [label.alias("gad7"), F.count(F.lit(1)).alias("person_n_waves")]
    for c in feats:
        v = F.col(c).cast("double")
        aggs += [
            F.avg(v).alias(f"person_{c}_mean"),
            F.when(F.count(v) > 1, F.stddev_pop(v)).alias(f"person_{c}_std"),
            F.min(v).alias(f"person_{c}_min"),
            F.max(v).alias(f"person_{c}_max"),
        ]
    # the first wave's value, null included
    aggs += [F.min_by(F.struct(c), "wave")[c].alias(c) for c in demo]
    aggs += [
        F.bool_or(F.col("gad7") >= cutoff).cast("int").alias("binary_any_wave_ge5"),
        (F.max("gad7") >= cutoff).cast("int").alias("binary_max_score_ge5"),
    ]
    return waves.groupBy("subject").agg(*aggs)


def questionnaires_from_wide(survey: DataFrame, spans: DataFrame) -> DataFrame:
    """Long questionnaire rows at t0 + 0, 14, 28 days; null scores and unseen subjects drop."""
    long = survey.select(
        "subject",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(d).alias("day"), F.col(c).alias("gad7"))
                    for c, d in (("gad7_1", 0), ("gad7_2", WAVE_DAYS), ("gad7_f", 2 * WAVE_DAYS))
                ]
            )
        ).alias("__q"),
    ).select("subject", "__q.day", "__q.gad7")
    return (
        long.where(F.col("gad7").isNotNull())
        .join(spans.select("subject", "t0"), "subject")
        .select("subject", (F.col("t0") + F.make_dt_interval(F.col("day"))).alias("q_time"), "gad7")
    )


def look_back_join(segments: DataFrame, quest: DataFrame, days: int = 14) -> DataFrame:
    """Segments labelled by every questionnaire with q - days <= seg < q.

    The equality key is (subject, day): a questionnaire is copied to the days it looks back on, and
    a hot subject spreads over its days.
    """
    q_day = time_bucket("q_time", 86_400)
    left = segments.withColumn("__slot", time_bucket("seg_time", 86_400))
    right = quest.withColumn("__slot", F.explode(F.sequence(q_day - days, q_day)))
    lag = F.make_dt_interval(F.lit(days))
    return left.join(right, ["subject", "__slot"]).where(
        (F.col("seg_time") >= F.col("q_time") - lag) & (F.col("seg_time") < F.col("q_time"))
    ).drop("__slot")


def latest_score(quest: DataFrame) -> DataFrame:
    return quest.groupBy("subject").agg(
        F.max("q_time").alias("q_time"), F.max_by("gad7", F.struct("q_time", "gad7")).alias("gad7")
    )
