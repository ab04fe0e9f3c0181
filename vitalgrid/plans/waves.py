"""Queries over segment, survey and diary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.operators import waves as ops
from vitalgrid.operators.ordering import exact_quantiles
from vitalgrid.plans.registry import query
from vitalgrid.sources import tables as src
from vitalgrid.sources.tables import DIARY_MEASURES, DIARY_SQL, SEGMENTS_SQL, SURVEY_SQL

RICH = ("hr", "rmssd")
LITE = ("steps",)
DAY_NIGHT = ("hr", "rmssd")
DEMO = ("sex", "age", "height", "weight")


def rounded(df, keep=(), places=6):
    """Round every double for a value-stable result; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


SPAN_SQL = f"""{SEGMENTS_SQL},
span AS (SELECT subject, min(seg_time) AS t0, max(seg_time) AS t_last FROM seg GROUP BY subject),
waved AS (SELECT seg.*, t0, CASE WHEN seg_time < t0 + INTERVAL 14 DAY THEN 1
            WHEN seg_time < t0 + INTERVAL 28 DAY THEN 2 ELSE 3 END AS wave
          FROM seg JOIN span USING (subject))"""


def _rich_sql(m):
    return f"""round(avg({m}), 6) + 0.0 AS {m}_mean, round(stddev_pop({m}), 6) + 0.0 AS {m}_std,
      round(min({m}), 6) + 0.0 AS {m}_min, round(max({m}), 6) + 0.0 AS {m}_max, round(quantile_cont({m}, 0.5), 6) + 0.0 AS {m}_median,
      round(quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25), 6) + 0.0 AS {m}_iqr,
      round(CASE WHEN abs(avg({m})) > 1e-12 THEN stddev_pop({m}) / abs(avg({m})) END, 6) + 0.0 AS {m}_cv,
      CASE WHEN count({m}) > 0 THEN count({m}) END AS {m}_count,
      round(CASE WHEN count({m}) > 2 THEN regr_slope({m}, {m}_i) END, 6) + 0.0 AS {m}_slope"""


def _day_night_sql(m):
    day, night = (f"CASE WHEN {n} hour(seg_time) BETWEEN 8 AND 19 THEN {m} END" for n in ("", "NOT"))
    return f"""round(avg({day}), 6) + 0.0 AS {m}_day_mean,
      round(CASE WHEN count({day}) > 1 THEN stddev_pop({day}) END, 6) + 0.0 AS {m}_day_std,
      round(avg({night}), 6) + 0.0 AS {m}_night_mean,
      round(CASE WHEN count({night}) > 1 THEN stddev_pop({night}) END, 6) + 0.0 AS {m}_night_std,
      round(avg({day}) - avg({night}), 6) + 0.0 AS {m}_day_minus_night_mean"""


_LITE = "round(avg(steps), 6) + 0.0 AS steps_mean, round(stddev_pop(steps), 6) + 0.0 AS steps_std, CASE WHEN count(steps) > 0 THEN count(steps) END AS steps_count"
_COVER = """count(*) AS n_segments,
      round(greatest(0.0, (epoch_us(max(seg_time)) - epoch_us(min(seg_time))) / 86400000000.0), 6) + 0.0 AS window_span_days"""
_DEMO = """sex AS demo_sex, age AS demo_age, height AS demo_height, weight AS demo_weight,
      round(CASE WHEN height > 1e-6 THEN weight / ((height / 100.0) * (height / 100.0)) END, 6) + 0.0 AS demo_bmi"""

INDEXED_SQL = f"""{SPAN_SQL},
indexed AS (SELECT *,
    CASE WHEN hr IS NOT NULL THEN count(hr) OVER w - 1 END AS hr_i,
    CASE WHEN rmssd IS NOT NULL THEN count(rmssd) OVER w - 1 END AS rmssd_i
  FROM waved WINDOW w AS (PARTITION BY subject, wave ORDER BY seg_time, event_id ROWS UNBOUNDED PRECEDING))"""


def _diary_aggs():
    out = []
    for m in DIARY_MEASURES:
        c = m.replace("@", "_")
        out.append(f'round(avg("{m}"), 6) + 0.0 AS sleep_{c}_mean')
        out.append(f'round(CASE WHEN count(*) > 1 THEN stddev_pop("{m}") END, 6) + 0.0 AS sleep_{c}_std')
    return ", ".join(out)


DIARY_WAVE_SQL = f"""{DIARY_SQL},
diary_wave AS (
  SELECT subject, wave, {_diary_aggs()} FROM (
    SELECT diary.*, CASE WHEN diary_date < t0::DATE THEN NULL WHEN diary_date < t0::DATE + 14 THEN 1
        WHEN diary_date < t0::DATE + 28 THEN 2 ELSE 3 END AS wave
    FROM diary JOIN span USING (subject)) WHERE wave IS NOT NULL GROUP BY subject, wave)"""

_SLEEP_COLS = ", ".join(f"sleep_{m.replace('@', '_')}_{s}" for m in DIARY_MEASURES for s in ("mean", "std"))
PERSON_WAVE_SQL = f"""{INDEXED_SQL},
{SURVEY_SQL},
{DIARY_WAVE_SQL},
stats AS (SELECT subject, wave, {_COVER}, {_LITE}, {", ".join(_day_night_sql(m) for m in DAY_NIGHT)},
      {", ".join(_rich_sql(m) for m in RICH)} FROM indexed GROUP BY subject, wave),
pw AS (SELECT stats.*, {_DEMO}, CASE wave WHEN 1 THEN gad7_1 WHEN 2 THEN gad7_2 ELSE gad7_f END AS gad7, {_SLEEP_COLS}
  FROM stats JOIN survey1 USING (subject) LEFT JOIN diary_wave USING (subject, wave)
  WHERE CASE wave WHEN 1 THEN gad7_1 WHEN 2 THEN gad7_2 ELSE gad7_f END IS NOT NULL)"""


def person_waves(spark, d, diary=True):
    return ops.person_wave_table(
        src.segments(spark, d),
        src.survey(spark, d),
        src.diary(spark, d) if diary else None,
        RICH,
        LITE,
        DAY_NIGHT,
        DEMO,
        DIARY_MEASURES,
    )


@query("person_wave_table", "A5 F1 W17 A1 A2 A3 A4 J2 J3 P13 P18", f"WITH {PERSON_WAVE_SQL} SELECT * FROM pw")
def person_wave_table(spark, d):
    return rounded(person_waves(spark, d))


@query(
    "wave_assignment",
    "F1 W17",
    f"""WITH {SPAN_SQL} SELECT subject, wave, count(*) AS n, epoch_us(min(seg_time)) AS first_us, epoch_us(max(seg_time)) AS last_us
    FROM waved GROUP BY subject, wave""",
)
def wave_assignment(spark, d):
    w = ops.assign_waves(src.segments(spark, d))
    return w.groupBy("subject", "wave").agg(
        F.count(F.lit(1)).alias("n"),
        F.unix_micros(F.min("seg_time")).alias("first_us"),
        F.unix_micros(F.max("seg_time")).alias("last_us"),
    )


@query(
    "rich_statistics",
    "A1",
    f"WITH {INDEXED_SQL} SELECT subject, wave, {', '.join(_rich_sql(m) for m in RICH)} FROM indexed GROUP BY subject, wave",
)
def rich_statistics(spark, d):
    w = ops.assign_waves(src.segments(spark, d))
    return rounded(ops.rich_stats(w, ["subject", "wave"], RICH, ops.time_bucket("seg_time", 6 * 3600), ["seg_time", "event_id"]))


@query("lite_statistics", "A2", f"WITH {SPAN_SQL} SELECT subject, wave, {_LITE} FROM waved GROUP BY subject, wave")
def lite_statistics(spark, d):
    w = ops.assign_waves(src.segments(spark, d))
    return rounded(w.groupBy("subject", "wave").agg(*ops.lite_stats("steps")))


@query(
    "day_night_statistics",
    "A3 X27",
    f"WITH {SPAN_SQL} SELECT subject, wave, {_day_night_sql('rmssd')} FROM waved GROUP BY subject, wave",
)
def day_night_statistics(spark, d):
    w = ops.assign_waves(src.segments(spark, d))
    return rounded(w.groupBy("subject", "wave").agg(*ops.day_night_stats("rmssd")))


@query("wave_coverage", "A4 X29", f"WITH {SPAN_SQL} SELECT subject, wave, {_COVER} FROM waved GROUP BY subject, wave")
def wave_coverage(spark, d):
    return rounded(ops.assign_waves(src.segments(spark, d)).groupBy("subject", "wave").agg(*ops.coverage()))


@query(
    "overall_quantiles",
    "A1 A11",
    f"""WITH {SEGMENTS_SQL} SELECT round(quantile_cont(hr, 0.0), 6) AS q0, round(quantile_cont(hr, 0.1), 6) AS q10,
    round(quantile_cont(hr, 0.5), 6) AS q50, round(quantile_cont(hr, 0.9), 6) AS q90, round(quantile_cont(hr, 1.0), 6) AS q100 FROM seg""",
)
def overall_quantiles(spark, d):
    probs = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    return rounded(exact_quantiles(src.segments(spark, d), [], "hr", probs))


@query(
    "survey_first_row",
    "J2 P13",
    f"WITH {SEGMENTS_SQL}, {SURVEY_SQL} SELECT subject, gad7_1, gad7_2, gad7_f, {_DEMO} FROM survey1 WHERE subject IN (SELECT subject FROM seg)",
)
def survey_first_row(spark, d):
    seen = src.segments(spark, d).select("subject").distinct()
    people = ops.first_edition(src.survey(spark, d)).join(seen, "subject", "left_semi")
    return rounded(people.select("subject", "gad7_1", "gad7_2", "gad7_f", *ops.demographics(DEMO)))


@query("diary_wave_means", "J3", f"WITH {SPAN_SQL}, {DIARY_WAVE_SQL} SELECT * FROM diary_wave")
def diary_wave_means(spark, d):
    spans = ops.subject_span(src.segments(spark, d))
    return rounded(ops.diary_by_wave(src.diary(spark, d), spans, DIARY_MEASURES))


def _person_sql():
    feats = [c for m in RICH for c in (f"{m}_mean", f"{m}_std", f"{m}_slope", f"{m}_median", f"{m}_day_std")]
    parts = [
        f"""round(avg({c}), 7) + 0.0 AS person_{c}_mean, round(CASE WHEN count({c}) > 1 THEN stddev_pop({c}) END, 7) + 0.0 AS person_{c}_std,
        round(min({c}), 7) + 0.0 AS person_{c}_min, round(max({c}), 7) + 0.0 AS person_{c}_max"""
        for c in feats
    ]
    return feats, ", ".join(parts)


_PERSON_FEATS, _PERSON_AGGS = _person_sql()


@query(
    "person_table",
    "A6 J14",
    f"""WITH {PERSON_WAVE_SQL} SELECT subject, round(avg(gad7), 7) AS gad7, count(*) AS person_n_waves, {_PERSON_AGGS},
    arg_min(demo_age, wave) AS demo_age, arg_min(demo_weight, wave) AS demo_weight,
    CAST(bool_or(gad7 >= 5) AS INTEGER) AS binary_any_wave_ge5, CAST(max(gad7) >= 5 AS INTEGER) AS binary_max_score_ge5
    FROM pw GROUP BY subject""",
)
def person_table(spark, d):
    waves = rounded(person_waves(spark, d, diary=False)).select(
        "subject", "wave", "gad7", "demo_age", "demo_weight", *_PERSON_FEATS
    )
    return rounded(ops.person_table(waves), places=7)


QUEST_SQL = f"""{SPAN_SQL},
{SURVEY_SQL},
quest AS (SELECT subject, t0 + INTERVAL 1 DAY * day AS q_time, gad7 FROM (
    SELECT subject, 0 AS day, gad7_1 AS gad7 FROM survey1 UNION ALL SELECT subject, 14, gad7_2 FROM survey1
    UNION ALL SELECT subject, 28, gad7_f FROM survey1) JOIN span USING (subject) WHERE gad7 IS NOT NULL)"""


def questionnaires(spark, d):
    spans = ops.subject_span(src.segments(spark, d))
    return ops.questionnaires_from_wide(ops.first_edition(src.survey(spark, d)), spans)


@query(
    "questionnaire_expansion",
    "P9 J5 X28",
    f"WITH {QUEST_SQL} SELECT subject, epoch_us(q_time) AS q_us, gad7 FROM quest",
)
def questionnaire_expansion(spark, d):
    return questionnaires(spark, d).select("subject", F.unix_micros("q_time").alias("q_us"), "gad7")


@query(
    "look_back_labels",
    "J1 X28",
    f"""WITH {QUEST_SQL} SELECT seg.subject, event_id, hr, gad7, epoch_us(q_time) AS q_us FROM seg JOIN quest ON seg.subject = quest.subject
    AND seg_time >= q_time - INTERVAL 14 DAY AND seg_time < q_time""",
)
def look_back_labels(spark, d):
    out = ops.look_back_join(src.segments(spark, d), questionnaires(spark, d))
    return out.select("subject", "event_id", "hr", "gad7", F.unix_micros("q_time").alias("q_us"))


@query(
    "latest_score_with_means",
    "J4 A7",
    f"""WITH {QUEST_SQL}, last AS (SELECT subject, max(q_time) AS q_time, arg_max(gad7, q_time) AS gad7 FROM quest GROUP BY subject),
    means AS (SELECT subject, avg(hr) AS hr, avg(rmssd) AS rmssd, avg(steps) AS steps FROM seg GROUP BY subject)
    SELECT subject, epoch_us(q_time) AS q_us, gad7, round(hr, 6) AS hr, round(rmssd, 6) AS rmssd, round(steps, 6) AS steps
    FROM last JOIN means USING (subject)""",
)
def latest_score_with_means(spark, d):
    means = src.segments(spark, d).groupBy("subject").agg(*[F.avg(c).alias(c) for c in ("hr", "rmssd", "steps")])
    last = ops.latest_score(questionnaires(spark, d))
    return rounded(
        last.join(means, "subject").select("subject", F.unix_micros("q_time").alias("q_us"), "gad7", "hr", "rmssd", "steps")
    )


@query(
    "first_seen_subjects",
    "J5",
    f"""WITH {SPAN_SQL}, {SURVEY_SQL} SELECT survey1.subject, epoch_us(t0) AS t0_us, gad7_1 FROM survey1 JOIN span USING (subject)""",
)
def first_seen_subjects(spark, d):
    spans = ops.subject_span(src.segments(spark, d))
    people = ops.first_edition(src.survey(spark, d))
    return people.join(spans, "subject").select("subject", F.unix_micros("t0").alias("t0_us"), "gad7_1")


@query(
    "subject_column_means",
    "A7",
    "SELECT l_suppkey AS subject, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1",
)
def subject_column_means(spark, d):
    t = src.table(spark, d, "lineitem")
    cols = [c for c, k in t.dtypes if k == "double"]
    out = t.groupBy(F.col("l_suppkey").alias("subject")).agg(*[F.avg(c).alias(c) for c in cols])
    return rounded(out).withColumn("l_extendedprice", F.round("l_extendedprice", 4))
