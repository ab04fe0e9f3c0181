"""Queries over epochs, nights and ordered windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalgrid.operators import epochs as ep
from vitalgrid.operators.ordering import join_per_key, row_index, time_bucket, value_bucket, with_scalars
from vitalgrid.plans.registry import query
from vitalgrid.plans.tables import stage_code
from vitalgrid.plans.waves import rounded
from vitalgrid.session import materialize
from vitalgrid.sources import tables as src
from vitalgrid.sources.tables import SAMPLES_SQL, SEGMENTS_SQL


def epoched(spark, d):
    return ep.segment(
        src.samples(spark, d),
        value_bucket("l_orderkey", 4096),
        [F.col(c) for c in src.SAMPLE_ORDER],
        stage_code(F.col("stage_name")),
    ).select("subject", "epoch_idx", "pos", "stage", "bvp", "hr", "ibi", "eda", "acc_x", "acc_y", "acc_z")


EPOCH_SQL = f"""{SAMPLES_SQL},
ep0 AS (SELECT *, sample_idx // 30 AS epoch_idx, sample_idx % 30 AS pos,
   CASE stage_name WHEN 'W' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 WHEN 'R' THEN 4 ELSE 5 END AS code FROM samples),
full_ep AS (SELECT subject, epoch_idx, max(CASE WHEN pos = 0 THEN code END) AS stage FROM ep0 GROUP BY ALL HAVING count(*) = 30),
e AS (SELECT ep0.*, stage FROM ep0 JOIN full_ep USING (subject, epoch_idx) WHERE stage <> 5)"""


@query(
    "epoch_segmentation",
    "W1 F2 J13",
    f"WITH {EPOCH_SQL} SELECT subject, epoch_idx, stage, count(*) AS n, round(avg(bvp), 6) + 0.0 AS bvp_mean, arg_min(bvp, pos) AS first_bvp FROM e GROUP BY ALL",
)
def epoch_segmentation(spark, d):
    t = epoched(spark, d).groupBy("subject", "epoch_idx", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.avg("bvp").alias("bvp_mean"), F.min_by("bvp", "pos").alias("first_bvp")
    )
    return rounded(t, keep=("first_bvp",))


def nights(spark, d):
    """Epoch table of each night with a dense number, a stage and a score-based prediction."""
    t = epoched(spark, d).groupBy("subject", "epoch_idx").agg(
        F.max("stage").alias("stage"),
        F.avg("bvp").alias("bvp"),
        F.avg("hr").alias("hr"),
        F.stddev_pop("ibi").alias("ibi_sd"),
    )
    # written once: the numbering below reads this table three times
    t = ep.dense_epochs(materialize(t, "nights"))
    return t.withColumns(
        {
            "sleep": F.when(F.col("stage") > 0, 1).otherwise(0),
            "pred": F.when(F.col("bvp") > 4, 1).otherwise(0),
        }
    )


NIGHT_SQL = f"""{EPOCH_SQL},
n0 AS (SELECT subject, epoch_idx, max(stage) AS stage, avg(bvp) AS bvp, avg(hr) AS hr, stddev_pop(ibi) AS ibi_sd FROM e GROUP BY ALL),
night AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY epoch_idx) - 1 AS epoch_no, count(*) OVER (PARTITION BY subject) AS n_epochs,
   CASE WHEN stage > 0 THEN 1 ELSE 0 END AS sleep, CASE WHEN bvp > 4 THEN 1 ELSE 0 END AS pred FROM n0)"""


@query(
    "aligned_labels",
    "J13",
    f"""WITH {NIGHT_SQL}, lab AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch_no, event_type AS label FROM events)
    SELECT subject, epoch_no, stage, label FROM night JOIN lab USING (subject, epoch_no)""",
)
def aligned_labels(spark, d):
    ev = src.segments(spark, d).select("subject", "event_id", "seg_time").join(
        src.table(spark, d, "events").select("event_id", F.col("event_type").alias("label")), "event_id"
    )
    lab = row_index(ev, ["subject"], time_bucket("seg_time", 6 * 3600), [F.col("seg_time"), F.col("event_id")], "epoch_no")
    n = nights(spark, d).select("subject", F.col("epoch_no").alias("epoch_idx"), "stage")
    out = ep.align_by_position(n, lab.select("subject", F.col("epoch_no").alias("epoch_idx"), "label"))
    return out.withColumnRenamed("epoch_idx", "epoch_no")


@query(
    "held_value_dedupe",
    "W2",
    f"""WITH {EPOCH_SQL} SELECT subject, epoch_idx, pos, ibi FROM (SELECT *, lag(ibi) OVER (PARTITION BY subject, epoch_idx ORDER BY pos) AS p FROM e)
    WHERE pos = 0 OR ibi IS DISTINCT FROM p""",
)
def held_value_dedupe(spark, d):
    w = Window.partitionBy("subject", "epoch_idx").orderBy("pos")
    t = epoched(spark, d).withColumn("__p", F.lag("ibi").over(w))
    return t.where((F.col("pos") == 0) | ~F.col("ibi").eqNullSafe(F.col("__p"))).select("subject", "epoch_idx", "pos", "ibi")


@query(
    "epoch_deltas",
    "W3",
    f"""WITH {NIGHT_SQL} SELECT subject, epoch_no, round(coalesce(hr - lag(hr) OVER w, lead(hr) OVER w - hr, 0), 6) + 0.0 AS delta_hr,
    round(coalesce(bvp - lag(bvp) OVER w, lead(bvp) OVER w - bvp, 0), 6) + 0.0 AS delta_bvp FROM night WINDOW w AS (PARTITION BY subject ORDER BY epoch_no)""",
)
def epoch_deltas(spark, d):
    t = ep.deltas(nights(spark, d), ["hr", "bvp"], "epoch_no")
    return rounded(t.select("subject", "epoch_no", F.col("Delta_hr").alias("delta_hr"), F.col("Delta_bvp").alias("delta_bvp")))


@query(
    "rolling_context",
    "W4 W5",
    f"""WITH {NIGHT_SQL} SELECT subject, epoch_no, round(avg(hr) OVER w, 6) + 0.0 AS ctx_rmean_hr, round(stddev_pop(bvp) OVER w, 6) + 0.0 AS ctx_rstd_bvp,
    round(epoch_no / greatest(1, n_epochs - 1), 6) AS ctx_epochpos FROM night WINDOW w AS (PARTITION BY subject ORDER BY epoch_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""",
)
def rolling_context(spark, d):
    t = ep.rolling_context(nights(spark, d), ["hr"], ["bvp"], 5, "epoch_no")
    return rounded(
        t.select(
            "subject",
            "epoch_no",
            F.col("Ctx_RMean_hr").alias("ctx_rmean_hr"),
            F.col("Ctx_RStd_bvp").alias("ctx_rstd_bvp"),
            ep.relative_position().alias("ctx_epochpos"),
        )
    )


@query(
    "median_smoothing",
    "W6",
    f"""WITH {NIGHT_SQL} SELECT subject, epoch_no, pred, CASE WHEN sum(pred) OVER w >= 4 THEN 1 ELSE 0 END AS smoothed
    FROM night WINDOW w AS (PARTITION BY subject ORDER BY epoch_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def median_smoothing(spark, d):
    t = ep.median_smooth(nights(spark, d), "pred", "epoch_no")
    return t.select("subject", "epoch_no", "pred", F.col("smoothed").cast("int").alias("smoothed"))


@query(
    "successive_differences",
    "W7",
    f"""WITH {SEGMENTS_SQL}, x AS (SELECT subject, hr, hr - lag(hr) OVER (PARTITION BY subject ORDER BY seg_time, event_id) AS dx FROM seg)
    SELECT subject, round(sqrt(avg(dx * dx)), 6) AS rmssd, round(avg(CASE WHEN abs(dx) > 50 THEN 1.0 WHEN dx IS NOT NULL THEN 0.0 END), 6) AS p50, round(sum(abs(dx)), 6) AS curve_length FROM x GROUP BY subject""",
)
def successive_differences(spark, d):
    s = src.segments(spark, d).select("subject", "seg_time", "event_id", "hr")
    t = row_index(s, ["subject"], time_bucket("seg_time", 6 * 3600), [F.col("seg_time"), F.col("event_id")])
    t = ep.blocks_with_halo(t, ["subject"], "idx", 1)
    t = ep.home_rows(t.withColumn("dx", F.col("hr") - F.lag("hr").over(ep.halo_window(["subject"], "idx"))))
    dx = F.col("dx")
    return rounded(
        t.groupBy("subject").agg(
            F.sqrt(F.avg(dx * dx)).alias("rmssd"),
            F.avg(F.when(F.abs(dx) > 50, 1.0).when(dx.isNotNull(), 0.0)).alias("p50"),
            F.sum(F.abs(dx)).alias("curve_length"),
        )
    )


@query(
    "subject_z_scores",
    "W8",
    f"""WITH {SEGMENTS_SQL}, m AS (SELECT subject, avg(hr) AS m, stddev_pop(hr) AS s FROM seg GROUP BY subject)
    SELECT event_id, subject, round(CASE WHEN s <> 0 THEN (hr - m) / s ELSE hr - m END, 6) + 0.0 AS z FROM seg JOIN m USING (subject)""",
)
def subject_z_scores(spark, d):
    s = src.segments(spark, d).select("subject", "event_id", "hr")
    m = s.groupBy("subject").agg(F.avg("hr").alias("m"), F.stddev_pop("hr").alias("s"))
    c = F.col("hr") - F.col("m")
    return rounded(join_per_key(s, m, ["subject"], "event_id").select("event_id", "subject", F.when(F.col("s") != 0, c / F.col("s")).otherwise(c).alias("z")))


@query(
    "wave_anchor",
    "W17",
    f"""WITH {SEGMENTS_SQL} SELECT event_id, subject, epoch_us(min(seg_time) OVER (PARTITION BY subject)) AS t0_us,
    CAST(floor((epoch_us(seg_time) - epoch_us(min(seg_time) OVER (PARTITION BY subject))) / 86400000000) AS BIGINT) AS day_no FROM seg""",
)
def wave_anchor(spark, d):
    s = src.segments(spark, d).select("subject", "event_id", "seg_time")
    t0 = s.groupBy("subject").agg(F.unix_micros(F.min("seg_time")).alias("t0_us"))
    day = F.floor((F.unix_micros("seg_time") - F.col("t0_us")) / 86_400_000_000)
    return join_per_key(s, t0, ["subject"], "event_id").select("event_id", "subject", "t0_us", day.alias("day_no"))


@query(
    "average_ranks",
    "W18",
    f"""WITH {SEGMENTS_SQL} SELECT event_id, subject, rank() OVER (PARTITION BY subject ORDER BY steps) + (count(*) OVER (PARTITION BY subject, steps) - 1) / 2.0 AS rk FROM seg""",
)
def average_ranks(spark, d):
    from vitalgrid.operators.ordering import tied_ranks

    s = src.segments(spark, d).select("subject", "event_id", "steps")
    r = tied_ranks(s, ["subject"], "steps").select("subject", "steps", "rank")
    return join_per_key(s, r, ["subject", "steps"], "event_id").select("event_id", "subject", F.col("rank").alias("rk"))


@query(
    "sleep_biomarkers",
    "A13",
    f"""WITH {NIGHT_SQL}, b AS (SELECT subject, count(*) AS n, sum(sleep) AS s, min(CASE WHEN sleep = 1 THEN epoch_no END) AS f, max(CASE WHEN sleep = 1 THEN epoch_no END) AS l FROM night GROUP BY subject),
    w AS (SELECT subject, count(*) AS wake FROM night JOIN b USING (subject) WHERE sleep = 0 AND epoch_no BETWEEN f AND l GROUP BY subject)
    SELECT subject, round(s * 0.5, 1) AS tst_minutes, CASE WHEN s = 0 THEN n * 0.5 ELSE round(f * 0.5, 1) END AS sol_minutes,
    CASE WHEN s = 0 THEN 0.0 ELSE round(coalesce(wake, 0) * 0.5, 1) END::DOUBLE AS waso_minutes, round(s * 100.0 / n, 1) AS sleep_efficiency_pct FROM b LEFT JOIN w USING (subject)""".replace(
        "0.5", "0.5::DOUBLE"
    ).replace("100.0", "100.0::DOUBLE"),
)
def sleep_biomarkers(spark, d):
    return ep.sleep_biomarkers(nights(spark, d))


@query(
    "night_summary",
    "A14 M18",
    f"""WITH {NIGHT_SQL} SELECT subject, count(*) AS n, count(CASE WHEN sleep = 0 THEN 1 END) AS gt_wake, count(CASE WHEN sleep = 1 THEN 1 END) AS gt_sleep,
    count(CASE WHEN pred = 0 THEN 1 END) AS pred_wake, count(CASE WHEN pred = 1 THEN 1 END) AS pred_sleep,
    round(avg(CASE WHEN sleep = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(abs(bvp) / 50.37), 6) AS mean_confidence FROM night GROUP BY subject""",
)
def night_summary(spark, d):
    t = nights(spark, d)
    return rounded(
        t.groupBy("subject").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("sleep") == 0).alias("gt_wake"),
            F.count_if(F.col("sleep") == 1).alias("gt_sleep"),
            F.count_if(F.col("pred") == 0).alias("pred_wake"),
            F.count_if(F.col("pred") == 1).alias("pred_sleep"),
            F.avg(F.when(F.col("sleep") == F.col("pred"), 1.0).otherwise(0.0)).alias("accuracy"),
            F.avg(F.abs("bvp") / 50.37).alias("mean_confidence"),
        )
    )


@query(
    "hypnogram_series",
    "E16",
    f"""WITH {NIGHT_SQL} SELECT subject, epoch_no, CASE stage WHEN 0 THEN 4 WHEN 4 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS level, round(epoch_no * 30 / 3600.0, 6) AS hours FROM night""",
)
def hypnogram_series(spark, d):
    # Plotting order of the stages, wake on top and deep sleep at the bottom.
    order = {0: 4, 4: 3, 1: 2, 2: 1, 3: 0}
    m = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return rounded(nights(spark, d).select("subject", "epoch_no", m[F.col("stage")].alias("level"), (F.col("epoch_no") * 30 / 3600.0).alias("hours")))


@query(
    "night_stress_readings",
    "J16",
    f"""WITH {SEGMENTS_SQL}, d AS (SELECT subject, diary_date, waso, sleep_duration FROM (SELECT *, row_number() OVER (PARTITION BY subject, diary_date ORDER BY waso, sleep_duration) AS rn FROM
      (SELECT o_custkey AS subject, DATE '2024-01-01' + CAST(o_orderkey % 34 AS INTEGER) AS diary_date, CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 47 AS DOUBLE) AS waso,
       (CAST(round(o_totalprice * 100) AS BIGINT) % 600) / 60.0::DOUBLE AS sleep_duration FROM orders)) WHERE rn = 1)
    SELECT subject, day, part, waso, count(*) AS n_readings, string_agg(CAST(epoch_us(seg_time) AS VARCHAR) || ':' || CAST(CAST(steps AS BIGINT) AS VARCHAR), ',' ORDER BY seg_time, event_id) AS readings
    FROM (SELECT d.subject, strftime(diary_date, '%Y-%m-%d') AS day, waso, seg_time, event_id, steps, (row_number() OVER (PARTITION BY d.subject, diary_date ORDER BY seg_time, event_id) - 1) // 1000 AS part
      FROM d JOIN seg ON seg.subject = d.subject AND CAST(seg_time AS DATE) = diary_date) GROUP BY subject, day, part, waso""",
)
def night_stress_readings(spark, d):
    dia = src.diary(spark, d).groupBy("subject", "diary_date").agg(F.min(F.struct("waso", "sleep_duration"))["waso"].alias("waso"))
    seg = src.segments(spark, d).withColumn("diary_date", F.to_date("seg_time"))
    # a day's payload is cut into parts of a thousand readings, so no array grows with the data
    keys = ["subject", "diary_date"]
    order = [F.col("seg_time"), F.col("event_id")]
    numbered = row_index(join_per_key(seg, dia, keys, "event_id"), keys, time_bucket("seg_time", 600), order)
    part = F.floor(F.col("idx") / 1000).cast("bigint").alias("part")
    joined = numbered.groupBy(*keys, "waso", part).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.array_sort(F.collect_list(F.struct(F.unix_micros("seg_time").alias("t"), "event_id", F.col("steps").cast("bigint").alias("s")))).alias("r"),
    )
    return joined.select(
        "subject",
        F.date_format("diary_date", "yyyy-MM-dd").alias("day"),
        "part",
        "waso",
        "n_readings",
        F.array_join(F.transform("r", lambda x: F.concat(x["t"].cast("string"), F.lit(":"), x["s"].cast("string"))), ",").alias("readings"),
    )


@query(
    "loso_fold_statistics",
    "J10 W8",
    f"""WITH {NIGHT_SQL}, f AS (SELECT DISTINCT subject AS fold FROM night)
    SELECT fold, count(CASE WHEN subject = fold THEN 1 END) AS n_test, count(CASE WHEN subject <> fold THEN 1 END) AS n_train,
    round(avg(CASE WHEN subject <> fold THEN hr END), 6) AS train_mean, round(stddev_pop(CASE WHEN subject <> fold THEN hr END), 6) AS train_std,
    round(avg(CASE WHEN subject = fold THEN hr END), 6) AS test_mean FROM night, f GROUP BY fold""",
)
def loso_fold_statistics(spark, d):
    # leave-one-out moments are total minus own: no copy of the data per fold
    t = nights(spark, d).select("subject", "hr").withColumn("c", F.col("hr") - 85.0)
    own = t.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    tot = own.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    n, s, q = F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s"), F.col("all_q") - F.col("q")
    both = with_scalars(own, tot)
    return rounded(
        both.select(
            F.col("subject").alias("fold"),
            F.col("n").alias("n_test"),
            n.alias("n_train"),
            (s / n + 85.0).alias("train_mean"),
            F.sqrt(q / n - (s / n) * (s / n)).alias("train_std"),
            (F.col("s") / F.col("n") + 85.0).alias("test_mean"),
        )
    )
