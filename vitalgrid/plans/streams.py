"""Streaming jobs drained over the given tables; each has the batch result as its check."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.operators import models as md
from vitalgrid.operators.epochs import EPOCH_SECONDS
from vitalgrid.operators.ordering import row_index, value_bucket
from vitalgrid.operators.textops import message_key
from vitalgrid.plans.epochs import epoched, stage_code
from vitalgrid.plans.messages import CRISIS_SQL, KEYS, LANG_SQL, MESSAGES_SQL, SCORE_SQL, SOFT_SQL, TRIVIAL_SQL, features_sql, messages
from vitalgrid.plans.registry import query
from vitalgrid.plans.signals import STRESS_FEATURES, stress_features
from vitalgrid.plans.tables import FEEDBACK_SQL, feedback_lines
from vitalgrid.plans.waves import rounded
from vitalgrid.session import materialize
from vitalgrid.sources import tables as src
from vitalgrid.sources.tables import SEGMENTS_SQL
from vitalgrid.streaming import jobs
from vitalgrid.streaming import state as st

FEEDBACK_FEATURES = ", ".join(f"{e} AS {n}" for n, e in features_sql("preview").items())
CUTS = ("2024-01-11", "2024-01-21")


def drained_segments(spark, d, build, out):
    """Segments arrive in time order, in three slices; the stream is drained, and so started anew, after each."""
    path = jobs.stream_dir(spark, "segments")
    seg = src.segments(spark, d)
    a, b = (F.lit(c).cast("timestamp") for c in CUTS)
    t = F.col("seg_time")
    drain = lambda: jobs.run_available(build(jobs.file_stream(spark, path, seg.schema, files_per_batch=None)), out, "update")
    jobs.arrivals(seg, path, [t < a, (t >= a) & (t < b), t >= b], drain)


@query(
    "streamed_feature_windows",
    "K1",
    f"""WITH {SEGMENTS_SQL} SELECT subject, epoch_us(time_bucket(INTERVAL 5 MINUTE, seg_time)) AS start_us, count(*) AS n, round(avg(hr), 6) AS "HR_mean", round(stddev_samp(hr), 6) AS "HR_std", round(avg(steps), 6) AS steps_mean, round(stddev_samp(steps), 6) AS steps_std FROM seg GROUP BY 1, 2""",
)
def streamed_feature_windows(spark, d):
    out = jobs.stream_dir(spark, "windows")
    names = {"hr_mean": "HR_mean", "hr_std": "HR_std"}
    drained_segments(spark, d, lambda seg: jobs.feature_windows(seg, "subject", "seg_time", ["hr", "steps"], names=names), out)
    t = jobs.latest_per_key(spark, out, ["subject", "window_start"])
    return rounded(t.withColumn("start_us", F.unix_micros("window_start")).drop("window_start"))


INTERVAL = EPOCH_SECONDS  # samples, at one a second


def interval_scores(samples, model):
    """Eleven features and the model's class of every interval of samples (subject, interval, sample_idx, code, bvp).

    Streams and tables of samples go through the same expressions.
    """
    pos = F.pmod("sample_idx", F.lit(INTERVAL))
    epochs = samples.withColumnRenamed("interval", "epoch_idx").withColumns({"pos": pos, "stage": F.when(pos == 0, F.col("code"))})
    scored = model.transform(md.assembler(STRESS_FEATURES).transform(stress_features(epochs)))
    return scored.select("subject", "epoch_idx", "stage", F.col("prediction").cast("int").alias("predicted"), *STRESS_FEATURES)


def interval_samples(spark, d):
    """Numbered samples of each recording: subject, sample_idx, code (the sample's stage), bvp."""
    order = [F.col(c) for c in src.SAMPLE_ORDER]
    rows = row_index(src.samples(spark, d), ["subject"], value_bucket("l_orderkey", 4096), order, "sample_idx")
    return rows.select("subject", "sample_idx", stage_code(F.col("stage_name")).alias("code"), "bvp")


def interval_model(spark, d):
    """A tree of depth 10 that tells sleep stages from the eleven features, fitted on four subjects of five."""
    t = materialize(stress_features(epoched(spark, d)), "stages").where(F.pmod("subject", F.lit(5)) != 0)
    return md.tree_classifier("stage").fit(md.assembler(STRESS_FEATURES).transform(t))


@query("streamed_window_scores", "K2 M18 G15")
def streamed_window_scores(spark, d):
    model, samples = interval_model(spark, d), materialize(interval_samples(spark, d), "samples")
    path, out = jobs.stream_dir(spark, "samples"), jobs.stream_dir(spark, "scores")

    def drain():
        stream = jobs.file_stream(spark, path, samples.schema, files_per_batch=None)
        st.score_intervals(stream, out, "subject", "sample_idx", INTERVAL, lambda part: interval_scores(part, model))

    i = F.col("sample_idx")  # the cuts fall inside intervals
    jobs.arrivals(samples, path, [i < 215, (i >= 215) & (i < 430), i >= 430], drain)
    return rounded(st.scored(spark, out))


@query(
    "streamed_feedback_scores",
    "K3 S11 X23",
    f"""WITH {FEEDBACK_SQL}, ft AS (SELECT label, preview, {FEEDBACK_FEATURES} FROM fb)
    SELECT label, score, count(*) AS n, CAST(sum(length(preview)) AS BIGINT) AS chars FROM (SELECT label, preview, {SCORE_SQL} AS score FROM ft) GROUP BY label, score""",
)
def streamed_feedback_scores(spark, d):
    path, out = jobs.stream_dir(spark, "log"), jobs.stream_dir(spark, "rescored")
    feedback_lines(spark, d).select("value").write.text(path)
    jobs.run_available(jobs.rescored_feedback(jobs.file_stream(spark, path, "value string", "text", 4)), out)
    t = spark.read.parquet(f"{out}/data")
    return t.groupBy("label", F.round("score", 3).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("preview")).alias("chars"))


@query(
    "streamed_first_messages",
    "K4",
    f"WITH {MESSAGES_SQL} SELECT DISTINCT lower(trim(text, ' ')) AS message_key FROM msg",
)
def streamed_first_messages(spark, d):
    m = messages(spark, d)
    start = F.lit("2024-01-01").cast("timestamp")
    rows = m.select(
        "conv_id",
        "turn",
        message_key("text").alias("message_key"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("conv_id", F.lit(3600)))).alias("ts"),
    )
    path, out = jobs.stream_dir(spark, "turns"), jobs.stream_dir(spark, "first")
    rows.write.parquet(path)
    jobs.run_available(jobs.first_messages(jobs.file_stream(spark, path, rows.schema, files_per_batch=4), "ts", "message_key"), out)
    return spark.read.parquet(f"{out}/data").select("message_key")


@query(
    "streamed_moderation",
    "K5 X4 X5 X6 X7",
    f"WITH {MESSAGES_SQL} SELECT {KEYS}, {CRISIS_SQL} AS crisis, {SOFT_SQL} AS soft, {LANG_SQL} AS lang, {TRIVIAL_SQL} AS trivial FROM msg",
)
def streamed_moderation(spark, d):
    m = messages(spark, d).select("conv_id", "turn", "text")
    path, out = jobs.stream_dir(spark, "turns"), jobs.stream_dir(spark, "flags")
    m.write.parquet(path)
    jobs.run_available(jobs.moderated(jobs.file_stream(spark, path, m.schema, files_per_batch=4)), out)
    return spark.read.parquet(f"{out}/data").drop("batch_id")


@query(
    "streamed_last_messages",
    "K6 W16",
    f"""WITH {MESSAGES_SQL} SELECT {KEYS}, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM msg) WHERE rn <= 5""",
)
def streamed_last_messages(spark, d):
    m = messages(spark, d).select("conv_id", "turn", "role", "text")
    path, out = jobs.stream_dir(spark, "turns"), jobs.stream_dir(spark, "last")
    drain = lambda: st.newest_rows(jobs.file_stream(spark, path, m.schema, files_per_batch=None), out, "conv_id", "turn", 5)
    jobs.arrivals(m, path, [F.col("turn") < 3, (F.col("turn") >= 3) & (F.col("turn") < 6), F.col("turn") >= 6], drain)
    return st.kept_rows(spark, out).select("conv_id", "turn", "role")
