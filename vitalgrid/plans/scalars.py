"""Queries that exercise date, interval, ratio and top-k expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions import scalar as sc
from vitalgrid.plans.registry import query
from vitalgrid.plans.waves import rounded
from vitalgrid.sources import tables as src


@query(
    "time_expressions",
    "X26 X27 X28 X29",
    """WITH t AS (SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS t FROM events)
    SELECT event_id, hour(t) AS hour, strftime(t, '%Y-%m-%d') AS day, epoch_us(t + INTERVAL 14 DAY) AS plus_14, epoch_us(t + INTERVAL 1 SECOND) AS plus_1s, epoch_us(t - INTERVAL 28 DAY) AS minus_28,
    round(greatest(0.0, (epoch_us(t) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) / 86400000000.0), 6) AS elapsed_days FROM t""",
)
def time_expressions(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    t = src.table(spark, d, "events").select("event_id", sc.from_epoch_ms(ms).alias("t"))
    day = lambda n: F.make_dt_interval(F.lit(n))
    origin = F.unix_micros(F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return rounded(
        t.select(
            "event_id",
            F.hour("t").cast("bigint").alias("hour"),
            F.date_format("t", "yyyy-MM-dd").alias("day"),
            F.unix_micros(F.col("t") + day(14)).alias("plus_14"),
            F.unix_micros(F.col("t") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))).alias("plus_1s"),
            F.unix_micros(F.col("t") - day(28)).alias("minus_28"),
            F.greatest(F.lit(0.0), (F.unix_micros("t") - origin) / 86_400_000_000.0).alias("elapsed_days"),
        )
    )


@query(
    "guarded_math",
    "X30 X31 X32",
    """WITH t AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT event_id, round(1 / (1 + exp(-least(greatest((k - 50) * value / 7.3, -30), 30))), 9) AS sig, round(least(greatest(0.3 * value / 1.37 + 0.7 * k, 0), 21), 4) AS blended,
    round(coalesce(value / nullif(k, 0), 0) / 1.37, 6) AS ratio0, round(value / nullif(k, 0) / 1.37, 6) AS ratio_null FROM t""",
)
def guarded_math(spark, d):
    k, v = F.get_json_object("props", "$.k").cast("double"), F.col("value")
    return src.table(spark, d, "events").select(
        "event_id",
        F.round(sc.sigmoid((k - 50) * v / 7.3), 9).alias("sig"),
        F.round(sc.clamp(sc.blend(v / 1.37, k, 0.3), 0, 21), 4).alias("blended"),
        F.round(sc.safe_ratio(v, k) / 1.37, 6).alias("ratio0"),
        F.round(sc.safe_ratio(v, k, None) / 1.37, 6).alias("ratio_null"),
    )


@query(
    "payload_columns",
    "X37 X38",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS missing, '{\"subject\":' || user_id || ',\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS out FROM events",
)
def payload_columns(spark, d):
    p = F.from_json("props", "k bigint, missing double")
    t = src.table(spark, d, "events").withColumn("p", p)
    return t.select(
        "event_id", "p.k", "p.missing", F.to_json(F.struct(F.col("user_id").alias("subject"), F.col("p.k").alias("k"))).alias("out")
    )


@query(
    "top_columns",
    "T2",
    """SELECT l_partkey AS feature, round(sum(l_extendedprice), 2) AS importance FROM lineitem GROUP BY 1 ORDER BY round(sum(l_extendedprice), 2) DESC, 1 LIMIT 22""",
)
def top_columns(spark, d):
    t = src.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.round(F.sum("l_extendedprice"), 2).alias("importance"))
    return t.orderBy(F.col("importance").desc(), "feature").limit(22)


@query(
    "first_wins_argmax",
    "T6",
    """SELECT o_custkey AS subject, max(o_totalprice) AS metric, min(o_orderkey) FILTER (WHERE r = 1) AS grid FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) GROUP BY 1""",
)
def first_wins_argmax(spark, d):
    best = F.max(F.struct(F.col("o_totalprice").alias("m"), (-F.col("o_orderkey")).alias("g")))
    t = src.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(best.alias("b"))
    return t.select("subject", F.col("b.m").alias("metric"), (-F.col("b.g")).alias("grid"))
