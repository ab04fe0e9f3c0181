"""The given parquet tables, projected to the sensor, survey, diary and sample roles.

Each role comes as a Spark builder and as a SQL common table expression over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment table: events by user, with a full metric, one with gaps and a counter."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"),
        F.col("ts").cast("timestamp").alias("seg_time"),
        "event_id",
        (F.col("value") / 1.37).alias("hr"),
        F.when(F.col("event_type") != "error", k).alias("rmssd"),
        F.pmod(k, F.lit(10.0)).alias("steps"),
    )


SEGMENTS_SQL = """seg AS (
  SELECT user_id AS subject, ts AS seg_time, event_id, value / 1.37::DOUBLE AS hr,
         CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS rmssd,
         CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS DOUBLE) AS steps
  FROM events)"""


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide survey, one first edition per subject and a later second edition for some."""
    key = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")

    def edition(df, no, shift):
        def score(x):
            raw = F.pmod(key * 7 + x * 5 + shift, F.lit(22)).cast("double")
            return F.when(F.pmod(key + x, F.lit(11)) != 0, raw)

        return df.select(
            key.alias("subject"),
            F.lit(no).alias("file_order"),
            score(1).alias("gad7_1"),
            score(2).alias("gad7_2"),
            score(3).alias("gad7_f"),
            F.pmod(key, F.lit(2)).cast("double").alias("sex"),
            (18 + F.pmod(key, F.lit(60))).cast("double").alias("age"),
            F.when(F.pmod(key, F.lit(13)) != 0, 150.0 + F.pmod(key, F.lit(50))).alias("height"),
            (50.0 + F.col("c_nationkey") * 2).alias("weight"),
        )

    return edition(base, 0, 0).unionByName(edition(base.where(F.pmod(key, F.lit(10)) == 0), 1, 3))


def _edition_sql(no, shift, where=""):
    def score(x):
        return f"CASE WHEN (c_custkey + {x}) % 11 <> 0 THEN CAST((c_custkey * 7 + {x * 5 + shift}) % 22 AS DOUBLE) END"

    return f"""SELECT c_custkey AS subject, {no} AS file_order, {score(1)} AS gad7_1, {score(2)} AS gad7_2,
         {score(3)} AS gad7_f, CAST(c_custkey % 2 AS DOUBLE) AS sex, CAST(18 + c_custkey % 60 AS DOUBLE) AS age,
         CASE WHEN c_custkey % 13 <> 0 THEN CAST(150 + c_custkey % 50 AS DOUBLE) END AS height,
         CAST(50 + c_nationkey * 2 AS DOUBLE) AS weight
  FROM customer {where}"""


SURVEY_SQL = f"""survey AS (
  {_edition_sql(0, 0)}
  UNION ALL
  {_edition_sql(1, 3, "WHERE c_custkey % 10 = 0")}),
survey1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY file_order) AS rn FROM survey) WHERE rn = 1)"""


DIARY_MEASURES = ("sleep_duration", "sleep_efficiency", "sleep_latency", "waso", "wakeup@night", "in_bed_duration")


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    cents = F.round(price * 100).cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(key, F.lit(34)).cast("int")).alias("diary_date"),
        (F.pmod(cents, F.lit(600)) / 60.0).alias("sleep_duration"),
        F.when(F.pmod(key, F.lit(7)) != 0, F.pmod(cents, F.lit(101)).cast("double")).alias("sleep_efficiency"),
        F.pmod(cents, F.lit(61)).cast("double").alias("sleep_latency"),
        F.pmod(cents, F.lit(47)).cast("double").alias("waso"),
        F.pmod(cents, F.lit(5)).cast("double").alias("wakeup@night"),
        (F.pmod(cents, F.lit(720)) / 60.0).alias("in_bed_duration"),
    )


DIARY_SQL = """diary AS (
  SELECT o_custkey AS subject, DATE '2024-01-01' + CAST(o_orderkey % 34 AS INTEGER) AS diary_date,
         (CAST(round(o_totalprice * 100) AS BIGINT) % 600) / 60.0::DOUBLE AS sleep_duration,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 101 AS DOUBLE) END AS sleep_efficiency,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 61 AS DOUBLE) AS sleep_latency,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 47 AS DOUBLE) AS waso,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 5 AS DOUBLE) AS "wakeup@night",
         (CAST(round(o_totalprice * 100) AS BIGINT) % 720) / 60.0::DOUBLE AS in_bed_duration
  FROM orders)"""


STAGE_NAMES = {("A", "F"): "W", ("A", "O"): "N1", ("N", "F"): "N2", ("N", "O"): "N3", ("R", "F"): "R", ("R", "O"): "P"}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sample stream before indexing: one row per sample of one recording (supplier)."""
    flags = F.concat("l_returnflag", "l_linestatus")
    stage = F.create_map(*[F.lit(x) for (a, b), s in STAGE_NAMES.items() for x in (a + b, s)])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "l_shipdate",
        (F.col("l_extendedprice") / 1013.7 - 45.0).alias("bvp"),
        (60.0 + F.col("l_quantity")).alias("hr"),
        (F.col("l_discount") * 34.7 / 3.142).alias("ibi"),
        (F.col("l_tax") * 100 + F.col("l_quantity") / 100.0).alias("eda"),
        (F.col("l_quantity") / 50.0).alias("acc_x"),
        F.col("l_discount").alias("acc_y"),
        F.col("l_tax").alias("acc_z"),
        stage[flags].alias("stage_name"),
    )


SAMPLE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "hr", "ibi", "acc_z")

_STAGE_CASE = " ".join(
    f"WHEN l_returnflag = '{a}' AND l_linestatus = '{b}' THEN '{s}'" for (a, b), s in STAGE_NAMES.items()
)
SAMPLES_SQL = f"""raw AS (
  SELECT l_suppkey AS subject, l_extendedprice / 1013.7::DOUBLE - 45.0::DOUBLE AS bvp, 60.0::DOUBLE + l_quantity AS hr,
         l_discount * 34.7::DOUBLE / 3.142::DOUBLE AS ibi, l_tax * 100 + l_quantity / 100.0::DOUBLE AS eda,
         l_quantity / 50.0::DOUBLE AS acc_x, l_discount AS acc_y, l_tax AS acc_z,
         CASE {_STAGE_CASE} END AS stage_name, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate
  FROM lineitem),
samples AS (
  SELECT *, row_number() OVER (PARTITION BY subject
     ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, hr, ibi, acc_z) - 1 AS sample_idx
  FROM raw)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table: event rows with two scores, a label and a fold group; some scores null."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    v = F.col("value")
    s1 = F.round(v / 501.7, 3)
    s2 = F.round((k * 0.6 + F.pmod(F.col("event_id"), F.lit(41))) / 100.0, 3)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("subject"),
        F.pmod("user_id", F.lit(5)).alias("fold"),
        F.when(k + v / 10 > 55, 1).otherwise(0).alias("y"),
        F.when(F.pmod("event_id", F.lit(97)) != 0, s1).alias("s1"),
        s2.alias("s2"),
        F.round(k / 5.0, 1).alias("gad7"),
    )


PREDICTIONS_SQL = """pred AS (
  SELECT event_id, user_id AS subject, user_id % 5 AS fold,
         CASE WHEN k + value / 10 > 55 THEN 1 ELSE 0 END AS y,
         CASE WHEN event_id % 97 <> 0 THEN round(value / 501.7::DOUBLE, 3) END AS s1,
         round((k * 0.6::DOUBLE + event_id % 41) / 100.0::DOUBLE, 3) AS s2,
         round(k / 5.0::DOUBLE, 1) AS gad7
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
