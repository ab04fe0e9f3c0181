"""Queries over sources, sinks, headers, coercion, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalgrid.functions import headers as hd
from vitalgrid.functions import scalar as sc
from vitalgrid.operators import textops
from vitalgrid.operators import waves as wave_ops
from vitalgrid.operators.ordering import exact_quantiles, join_per_key, row_index, with_scalars
from vitalgrid.plans.registry import query
from vitalgrid.plans.waves import PERSON_WAVE_SQL, person_waves, rounded
from vitalgrid.session import scratch_dir
from vitalgrid.sources import files
from vitalgrid.sources import tables as src
from vitalgrid.sources.tables import SEGMENTS_SQL, SURVEY_SQL

# ---------------------------------------------------------------- sources and sinks


@query(
    "csv_sink_and_scan",
    "S1 S15",
    """SELECT user_id AS subject, count(*) AS n, round(sum(value), 4) AS total, count(CASE WHEN event_type = 'view' THEN 1 END) AS views
    FROM events GROUP BY 1""",
)
def csv_sink_and_scan(spark, d):
    path = scratch_dir(spark, "csv")
    files.write_csv(src.table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path)
    back = files.read_csv(spark, path, "event_id bigint, user_id bigint, event_type string, value double")
    return back.groupBy(F.col("user_id").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("views"),
    )


@query("preferred_source", "S2", "SELECT user_id AS subject, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def preferred_source(spark, d):
    root = scratch_dir(spark, "sensor")
    ev = src.table(spark, d, "events").select("event_id", "user_id", "event_type")
    files.write_csv(ev, f"{root}/sensor_hrv.csv")
    files.write_csv(ev.where("event_type <> 'error'"), f"{root}/sensor_hrv_filtered.csv")
    path = files.preferred_source(spark, root, ("sensor_hrv_filtered.csv", "sensor_hrv.csv"))
    back = files.read_csv(spark, path, "event_id bigint, user_id bigint, event_type string")
    return back.groupBy(F.col("user_id").alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "table_inventory_scan",
    "S3 S4 S8",
    """SELECT 'hrv' AS kind, 3 AS n_cols, 'event_id, sdnn, rmssd' AS header, count(*) AS n_rows FROM events
    UNION ALL SELECT 'questionnaire', 3, 'deviceId, GAD7_1, GAD7_2', count(*) FROM customer
    UNION ALL SELECT 'sleep_diary', 3, 'userId, date, waso', count(*) FROM orders""",
)
def table_inventory_scan(spark, d):
    root = scratch_dir(spark, "inventory")
    ev = src.table(spark, d, "events")
    files.write_csv(ev.select("event_id", F.col("value").alias("sdnn"), F.col("value").alias("rmssd")), f"{root}/a")
    c = src.table(spark, d, "customer")
    files.write_csv(c.select(F.col("c_custkey").alias("deviceId"), F.col("c_acctbal").alias("GAD7_1"), F.col("c_acctbal").alias("GAD7_2")), f"{root}/b")
    o = src.table(spark, d, "orders")
    files.write_csv(o.select(F.col("o_custkey").alias("userId"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("waso")), f"{root}/c/deep")
    inv = files.header_inventory(spark, root)
    lines = spark.read.option("recursiveFileLookup", True).text(root).groupBy(F.col("_metadata.file_path").alias("path"))
    counted = inv.join(lines.agg((F.count(F.lit(1)) - 1).alias("n")), "path")  # a line per file is its header
    named = counted.select(hd.table_role(F.col("cols")).alias("kind"), "cols", "n")
    return named.groupBy("kind", F.size("cols").alias("n_cols"), F.array_join("cols", ", ").alias("header")).agg(F.sum("n").alias("n_rows"))


@query(
    "recording_choice",
    "S8 S5 P11",
    """SELECT 'S' || lpad(l_suppkey::VARCHAR, 3, '0') AS sid, CASE WHEN l_suppkey % 3 = 0 THEN 100 ELSE 64 END AS rate, count(*) AS n,
    round(sum(l_tax * 100), 4) AS bvp, round(CASE WHEN l_suppkey % 3 = 0 THEN sum(l_quantity) END, 2) AS hr,
    count(*) FILTER (l_returnflag = 'A') AS staged FROM lineitem
    WHERE l_suppkey BETWEEN 1 AND 9 AND l_suppkey % 4 <> 0 GROUP BY l_suppkey""",
)
def recording_choice(spark, d):
    """Exports at 100 Hz for every third subject, recordings at 64 Hz for all; every fourth subject has no stages in either."""
    root = scratch_dir(spark, "recordings")
    line = src.table(spark, d, "lineitem").where(F.col("l_suppkey").between(1, 12))
    who, bvp = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0")), (F.col("l_tax") * 100).alias("BVP")
    stage = F.when(F.col("l_returnflag") == "A", "W").alias("Sleep_Stage")
    staged, s = F.pmod("l_suppkey", F.lit(4)) != 0, F.col("l_suppkey")
    layouts = [
        ("_PSG_df_updated", staged & (s % 3 == 0), [F.col("l_quantity").alias("HR"), stage, bvp]),
        ("_PSG_df_updated", ~staged & (s % 3 == 0), [F.col("l_quantity").alias("HR"), bvp]),
        ("_whole_df", staged, [bvp, stage]),
        ("_whole_df", ~staged, [bvp]),
    ]
    for end, some, columns in layouts:
        rows = line.where(some).select(F.concat(who, F.lit(f"{end}.csv")).alias("file"), *columns)
        rows.write.option("header", True).partitionBy("file").mode("append").csv(root)
    r = files.recordings(spark, root, ["BVP", "HR"], 1, 9)
    return r.groupBy("sid", "rate").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("BVP"), 4).alias("bvp"),
        F.round(F.sum("HR"), 2).alias("hr"),
        F.count("Sleep_Stage").alias("staged"),
    )


@query(
    "subject_range_scan",
    "S7 S18",
    "SELECT l_suppkey AS subject, count(*) AS n FROM lineitem WHERE l_suppkey BETWEEN 3 AND 40 GROUP BY 1",
)
def subject_range_scan(spark, d):
    path = scratch_dir(spark, "epochs")
    rows = src.samples(spark, d).select("subject", "l_orderkey", "bvp", "stage_name")
    files.write_partitioned(rows, path, "subject", "l_orderkey")
    back = spark.read.parquet(path).where(F.col("subject") <= 40)  # a folder's first subject
    first = files.subject_from_path(F.input_file_name())
    return (
        back.withColumn("first", first)
        .where((F.col("first").cast("bigint") <= 40) & files.in_subject_range(F.col("sid"), 3, 40))
        .groupBy(F.col("sid").cast("bigint").alias("subject"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Stage digit to class, 4 merges into 3, 9 is unscored.
STAGE_DIGITS = {"0": 0, "1": 1, "2": 2, "3": 3, "4": 3, "5": 4, "9": -1}


def stage_digit(concept):
    digit = F.regexp_extract(concept, r"\d", 0)
    m = F.create_map(*[F.lit(x) for kv in STAGE_DIGITS.items() for x in kv])
    return F.coalesce(m[F.when(digit == "", "9").otherwise(digit)], F.lit(-1))


_EVENTS_XML = """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'Arousal|1' ELSE concat('Stage ', o_orderkey % 8, '|', o_orderkey % 8) END AS concept,
   CAST(15 + (o_orderkey % 9) * 20 AS DOUBLE) AS duration FROM orders"""


@query(
    "scored_event_stages",
    "S9 P12 F2",
    f"""WITH ev AS ({_EVENTS_XML}),
    lab AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE -1 END AS stage,
       CAST(floor(duration / 30) AS BIGINT) AS epochs FROM ev WHERE concept LIKE '%Stage%')
    SELECT stage, count(*) AS events, CAST(sum(epochs) AS BIGINT) AS epochs FROM lab WHERE stage <> -1 AND epochs > 0 GROUP BY stage""",
)
def scored_event_stages(spark, d):
    k = F.col("o_orderkey")
    concept = F.when(F.pmod(k, F.lit(6)) == 5, "Arousal|1").otherwise(
        F.concat(F.lit("Stage "), F.pmod(k, F.lit(8)), F.lit("|"), F.pmod(k, F.lit(8)))
    )
    ev = src.table(spark, d, "orders").select(
        concept.alias("EventConcept"), (15 + F.pmod(k, F.lit(9)) * 20).cast("double").alias("Duration")
    )
    path = scratch_dir(spark, "xml")
    ev.write.format("xml").option("rowTag", "ScoredEvent").option("rootTag", "PSGAnnotation").save(path)
    n = F.floor(F.col("Duration") / 30)
    rows = files.scored_events(spark, path).where(n > 0).select(
        stage_digit(F.col("EventConcept")).alias("stage"), F.explode(F.sequence(F.lit(1), n)).alias("epoch")
    )
    return (
        rows.where("stage <> -1")
        .groupBy("stage")
        .agg(F.sum((F.col("epoch") == 1).cast("bigint")).alias("events"), F.count(F.lit(1)).alias("epochs"))
    )


@query(
    "jsonl_scan",
    "S10",
    """SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE doc_id % 5 <> 0 GROUP BY lang""",
)
def jsonl_scan(spark, d):
    doc = src.table(spark, d, "documents")
    line = F.to_json(F.struct(F.col("text").alias("message"), F.col("lang").alias("title")))
    k = F.pmod("doc_id", F.lit(10))
    out = doc.select(F.when(k == 0, F.lit("")).when(k == 5, F.concat(F.lit('{"message": '), "lang")).otherwise(line).alias("value"))
    path = scratch_dir(spark, "jsonl")
    out.write.text(path)
    back = files.read_jsonl(spark, path, "message string, title string").where("title IS NOT NULL")
    return back.groupBy(F.col("title").alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars")
    )


def feedback_lines(spark, d):
    """Assistant turns as rated log lines; previews hold no quotes or line breaks."""
    conv = src.table(spark, d, "conversations").where("role = 'assistant'")
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    rating = F.when(n < 2, "up").when(n < 4, "down").otherwise("none")
    text = F.regexp_replace("text", r"['\n\r]", " ")
    return conv.select(
        "conv_id",
        "turn",
        F.concat(F.lit("2024-01-01 INFO rating="), rating, F.lit(" user=7 response_preview='"), text, F.lit("' done")).alias("value"),
    )


FEEDBACK_SQL = r"""fb AS (
  SELECT conv_id, turn, trim(t, ' ') AS preview, CASE WHEN n < 2 THEN 1 ELSE 0 END AS label FROM (
    SELECT conv_id, turn, (conv_id + turn) % 5 AS n, regexp_replace(text, '[''\n\r]', ' ', 'g') AS t
    FROM conversations WHERE role = 'assistant')
  WHERE n < 4 AND length(trim(t, ' ')) > 15)"""


@query("feedback_log_scan", "S11 D16", f"WITH {FEEDBACK_SQL} SELECT label, count(*) AS n, CAST(sum(length(preview)) AS BIGINT) AS chars, max(length(preview)) AS longest FROM fb GROUP BY label")
def feedback_log_scan(spark, d):
    path = scratch_dir(spark, "log")
    feedback_lines(spark, d).select("value").write.text(path)
    ex = files.parse_feedback(spark.read.text(path))
    return ex.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("preview")).alias("chars"), F.max(F.length("preview")).cast("bigint").alias("longest")
    )


@query(
    "labelled_split_scan",
    "S12 P12",
    """WITH t AS (SELECT o_orderkey % 5 = 0 AS is_test, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 END AS condition,
      CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS x FROM orders)
    SELECT is_test, condition, count(*) AS n, round(sum(x), 2) AS total FROM t WHERE condition IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2""",
)
def labelled_split_scan(spark, d):
    names = {"1-URGENT": 0, "2-HIGH": 1, "5-LOW": 2}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    k = F.col("o_orderkey")
    t = src.table(spark, d, "orders").select(
        (F.pmod(k, F.lit(5)) == 0).alias("is_test"),
        m[F.col("o_orderpriority")].alias("condition"),
        F.when(F.pmod(k, F.lit(17)) != 0, F.col("o_totalprice")).alias("x"),
    )
    return t.na.drop().groupBy("is_test", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("total"))


@query(
    "manifest_features",
    "S14 X38 D19",
    """SELECT n_nationkey AS model_id, pos, CASE WHEN n_nationkey % 2 = 0 THEN 'sleep_' ELSE 'hrv_' END || lower(n_name) || '_' || pos AS feature
    FROM nation, range(3) AS r(pos) WHERE n_nationkey % 2 = 0 OR pos < 2""",
)
def manifest_features(spark, d):
    low = F.lower("n_name")
    n = src.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("model_id"),
        F.to_json(
            F.struct(
                F.when(F.pmod("n_nationkey", F.lit(2)) == 0, "hrv_sleep").otherwise("hrv_only").alias("inference_use_variant"),
                F.array(*[F.concat(F.lit("hrv_"), low, F.lit(f"_{i}")) for i in range(2)]).alias("feature_names_hrv_only"),
                F.array(*[F.concat(F.lit("sleep_"), low, F.lit(f"_{i}")) for i in range(3)]).alias("feature_names_hrv_sleep"),
            )
        ).alias("j"),
    )
    schema = "inference_use_variant string, feature_names_hrv_only array<string>, feature_names_hrv_sleep array<string>"
    m = n.withColumn("m", F.from_json("j", schema))
    names = F.when(F.col("m.inference_use_variant") == "hrv_sleep", F.col("m.feature_names_hrv_sleep")).otherwise(F.col("m.feature_names_hrv_only"))
    return m.select("model_id", F.posexplode(names).alias("pos", "feature")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "json_report",
    "S16 X38",
    """SELECT l_returnflag AS tag, count(*) AS n, round(avg(l_tax), 6) AS mean_tax, CASE WHEN l_returnflag = 'R' THEN NULL ELSE round(max(l_discount), 4) END AS threshold
    FROM lineitem GROUP BY 1""",
)
def json_report(spark, d):
    t = src.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tag")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_tax"), 6).alias("mean_tax"), F.round(F.max("l_discount"), 4).alias("thr")
    )
    thr = F.when(F.col("tag") == "R", F.lit(float("inf"))).otherwise(F.col("thr"))
    path = scratch_dir(spark, "report")
    t.select("tag", F.struct("n", "mean_tax", sc.finite_or_null(thr).alias("threshold")).alias("metrics")).write.json(path)
    back = spark.read.schema("tag string, metrics struct<n: bigint, mean_tax: double, threshold: double>").json(path)
    return back.select("tag", "metrics.*")


PAIRS_SQL = r"""pairs AS (SELECT conv_id, turn, text AS message, CASE WHEN turn % 3 = 0 THEN 'Work' WHEN turn % 3 = 1 THEN 'Work Stress Talk' ELSE ' Late  Night Worry ' END AS title FROM conversations)"""


def title_pairs(spark, d):
    t = F.pmod("turn", F.lit(3))
    return src.table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("message"),
        F.when(t == 0, "Work").when(t == 1, "Work Stress Talk").otherwise(" Late  Night Worry ").alias("title"),
    )


@query(
    "pair_validation",
    "F6 X3",
    f"WITH {PAIRS_SQL} SELECT conv_id, turn, title FROM pairs WHERE turn % 3 <> 0 AND trim(message) <> ''",
)
def pair_validation(spark, d):
    return textops.valid_pairs(title_pairs(spark, d)).select("conv_id", "turn", "title")


@query(
    "new_pairs",
    "J9 S17",
    f"""WITH {PAIRS_SQL}, k AS (SELECT *, lower(trim(message, ' ')) AS k FROM pairs)
    SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) AS rn FROM k WHERE conv_id % 3 <> 0)
    WHERE rn = 1 AND k NOT IN (SELECT k FROM k WHERE conv_id % 3 = 0)""",
)
def new_pairs(spark, d):
    p = title_pairs(spark, d)
    old = F.pmod("conv_id", F.lit(3)) == 0
    return textops.new_by_message(p.where(~old), p.where(old), ["conv_id", "turn"]).select("conv_id", "turn")


@query(
    "pair_append_sink",
    "S17 J9 F6",
    f"""WITH {PAIRS_SQL} SELECT count(DISTINCT lower(trim(message, ' '))) AS n, count(DISTINCT lower(trim(message, ' '))) AS distinct_messages FROM pairs
    WHERE turn % 3 <> 0 AND trim(message, ' ') <> ''""",
)
def pair_append_sink(spark, d):
    path = scratch_dir(spark, "pairs")
    p = title_pairs(spark, d)
    for part in (0, 1):
        files.append_new_pairs(spark, path, p.where(F.pmod("conv_id", F.lit(2)) == part), ["conv_id", "turn"])
    back = files.stored_pairs(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(textops.message_key("message")).alias("distinct_messages"))


@query(
    "feature_cache",
    "S19",
    "SELECT l_suppkey AS subject, count(*) AS n, round(max(l_tax), 4) AS top FROM lineitem GROUP BY 1",
)
def feature_cache(spark, d):
    path = scratch_dir(spark, "cache")

    def build():
        return src.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.max("l_tax"), 4).alias("top")
        )

    files.cached_table(spark, path, d, build, 3)
    table, reused = files.cached_table(spark, path, d, build, 3)
    assert reused
    return table


# ---------------------------------------------------------------- header rules

# Header names derived from what a user did on a day; spellings vary by user.
_HEADERS = {
    "signup": (" Device ID ", "participant no", "Item User"),
    "purchase": ("GAD7 Score", "gad_3", "PHQ total"),
    "error": ("rmssd", "SDNN", "lf/hf"),
    "view": ("Start Time", "Visit Date", "q1"),
    "click": ("WASO", "notes", "isi_score"),
}


def header_tables(spark, d):
    ev = src.table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    u = F.pmod("user_id", F.lit(3))
    name = F.coalesce(
        *[F.when(F.col("event_type") == t, F.element_at(F.array(*[F.lit(x) for x in v]), (u + 1).cast("int"))) for t, v in _HEADERS.items()]
    )
    # at most one name per event type, so the array is bounded by five
    return ev.groupBy("user_id", "day").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_type", name.alias("h")))), lambda s: s["h"]).alias("cols")
    ).withColumn("path", F.concat(F.lit("root/"), F.col("user_id"), F.lit("/"), F.date_format("day", "yyyy-MM-dd"), F.lit(".csv")))


_HCASE = " ".join(
    f"WHEN event_type = '{t}' AND user_id % 3 = {i} THEN '{x}'" for t, v in _HEADERS.items() for i, x in enumerate(v)
)
HEADERS_SQL = f"""hdr AS (
  SELECT user_id, day, 'root/' || user_id || '/' || strftime(day, '%Y-%m-%d') || '.csv' AS path, list(h ORDER BY event_type) AS cols
  FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type, CASE {_HCASE} END AS h FROM events) GROUP BY user_id, day),
lc AS (SELECT path, cols, list_transform(cols, lambda c: regexp_replace(lower(trim(c)), '\\s+', '_', 'g')) AS norms,
         list_transform(cols, lambda c: lower(c)) AS low FROM hdr)"""


@query(
    "header_normalization",
    "P1",
    f"WITH {HEADERS_SQL} SELECT path, array_to_string(norms, '|') AS normalized FROM lc",
)
def header_normalization(spark, d):
    t = header_tables(spark, d)
    return t.select("path", F.array_join(F.transform("cols", hd.normalize), "|").alias("normalized"))


@query(
    "header_inference",
    "P2 P3 P4",
    f"""WITH {HEADERS_SQL} SELECT path,
      CASE WHEN list_contains(norms, 'device_id') THEN ' Device ID ' WHEN list_contains(norms, 'participant_no') THEN 'participant no' END AS subject_col,
      CASE WHEN list_contains(cols, 'Start Time') THEN 'Start Time' WHEN list_contains(cols, 'Visit Date') AND CAST(left(right(path, 6), 2) AS INTEGER) % 2 = 0 THEN 'Visit Date' END AS time_col,
      CASE WHEN list_contains(cols, 'GAD7 Score') THEN 'GAD7 Score' END AS score_col,
      CASE WHEN list_contains(cols, 'gad_3') THEN 'gad_3' ELSE '' END AS items FROM lc""",
)
def header_inference(spark, d):
    t = header_tables(spark, d)
    c = F.col("cols")
    # visit dates are text on even days and numbers on odd ones
    text_columns = F.filter("cols", lambda x: (x != "Visit Date") | (F.dayofmonth("day") % 2 == 0))
    return t.select(
        "path",
        hd.subject_column(c).alias("subject_col"),
        hd.time_column(c, text_columns).alias("time_col"),
        hd.score_column(c).alias("score_col"),
        F.array_join(hd.score_items(c), "|").alias("items"),
    )


_ROLE_SQL = f"""{HEADERS_SQL}, flags AS (SELECT path, cols,
  len(list_filter(low, lambda c: c LIKE '%gad%' OR c LIKE '%phq%' OR c LIKE 'isi%')) > 0 AS quest,
  len(list_filter(low, lambda c: c LIKE '%rmssd%' OR c LIKE '%sdnn%' OR c LIKE '%lf/hf%')) > 0 AS hrv,
  len(list_filter(low, lambda c: c LIKE '%waso%')) > 0 AS sleep FROM lc),
role AS (SELECT path, cols, CASE WHEN hrv AND quest THEN 'mixed' WHEN quest THEN 'questionnaire' WHEN hrv THEN 'hrv' WHEN sleep THEN 'sleep_diary' ELSE 'other' END AS kind FROM flags)"""


@query("table_roles", "S4", f"WITH {_ROLE_SQL} SELECT path, kind FROM role")
def table_roles(spark, d):
    return header_tables(spark, d).select("path", hd.table_role(F.col("cols")).alias("kind"))


@query(
    "paths_by_role",
    "S5",
    f"WITH {_ROLE_SQL} SELECT kind, path, row_number() OVER (PARTITION BY kind ORDER BY day, lower(path), path) - 1 AS pos FROM (SELECT kind, role.path, day FROM role JOIN hdr USING (path))",
)
def paths_by_role(spark, d):
    t = header_tables(spark, d).select(hd.table_role(F.col("cols")).alias("kind"), "path", "day")
    # a role may hold most tables: positions come from per-day blocks, not from one list per role
    order = [F.col("day"), F.lower("path"), F.col("path")]
    return row_index(t, ["kind"], F.unix_date("day").cast("bigint"), order, "pos").select("kind", "path", "pos")


@query(
    "inventory_report",
    "S20",
    f"WITH {_ROLE_SQL} SELECT kind, replace(path, 'root/', '') AS rel_path, len(cols) AS n_cols, array_to_string(cols[1:18], ', ') AS columns FROM role",
)
def inventory_report(spark, d):
    c = F.col("cols")
    return header_tables(spark, d).select(
        hd.table_role(c).alias("kind"),
        F.regexp_replace("path", "^root/", "").alias("rel_path"),
        F.size(c).cast("bigint").alias("n_cols"),
        F.array_join(F.slice(c, 1, 18), ", ").alias("columns"),
    )


@query(
    "wide_layout",
    "P19",
    """WITH h AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['deviceId', 'gad7_1', 'GAD7_2', 'GAD7_F'] WHEN 1 THEN ['GAD7_1', 'GAD7_2', 'gad7_f'] ELSE ['deviceId', 'gad7_1'] END AS cols FROM customer)
    SELECT c_custkey AS id, c_custkey % 3 < 2 AS is_wide, c_custkey % 3 = 0 AS is_wide_with_device FROM h""",
)
def wide_layout(spark, d):
    u = F.pmod("c_custkey", F.lit(3))
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    cols = (
        F.when(u == 0, arr("deviceId", "gad7_1", "GAD7_2", "GAD7_F"))
        .when(u == 1, arr("GAD7_1", "GAD7_2", "gad7_f"))
        .otherwise(arr("deviceId", "gad7_1"))
    )
    t = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), cols.alias("cols"))
    return t.select("id", hd.is_wide_survey(F.col("cols")).alias("is_wide"), hd.is_wide_survey(F.col("cols"), True).alias("is_wide_with_device"))


# ---------------------------------------------------------------- unions, sets, coercion


@query(
    "role_concat",
    "S6 U1",
    """SELECT kind, count(*) AS n, round(sum(value), 4) AS value_sum, count(k) AS with_k FROM (
      SELECT event_type AS kind, value, NULL AS k FROM events WHERE event_type = 'view' UNION ALL
      SELECT event_type, NULL, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'click' UNION ALL
      SELECT event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'error') GROUP BY kind""",
)
def role_concat(spark, d):
    ev = src.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    kind = F.col("event_type").alias("kind")
    frames = [
        ev.where("event_type = 'view'").select(kind, "value"),
        ev.where("event_type = 'click'").select(kind, k),
        ev.where("event_type = 'error'").select(kind, "value", k),
    ]
    all_rows = frames[0]
    for f in frames[1:]:
        all_rows = all_rows.unionByName(f, allowMissingColumns=True)
    return all_rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value_sum"), F.count("k").alias("with_k")
    )


@query(
    "column_set_difference",
    "U2",
    """SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(trim(text, ' ')), '\\s+'), lambda w: w NOT IN ('the', 'a', 'of', 'and', 'in', 'de', 'la', '')))) AS n_words FROM documents""",
)
def column_set_difference(spark, d):
    words = F.split(F.lower(F.trim("text")), r"\s+")
    stop = F.array(*[F.lit(w) for w in ("the", "a", "of", "and", "in", "de", "la", "")])
    return src.table(spark, d, "documents").select("doc_id", F.size(F.array_except(words, stop)).cast("bigint").alias("n_words"))


@query(
    "ordered_distinct",
    "U3",
    """SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: list_position(w, x))), lambda i: w[i]), ' ') AS words
    FROM (SELECT conv_id, turn, string_split_regex(lower(trim(text, ' ')), '\\s+') AS w FROM conversations)""",
)
def ordered_distinct(spark, d):
    w = F.split(F.lower(F.trim("text")), r"\s+")
    return src.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(w), " ").alias("words"))


@query(
    "item_total",
    "P5",
    "SELECT event_id, " + " + ".join(f"CASE WHEN (k + {j}) % 29 <> 0 THEN (k + {j}) % 4 END" for j in range(7))
    + " AS total FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
)
def item_total(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    items = [F.when(F.pmod(k + j, F.lit(29)) != 0, F.pmod(k + j, F.lit(4))).alias(f"gad{j + 1}") for j in range(7)]
    return src.table(spark, d, "events").select("event_id", *items).select("event_id", sc.row_total([f"gad{j + 1}" for j in range(7)]).alias("total"))


@query(
    "number_coercion",
    "P6",
    """SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN CAST(k AS VARCHAR) || '.5' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE '-' || CAST(k AS VARCHAR) END AS DOUBLE) AS v
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def number_coercion(spark, d):
    k = F.get_json_object("props", "$.k")
    i = F.pmod("event_id", F.lit(4))
    raw = F.when(i == 0, F.concat(k, F.lit(".5"))).when(i == 1, "n/a").when(i == 2, "").otherwise(F.concat(F.lit("-"), k))
    return src.table(spark, d, "events").select("event_id", sc.to_number(raw).alias("v"))


@query(
    "datetime_parsing",
    "P7 X26",
    """WITH t AS (SELECT event_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) WHEN event_type = 'error' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events),
    m AS (SELECT event_type, median(TRY_CAST(raw AS DOUBLE)) > 1e11 AS is_ms FROM t GROUP BY event_type)
    SELECT event_id, CASE WHEN is_ms THEN CAST(raw AS BIGINT) ELSE epoch_ms(TRY_CAST(raw AS TIMESTAMP)) END AS ms FROM t JOIN m USING (event_type)""",
)
def datetime_parsing(spark, d):
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    raw = (
        F.when(kind.isin("view", "click"), F.unix_millis(ts).cast("string"))
        .when(kind == "error", "soon")
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    t = src.table(spark, d, "events").select("event_id", "event_type", raw.alias("raw")).withColumn("num", sc.to_number("raw"))
    mid = exact_quantiles(t, ["event_type"], "num", {"mid": 0.5})
    every = t.select("event_type").distinct().join(mid, "event_type", "left")  # one row per column
    out = join_per_key(t, every, ["event_type"], "event_id")
    when = F.when(F.col("mid") > 1e11, sc.from_epoch_ms(F.col("num"))).otherwise(F.try_to_timestamp("raw"))
    return out.select("event_id", F.unix_millis(when).alias("ms"))


@query("numeric_columns", "P8 P18", "SELECT l_suppkey AS subject, count(*) AS n, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY 1")
def numeric_columns(spark, d):
    t = src.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("subject"), "l_returnflag", "l_quantity", "l_tax", F.col("l_discount").alias("lf"), F.col("l_tax").alias("gad_total")
    )
    cols = wave_ops.numeric_features(t, ["subject"])
    return t.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 2 if c == "l_quantity" else 4).alias(c) for c in cols])


@query(
    "standardized_segments",
    "P10",
    "SELECT CAST(user_id AS VARCHAR) AS subject, epoch_us(ts) AS seg_us, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type <> 'signup'",
)
def standardized_segments(spark, d):
    t = src.table(spark, d, "events").withColumn("when", F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp")))
    return (
        t.select(F.col("user_id").cast("string").alias("subject"), F.col("when").alias("seg_time"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
        .na.drop(subset=["seg_time"])
        .select("subject", F.unix_micros("seg_time").alias("seg_us"), "value", "k")
    )


@query("column_or_zero", "P11", "SELECT l_suppkey AS subject, round(sum(l_tax), 4) AS acc_z, 0.0::DOUBLE AS gyr_x, count(*) AS n FROM lineitem GROUP BY 1")
def column_or_zero(spark, d):
    t = src.samples(spark, d)

    def channel(name):
        return F.col(name) if name in t.columns else F.lit(0.0)

    return t.groupBy("subject").agg(
        F.round(F.sum(channel("acc_z")), 4).alias("acc_z"), F.round(F.sum(channel("gyr_x")), 4).alias("gyr_x"), F.count(F.lit(1)).alias("n")
    )


# Stage names to codes; 5 is dropped later.
STAGE_CODES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "R": 4, "P": 5}


def stage_code(c):
    m = F.create_map(*[F.lit(x) for kv in STAGE_CODES.items() for x in kv])
    return F.coalesce(m[c], F.lit(5))


@query(
    "label_recode",
    "P12 P22",
    """SELECT code, CASE WHEN code > 0 THEN 1 ELSE 0 END AS two_class, count(*) AS n FROM (
      SELECT CASE l_returnflag || l_linestatus WHEN 'AF' THEN 0 WHEN 'AO' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 ELSE 5 END AS code FROM lineitem)
    WHERE code <> 5 GROUP BY 1, 2""",
)
def label_recode(spark, d):
    t = src.samples(spark, d).select(stage_code(F.col("stage_name")).alias("code")).where("code <> 5")
    two = F.when(F.col("code") > 0, 1).otherwise(0)
    return t.groupBy("code", two.alias("two_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "median_impute_and_clip",
    "P14",
    f"""WITH {SEGMENTS_SQL}, x AS (SELECT subject, event_id, CASE WHEN rmssd > 95 THEN 'inf'::DOUBLE ELSE rmssd * 3e6 END AS v FROM seg),
    f AS (SELECT *, CASE WHEN isinf(v) THEN NULL ELSE v END AS w FROM x), m AS (SELECT median(w) AS med FROM f)
    SELECT event_id, least(greatest(coalesce(w, med, 0), -1e8), 1e8) AS v FROM f, m""",
)
def median_impute_and_clip(spark, d):
    v = F.when(F.col("rmssd") > 95, F.lit(float("inf"))).otherwise(F.col("rmssd") * 3e6)
    t = src.segments(spark, d).select("event_id", sc.finite_or_null(v).alias("w"))
    med = exact_quantiles(t, [], "w", {"med": 0.5}).agg(F.max("med").alias("med"))
    joined = with_scalars(t, med)
    return joined.select("event_id", sc.clamp(F.coalesce("w", "med", F.lit(0.0)), -1e8, 1e8).alias("v"))


@query(
    "nan_to_zero",
    "P15 X32",
    "SELECT event_id, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE round(value / k / 1.37, 6) END AS ratio, CASE WHEN k % 7 = 0 THEN 0.0::DOUBLE ELSE value END AS v FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
)
def nan_to_zero(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    v = F.when(F.pmod(k, F.lit(14.0)) == 0, F.lit(float("nan"))).when(F.pmod(k, F.lit(7.0)) == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return src.table(spark, d, "events").select("event_id", F.round(sc.safe_ratio(F.col("value"), k) / 1.37, 6).alias("ratio"), sc.nan_to_zero(v).alias("v"))


@query(
    "manifest_projection",
    "P16 X37",
    "SELECT event_id, value AS hr_mean, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS sleep_waso_mean FROM events",
)
def manifest_projection(spark, d):
    payload = F.create_map(F.lit("hr_mean"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    t = src.table(spark, d, "events").select("event_id", payload.alias("features"))
    return t.select("event_id", *[F.try_element_at("features", F.lit(n)).alias(n) for n in ("hr_mean", "k", "sleep_waso_mean")])


@query(
    "variant_projection",
    "P17",
    f"WITH {PERSON_WAVE_SQL} SELECT * EXCLUDE (subject, gad7, {', '.join('sleep_' + m.replace('@', '_') + '_' + s for m in src.DIARY_MEASURES for s in ('mean', 'std'))}), subject, gad7 FROM pw",
)
def variant_projection(spark, d):
    t = person_waves(spark, d)
    return rounded(t.select(*[c for c in t.columns if not c.startswith("sleep_")]))


# ---------------------------------------------------------------- filters


@query("scored_rows", "F2", "SELECT l_suppkey AS subject, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O') GROUP BY 1")
def scored_rows(spark, d):
    return src.samples(spark, d).where(stage_code(F.col("stage_name")) != 5).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("plausible_intervals", "F3", "SELECT l_suppkey AS subject, count(*) AS n FROM lineitem WHERE l_discount * 40 > 0.05 AND l_discount * 40 < 3.0 GROUP BY 1")
def plausible_intervals(spark, d):
    t = src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.col("l_discount") * 40).alias("ibi"))
    return t.where((F.col("ibi") > 0.05) & (F.col("ibi") < 3.0)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("chat_roles_only", "F4", "SELECT conv_id, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def chat_roles_only(spark, d):
    return src.table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("valid_score_pairs", "F5", f"WITH {src.PREDICTIONS_SQL} SELECT fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM pred WHERE s1 IS NOT NULL GROUP BY fold")
def valid_score_pairs(spark, d):
    p = src.predictions(spark, d).na.drop(subset=["y", "s1"])
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


@query(
    "minimum_support",
    "F7",
    """SELECT o_custkey AS subject, count(*) AS n, CASE WHEN count(*) < 10 OR count(DISTINCT o_orderstatus) < 3 THEN 0.5 ELSE round(avg(o_totalprice) / 1370.7, 6) END AS score FROM orders GROUP BY 1""",
)
def minimum_support(spark, d):
    n, kinds = F.count(F.lit(1)), F.count_distinct("o_orderstatus")
    return src.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        n.alias("n"), F.when((n < 10) | (kinds < 3), F.lit(0.5)).otherwise(F.round(F.avg("o_totalprice") / 1370.7, 6)).alias("score")
    )


@query(
    "sorted_questionnaires",
    "T1",
    f"""WITH {SURVEY_SQL} SELECT subject, file_order, gad7_1, row_number() OVER (PARTITION BY subject ORDER BY gad7_1 NULLS LAST, file_order) AS pos FROM survey""",
)
def sorted_questionnaires(spark, d):
    # a subject has at most one row per survey edition, so the window is bounded
    w = Window.partitionBy("subject").orderBy(F.col("gad7_1").asc_nulls_last(), "file_order")
    return src.survey(spark, d).select("subject", "file_order", "gad7_1", F.row_number().over(w).cast("bigint").alias("pos"))
