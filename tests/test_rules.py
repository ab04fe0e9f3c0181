"""Hand-computed values for the wave, night, text and metric rules."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vitalgrid.functions import headers as hd
from vitalgrid.functions import scalar as sc
from vitalgrid.functions import text as tx
from vitalgrid.operators import conversation as cv
from vitalgrid.operators import epochs as ep
from vitalgrid.operators import evaluation as ev
from vitalgrid.operators import retrieval as rt
from vitalgrid.operators import selection as sel
from vitalgrid.operators import textops
from vitalgrid.operators import waves as wv
from vitalgrid.operators.ordering import time_bucket

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)
US = dt.timedelta(microseconds=1)
D14 = dt.timedelta(days=14)


def text_value(spark, s, fn):
    return spark.createDataFrame([(s,)], "t string").select(fn("t").alias("x")).first()["x"]


def stats(spark, values):
    rows = [(1, T0 + dt.timedelta(minutes=5 * i), i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "subject int, seg_time timestamp, event_id int, hr double")
    return wv.rich_stats(df, ["subject"], ["hr"], time_bucket("seg_time"), ["seg_time", "event_id"]).first()


def test_rich_statistics_values(spark):
    r = stats(spark, [1.0, 2.0, None, 3.0, 4.0, 5.0, 9.0])
    assert r["hr_count"] == 6 and r["hr_median"] == 3.5
    assert r["hr_iqr"] == pytest.approx(4.75 - 2.25)
    assert r["hr_std"] == pytest.approx(2.581989, abs=1e-6)
    assert r["hr_slope"] == pytest.approx(1.428571, abs=1e-6)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_rich_statistics_edges(spark, n):
    r = stats(spark, [4.0, 6.0][:n] + [None] * (3 - n))
    assert r["hr_slope"] is None
    assert r["hr_count"] == (n or None)
    assert r["hr_std"] == {0: None, 1: 0.0, 2: 1.0}[n]


def test_wave_bounds(spark):
    ts = [T0, T0 + D14 - US, T0 + D14, T0 + 2 * D14]
    df = spark.createDataFrame([(1, t) for t in ts], "subject int, seg_time timestamp")
    got = [r["wave"] for r in wv.assign_waves(df).orderBy("seg_time").collect()]
    assert got == [1, 1, 2, 3]


def test_day_and_night_hours(spark):
    rows = [(dt.datetime(2024, 1, 1, h), float(h)) for h in (7, 8, 19, 20)]
    df = spark.createDataFrame(rows, "seg_time timestamp, hr double")
    r = df.agg(*wv.day_night_stats("hr")).first()
    assert (r["hr_day_mean"], r["hr_night_mean"], r["hr_day_minus_night_mean"]) == (13.5, 13.5, 0.0)
    one = df.where("hr = 8").agg(*wv.day_night_stats("hr")).first()
    assert one["hr_day_std"] is None and one["hr_day_minus_night_mean"] is None


def test_look_back_is_half_open(spark):
    q = dt.datetime(2024, 3, 3)
    segs = [(1, q - D14), (1, q - D14 - US), (1, q), (1, q - US), (2, q - US)]
    s = spark.createDataFrame(segs, "subject int, seg_time timestamp")
    quest = spark.createDataFrame([(1, q, 4.0), (1, q + dt.timedelta(days=3), 5.0)], "subject int, q_time timestamp, gad7 double")
    got = sorted((r["seg_time"], r["gad7"]) for r in wv.look_back_join(s, quest).collect())
    assert got == [(q - D14, 4.0), (q - US, 4.0), (q - US, 5.0), (q, 5.0)]


def test_first_edition_follows_ingest_order(spark):
    df = spark.createDataFrame([(1, 1, 9.0), (1, 0, None), (2, 0, 3.0)], "subject int, file_order int, gad7_1 double")
    assert {r["subject"]: r["gad7_1"] for r in wv.first_edition(df).collect()} == {1: None, 2: 3.0}


def test_person_rollup_uses_the_first_wave(spark):
    rows = [(1, 2, 6.0, 10.0, 30.0), (1, 1, 3.0, 20.0, None)]
    df = spark.createDataFrame(rows, "subject int, wave int, gad7 double, hr_mean double, demo_age double")
    r = wv.person_table(df).first()
    assert r["demo_age"] is None and r["gad7"] == 4.5 and r["person_hr_mean_std"] == 5.0
    assert (r["binary_any_wave_ge5"], r["person_n_waves"]) == (1, 2)
    assert wv.person_table(df, "max").first()["gad7"] == 6.0


def night(spark, stages, col="sleep"):
    return spark.createDataFrame([(1, i, s) for i, s in enumerate(stages)], f"subject int, epoch_no bigint, {col} int")


@pytest.mark.parametrize(
    "preds, want",
    [([0, 0, 1, 1, 0, 1, 0], (1.5, 1.0, 0.5, 42.9)), ([0, 0, 0, 0], (0.0, 2.0, 0.0, 0.0)), ([1], (0.5, 0.0, 0.0, 100.0))],
)
def test_sleep_biomarkers(spark, preds, want):
    r = ep.sleep_biomarkers(night(spark, preds)).first()
    assert (r["tst_minutes"], r["sol_minutes"], r["waso_minutes"], r["sleep_efficiency_pct"]) == want


@pytest.mark.parametrize("preds, want", [([1, 1, 1, 1], [1, 1, 1, 1]), ([1, 1, 1], [0, 0, 0])])
def test_median_of_seven_pads_with_zeros(spark, preds, want):
    got = ep.median_smooth(night(spark, preds, "pred"), "pred", "epoch_no").orderBy("epoch_no").collect()
    assert [r["smoothed"] for r in got] == want


@pytest.mark.parametrize("values, want", [([1, 3, 6], [2, 2, 3]), ([5], [0])])
def test_deltas(spark, values, want):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "subject int, epoch_idx bigint, a double")
    assert [r["Delta_a"] for r in ep.deltas(df, ["a"]).orderBy("epoch_idx").collect()] == want


def test_epoching_drops_the_partial_tail(spark):
    df = spark.createDataFrame([(1, i, 2) for i in range(65)], "subject int, t int, s int")
    e = ep.segment(df, F.floor(F.col("t") / 10).cast("bigint"), [F.col("t")], F.col("s"))
    assert e.count() == 60 and {r["epoch_idx"] for r in e.select("epoch_idx").distinct().collect()} == {0, 1}
    gone = df.withColumn("s", F.when(F.col("t") == 30, 5).otherwise(F.col("s")))
    assert ep.segment(gone, F.floor(F.col("t") / 10).cast("bigint"), [F.col("t")], F.col("s")).count() == 30


def test_rank_fusion(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, p int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q int, p int, rank int")
    got = rt.fuse(v, b, "q", "p").orderBy("rank").collect()
    assert [r["p"] for r in got] == [11, 10, 12]
    assert [r["score"] for r in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62])


def test_hybrid_without_vector_hits_keeps_k(spark):
    v = spark.createDataFrame([], "q int, p int, rank int")
    b = spark.createDataFrame([(1, i, i) for i in range(1, 10)], "q int, p int, rank int")
    assert rt.hybrid(v, b, "q", "p", 6).count() == 6


@pytest.mark.parametrize(
    "text, want",
    [("f32.1 has 12 and 123 x", ["f32.1", "has", "and", "123"]), ("a 1", [""]), ("The THE", ["the", "the"])],
)
def test_search_tokens(spark, text, want):
    assert text_value(spark, text, tx.search_tokens) == want


def test_word_tokens(spark):
    assert text_value(spark, "Hi, (you)! it's", tx.word_tokens) == ["hi", ",", "(", "you", ")", "!", "it", "'", "s"]


def test_heuristic_score(spark):
    df = spark.createDataFrame([("I hear you... how are you?",)], "t string")
    f = tx.response_features("t")
    assert df.select(tx.heuristic_score(f).alias("s")).first()["s"] == 0.7


@pytest.mark.parametrize(
    "text, want",
    [
        (".", "New Conversation"),
        ("What is the difference between bipolar and anxiety", "Bipolar Anxiety"),
        ("my ADHD makes concentration hard, ADHD", "ADHD".capitalize() + " Concentration Makes"),
        ("work work sleepless", "Sleepless Work"),
    ],
)
def test_keyword_title(spark, text, want):
    assert text_value(spark, text, tx.keyword_title) == want


@pytest.mark.parametrize("text, want", [("ok؟ ", True), ("ok.", False), ("why?\n", True)])
def test_question_end(spark, text, want):
    assert text_value(spark, text, tx.ends_with_question) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("I'm sorry to hear that. What now?", "What now?"),
        ("I'm sorry to hear that.", "I'm sorry to hear that."),
        ("I can only imagine", "I can only imagine"),
        ("Well. I hear you", "Well. I hear you"),
    ],
)
def test_opener_strip(spark, text, want):
    assert text_value(spark, text, tx.strip_opener) == want


@pytest.mark.parametrize(
    "text, prior, want",
    [
        ("ok", 0, True),
        ("Thank you!", 0, True),
        ("i feel great but sad", 0, True),
        ("so sad", 4, False),
        ("tell me", 5, False),
        ("the red one please", 2, True),
        ("the red one please", 1, False),
        ("really?", 3, False),
    ],
)
def test_conversational_rule(spark, text, prior, want):
    assert text_value(spark, text, lambda c: tx.is_conversational(c, F.lit(prior))) is want


@pytest.mark.parametrize(
    "text, want", [("Actually", True), ("actually, no", True), ("actuallyno", False), ("so, by the way, x", True), ("hi", False)]
)
def test_topic_shift(spark, text, want):
    assert text_value(spark, text, tx.is_topic_shift) is want


@pytest.mark.parametrize("text, want", [(" —", True), (".", True), ("a", True), ("ab", False), ("", True)])
def test_trivial(spark, text, want):
    assert text_value(spark, text, tx.is_trivial) is want


def test_phrase_matches(spark):
    from vitalgrid.functions import phrases as ph

    got = text_value(spark, "I WANT to die, no reason to live. مش قادر أكمل", lambda c: tx.matched_phrases(c, ph.CRISIS_PHRASES))
    assert got == ["want to die", "no reason to live", "مش قادر أكمل"]
    assert text_value(spark, "what's the point", tx.is_soft_signal) is True
    assert text_value(spark, "want to die", tx.is_soft_signal) is False


def test_arabic_language_and_closing(spark):
    assert text_value(spark, "مرحبا", tx.language) == "ar"
    out = text_value(spark, "تمام", lambda c: tx.ensure_question(c, F.lit("emotional"), F.lit("ar"), F.lit(1)))
    assert out.startswith("تمام\n\n") and out.endswith("؟")


def test_output_cleaning(spark):
    raw = "Prompt:\nx\nOutput:\n Assistant: hello <|eot_id|> more"
    assert text_value(spark, raw, tx.clean_output) == "hello"
    assert text_value(spark, '{"choices": [{"message": {"content": " hi "}}]}', tx.payload_text) == "hi"
    assert text_value(spark, '{"output": "", "text": "yo"}', tx.payload_text) == "yo"


@pytest.mark.parametrize(
    "raw, want",
    [
        ('```json\n{"empathy": 5, "naturalness": 4, "helpfulness": 9, "safety": 5}\n```', 0.95),
        ('{"empathy": 3}', 0.6),
        ("nonsense", -1.0),
        ('{"empathy": "x"}', -1.0),
    ],
)
def test_judge(spark, raw, want):
    assert text_value(spark, raw, lambda c: tx.judge_scores(c)["llm_quality"]) == want


def test_template_inserts_are_not_reread(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(tx.fill_template("<{a}|{b}>", a=F.col("a"), b=F.col("b")).alias("x")).first()["x"] == "<{b}|x>"


def test_masking_keeps_one_token(spark):
    df = spark.createDataFrame([(i, [5, 6, 7, 0, 0]) for i in range(200)], "k bigint, ids array<bigint>")
    got = df.select(tx.mask_tokens(F.col("ids"), F.col("k"), 100).alias("m")).collect()
    assert all(sum(t != 0 for t in r["m"]) == 1 for r in got)


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, "b a b c"), (2, "a d")], "id int, t string")
    v = cv.vocabulary(df, "t", 2)
    assert [(r["token"], r["id"]) for r in v.orderBy("id").collect()] == [("a", 4), ("b", 5)]
    enc = {r["id"]: r["ids"] for r in cv.encode(df, ["id"], "t", v, 3).collect()}
    assert enc == {1: [5, 4, 5], 2: [4, 1]}


def test_vocabulary_order_beyond_exact_counts(spark):
    rows = [("x " * 70_000,), ("y " * 70_100,), ("w z " * 3,)]
    v = cv.vocabulary(spark.createDataFrame(rows, "t string"), "t", 2)
    assert [r["token"] for r in v.orderBy("id").collect()] == ["y", "x", "w", "z"]


# ------------------------------------------------------------ metrics


def preds(spark, y, s):
    return spark.createDataFrame(list(zip(y, s)), "y int, s double")


def test_auc_with_ties(spark):
    r = ev.auc(preds(spark, [0, 1, 0, 1], [0.1, 0.4, 0.4, 0.8]), "y", "s").first()
    assert r["auc"] == 0.875
    assert ev.auc(preds(spark, [1, 1], [0.1, 0.4]), "y", "s").first()["auc"] is None


def test_youden_single_class_and_ties(spark):
    one = ev.youden(preds(spark, [1, 1], [0.2, 0.3]), "y", "s").first()
    assert (one["threshold"], one["j"]) == (0.5, 0.0)
    r = ev.youden(preds(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), "y", "s").first()
    assert (r["threshold"], r["j"]) == (0.9, 0.5)
    worse = ev.youden(preds(spark, [0, 1], [0.9, 0.1]), "y", "s").first()
    assert (worse["threshold"], worse["j"]) == (0.5, 0.0)


def test_platt_clip(spark):
    got = spark.range(1).select(sc.sigmoid(F.lit(1e6)).alias("x")).first()["x"]
    assert got == pytest.approx(1 / (1 + 2.718281828459045**-30), abs=1e-15)


def test_mann_whitney_constant_feature(spark):
    rows = [("c", 1.0, i % 2) for i in range(8)] + [("v", float(i), int(i > 3)) for i in range(8)]
    df = spark.createDataFrame(rows, "feature string, v double, y int")
    got = {r["feature"]: (r["u"], r["p_value"]) for r in ev.mann_whitney(df, "feature", "v", "y").collect()}
    assert got["c"] == (8.0, 1.0)
    assert got["v"][0] == 16.0 and got["v"][1] == pytest.approx(0.0303826, abs=1e-5)


def test_spearman_and_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, None)], "a double, b double")
    assert ev.spearman(df, "a", "b").first()["spearman"] == pytest.approx(0.6)
    assert ev.regression_errors(df, "a", "b").first()["n"] == 4


def test_agreement(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    r = ev.agreement(ev.class_counts(df, "y", "p")).first()
    assert r["accuracy"] == 0.5 and r["balanced_accuracy"] == pytest.approx(0.5) and r["kappa"] == pytest.approx(0.1875 / 0.6875)


# ------------------------------------------------------------ headers, keys, folds


@pytest.mark.parametrize(
    "cols, subject, time, score, role",
    [
        (["Device ID", "ts time", "sdnn"], "Device ID", "ts time", None, "hrv"),
        (["x", "User name", "GAD7 total", "rmssd"], "User name", None, "GAD7 total", "mixed"),
        (["item user", "gad_1", "date"], None, "date", None, "questionnaire"),
        (["WASO", "bedtime"], None, "bedtime", None, "sleep_diary"),
        (["a", "id"], "id", None, None, "other"),
    ],
)
def test_header_rules(spark, cols, subject, time, score, role):
    df = spark.createDataFrame([Row(cols=cols)], "cols array<string>")
    c = F.col("cols")
    r = df.select(
        hd.subject_column(c).alias("s"), hd.time_column(c, c).alias("t"), hd.score_column(c).alias("g"), hd.table_role(c).alias("k")
    ).first()
    assert (r["s"], r["t"], r["g"], r["k"]) == (subject, time, score, role)


def test_new_by_message_keeps_the_first(spark):
    fresh = spark.createDataFrame([(2, " Hi "), (1, "hi"), (3, "New"), (4, "old")], "n int, message string")
    old = spark.createDataFrame([("OLD ",)], "message string")
    got = sorted((r["n"], r["message"]) for r in textops.new_by_message(fresh, old, ["n"]).collect())
    assert got == [(1, "hi"), (3, "New")]


def test_folds_are_balanced_and_disjoint(spark):
    rows = [(g,) for g in range(20) for _ in range(1 + g % 7)] + [(99,)] * 40
    df = spark.createDataFrame(rows, "g bigint")
    greedy = sel.folds_greedy(df, "g", 4).toPandas()
    assert len(greedy) == 21
    load = greedy.groupby("fold")["n"].sum()
    assert load.max() == 40 and load.drop(load.idxmax()).max() - load.drop(load.idxmax()).min() <= 2
    assert sel.folds_by_size(df, "g", 4).groupBy("fold").count().count() == 4


def test_correlation_prune_drops_the_later_on_ties(spark):
    df = spark.createDataFrame([(float(i), float(i), float(-i % 5), float(i)) for i in range(30)], "a double, b double, c double, t double")
    assert sel.correlation_kept(df, ["a", "b", "c"], "t") == ["a", "c"]


def test_many_columns_use_one_matrix(spark):
    n = 42
    df = spark.range(50).select(*[(F.pmod(F.col("id") * (i + 3), F.lit(17 + i)) * 1.0).alias(f"c{i}") for i in range(n)])
    cols = [f"c{i}" for i in range(n)]
    wide = {(r["a"], r["b"]): r["r"] for r in sel.correlations(df, cols).collect()}
    few = {(r["a"], r["b"]): r["r"] for r in sel.correlations(df, cols[:5]).collect()}
    assert len(wide) == n * (n - 1) // 2
    assert all(wide[k] == pytest.approx(v, abs=1e-9) for k, v in few.items())
