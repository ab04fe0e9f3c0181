"""Files, retrieval paths, streams and models on small fixtures."""

import datetime as dt
import math
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import models as md
from vitalgrid.operators import retrieval as rt
from vitalgrid.plans import streams
from vitalgrid.plans.waves import rounded
from vitalgrid.sources import files, store
from vitalgrid.streaming import jobs, state

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="vitalgrid-test-")


def test_preferred_source_falls_back(spark, folder):
    files.write_csv(spark.range(3), f"{folder}/raw.csv")
    assert files.preferred_source(spark, folder, ("filtered.csv", "raw.csv")).endswith("raw.csv")
    with pytest.raises(FileNotFoundError):
        files.preferred_source(spark, folder, ("none.csv",))


def test_recording_format_prefers_the_export(spark, folder):
    assert files.recording_format(spark, folder) is None
    open(f"{folder}/S001_whole_df.csv", "w").write("BVP\n1\n")
    assert files.recording_format(spark, folder) == ("S00*_whole_df.csv", 64)
    open(f"{folder}/S9_PSG_df_updated.csv", "w").write("BVP,Sleep_Stage\n1,W\n")
    assert files.recording_format(spark, folder)[1] == 100


def test_inventory_skips_lock_files(spark, folder):
    open(f"{folder}/a.csv", "w").write("deviceId,GAD7_1\n1,2\n")
    open(f"{folder}/~$a.csv", "w").write("x\n")
    got = files.header_inventory(spark, folder).collect()
    assert [r["cols"] for r in got] == [["deviceId", "GAD7_1"]]


def test_csv_bad_cells_become_null(spark, folder):
    open(f"{folder}/a.csv", "w").write("a,b\n1,x\n2,3.5\n")
    got = files.read_csv(spark, folder, "a int, b double").orderBy("a").collect()
    assert [r["b"] for r in got] == [None, 3.5]


def test_cache_rebuilds_when_the_source_changes(spark, folder):
    build = lambda: spark.range(5)
    flags = [files.cached_table(spark, f"{folder}/c", s, build, n)[1] for s, n in (("a", 1), ("a", 1), ("b", 1), ("b", 2), ("b", 2))]
    assert flags == [False, True, False, False, True]


def test_readers_see_the_old_or_the_new_version(spark, folder):
    keeper = store.Store(spark, f"{folder}/s", keep=2)
    with pytest.raises(FileNotFoundError):
        keeper.read()
    assert keeper.replace(spark.range(5), {"a": 1}) == 1
    pinned, seen = keeper.read(), []

    def slow(rows):  # a reader in the middle of a rebuild
        seen.append(sorted(r.id for r in store.Store(spark, f"{folder}/s").read().collect()))
        return rows

    keeper.replace(slow(spark.range(100, 103)))
    assert seen == [[0, 1, 2, 3, 4]] and pinned.count() == 5
    assert sorted(r.id for r in keeper.read().collect()) == [100, 101, 102]
    keeper.append(spark.range(3))
    assert keeper.read().count() == 6 and keeper.versions() == [2, 3] and keeper.manifest(3)["notes"] == {}
    import os

    assert len(os.listdir(f"{folder}/s/data")) == 2  # the first version's folder went with it


def test_the_second_of_two_writers_fails(spark, folder):
    a, b = store.Store(spark, folder), store.Store(spark, folder)
    a.replace(spark.range(1))
    assert b.append(spark.range(1), seen=1) == 2
    with pytest.raises(store.Conflict):
        a.append(spark.range(1), seen=1)
    real = b.versions
    b.versions = lambda: real()[:1]  # a writer that looked before the other had finished
    with pytest.raises(store.Conflict):
        b.replace(spark.range(9))
    assert store.Store(spark, folder).read().count() == 2


def test_pairs_are_appended_once(spark, folder):
    rows = [(1, 0, "Hello there", "a b"), (1, 1, " hello THERE", "c d"), (2, 0, "new one", "e f")]
    fresh = spark.createDataFrame(rows, "conv_id long, turn long, message string, title string")
    for _ in range(2):
        files.append_new_pairs(spark, f"{folder}/p", fresh, ["conv_id", "turn"])
    assert sorted(r.message for r in files.stored_pairs(spark, f"{folder}/p").collect()) == ["Hello there", "new one"]


def test_recordings_choose_a_format_per_subject(spark, folder):
    texts = {
        "S001_PSG_df_updated.csv": "HR,Sleep_Stage,BVP\n60,W,1.5\nx,N1,bad\n",
        "S001_whole_df.csv": "BVP,Sleep_Stage\n9,W\n",
        "S002_PSG_df_updated.csv": "HR,BVP\n1,2\n",  # no stages: the other layout is taken
        "S002_whole_df.csv": "BVP,Sleep_Stage\n7,R\n",
        "S003_whole_df.csv": "HR\n1\n",  # nothing usable
        "S099_whole_df.csv": "BVP,Sleep_Stage\n1,W\n",  # out of range
        "guest_whole_df.csv": "Sleep_Stage,BVP\nW,4\n",
        "notes.csv": "BVP,Sleep_Stage\n1,W\n",
    }
    for name, text in texts.items():
        open(f"{folder}/{name}", "w").write(text)
    got = sorted(map(str, files.recordings(spark, folder, ["BVP", "HR"], 1, 50).collect()))
    want = [("S001", 100, "W", 1.5, 60.0), ("S001", 100, "N1", None, None), ("S002", 64, "R", 7.0, None), ("guest", 64, "W", 4.0, None)]
    row = lambda x: f"Row(sid={x[0]!r}, rate={x[1]}, Sleep_Stage={x[2]!r}, BVP={x[3]}, HR={x[4]})"
    assert got == sorted(map(row, want))
    assert files.recordings(spark, folder, ["BVP"], 60, 70).where("sid <> 'guest'").count() == 0


def test_feedback_parser(spark):
    long = "x" * 16
    lines = [f"t rating=up a response_preview='{long}' z", f"rating=down response_preview=' {long} '", f"rating=none response_preview='{long}'", "rating=up response_preview='short'", "noise"]
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    assert sorted((r["preview"], r["label"]) for r in files.parse_feedback(df).collect()) == [(long, 0), (long, 1)]


def test_subject_range(spark):
    df = spark.createDataFrame([("S003",), ("S100",), ("guest",)], "sid string")
    assert [r["sid"] for r in df.where(files.in_subject_range(F.col("sid"), 1, 50)).collect()] == ["S003", "guest"]


@pytest.mark.parametrize("metric", ["cosine", "distance"])
@pytest.mark.parametrize("block", [2048, 4])
def test_nearest_equals_brute_force(spark, metric, block):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(11, 8))
    vd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, e array<double>").repartition(5)
    qd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid bigint, e array<double>")
    got = rt.nearest(qd, "qid", "e", vd, "id", "e", 6, metric, block).toPandas()
    for i in range(11):
        s = v @ q[i] / np.linalg.norm(v, axis=1) if metric == "cosine" else -((v - q[i]) ** 2).sum(1)
        want = np.argsort(-s)[:6].tolist()
        assert got[got["qid"] == i].sort_values("rank")["id"].tolist() == want


def bm25_direct(docs, query):
    toks = {k: t.split() for k, t in docs.items()}
    n, avg = len(docs), np.mean([len(t) for t in toks.values()])
    terms = {w for t in toks.values() for w in t}
    df = {w: sum(w in t for t in toks.values()) for w in terms}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = np.mean(list(idf.values()))
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for k, t in toks.items():
        out[k] = sum(
            idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()
        )
    return out


def test_bm25_equals_brute_force_with_hot_terms(spark):
    rng = np.random.default_rng(4)
    vocab = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(40)]
    docs = {i: " ".join(rng.choice(vocab, rng.integers(5, 40))) for i in range(60)}
    query = "the w3 w3 w9 of absent w17"
    df = spark.createDataFrame(list(docs.items()), "d bigint, t string")
    posts = rt.postings(df, "d", "t")
    got = rt.bm25(spark.createDataFrame([(1, query)], "q bigint, t string"), "q", "t", posts, rt.section_lengths(posts, "d"), "d", 12)
    want = sorted(bm25_direct(docs, query).items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:12]
    rows = got.orderBy("rank").collect()
    assert [r["d"] for r in rows] == [k for k, s in want if s > 0]
    assert [r["score"] for r in rows] == pytest.approx([s for _, s in want if s > 0])


def test_bm25_is_exact_in_every_shard_layout(spark, monkeypatch):
    from vitalgrid.operators import maxscore
    from vitalgrid.plans import retrieval as plans

    posts = rt.postings(plans.sections(spark, SF), "doc_id", "text").persist()
    lengths, ask = rt.section_lengths(posts, "doc_id"), plans.questions(spark, SF)
    weights = rt.term_weights(posts, rt.corpus_stats(lengths))
    n, avgdl = rt.corpus_stats(lengths).first()
    lists = maxscore.impacts(posts, lengths, weights, avgdl, "doc_id", rt.K1, rt.B)
    count = ask.select("item_id", F.explode(rt.tx.search_tokens("question")).alias("term")).groupBy("item_id", "term").count()
    direct = {}
    for r in count.join(lists, "term").groupBy("item_id", "doc_id").agg(F.sum(F.col("count") * F.col("impact")).alias("s"), F.count(F.lit(1)).alias("c")).collect():
        direct.setdefault(r["item_id"], []).append((-round(r["s"], 9), r["doc_id"], r["c"]))
    for size in (1 << 16, 50):
        monkeypatch.setattr(maxscore, "SHARD_SECTIONS", size)
        got = rt.bm25(ask, "item_id", "question", posts, lengths, "doc_id", 12).collect()
        for item, want in direct.items():
            rows = sorted((r["rank"], r["doc_id"]) for r in got if r["item_id"] == item)
            assert [d for _, d in rows] == [d for s, d, _ in sorted(want)[:12] if s < 0]


def test_stop_rule_equals_all_lists():
    from vitalgrid.operators.maxscore import Lists

    r = np.random.default_rng(11)
    for trial in range(60):
        sections, impacts = [], []
        for t in range(9):
            keys = np.sort(r.choice(400, size=int(r.integers(1, 380 if t > 5 else 30)), replace=False))
            sections.append(keys * 3)
            impacts.append(np.round(r.random(len(keys)) * (0.2 if t > 5 else 4), 1 if trial % 2 else 6) - (0.3 if trial > 50 else 0))
        lists = Lists([f"t{t}" for t in range(9)], sections, impacts)
        query = [(f"t{t}", float(r.integers(1, 4))) for t in range(0, 10)]
        want = {}
        for (_, w), keys, i in zip(query, sections, impacts):
            for key, x in zip(keys, i):
                want[int(key)] = want.get(int(key), 0.0) + w * x
        best = sorted(((-round(s, 9), d) for d, s in want.items() if s > 0))[:7]
        found, scores, met = lists.best(query, 7)
        assert [int(d) for d in found] == [d for _, d in best]
        assert met <= 2 * sum(map(len, sections))


def test_stop_rule_leaves_long_lists_unread():
    """Frequent words weigh little: with word frequencies as in texts less than half of the postings are met."""
    from vitalgrid.operators.maxscore import Lists

    r, n = np.random.default_rng(3), 20000
    df = np.sort((n * 0.6 / np.arange(1, 41) ** 1.3).astype(int))
    sections = [np.sort(r.choice(n, size=max(5, d), replace=False)) for d in df]
    impacts = [np.log((n - len(x) + 0.5) / (len(x) + 0.5)).clip(0.05) * r.uniform(0.5, 2.2, len(x)) for x in sections]
    lists, total, met = Lists([f"t{t}" for t in range(40)], sections, impacts), 0, 0
    for _ in range(20):
        picked = r.choice(40, 20, replace=False)
        _, _, looked = lists.best([(f"t{t}", 1.0) for t in picked], 10)
        met += looked
        total += sum(len(sections[t]) for t in picked)
    assert met < total / 2, met / total


@pytest.mark.parametrize("metric", ["cosine", "distance"])
def test_pivot_join_equals_brute_force(spark, metric):
    """Clusters, a third of all rows one vector, null vectors, ties at the cut; small shards."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6)) * 8
    v = np.vstack([centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 6)) * 0.3, np.tile(centres[0], (200, 1)), np.zeros((3, 6))])
    v = np.round(v, 3)
    q = np.vstack([v[rng.integers(0, 400, 40)] + rng.normal(size=(40, 6)) * 0.1, np.zeros((1, 6)), centres[:1]])
    vd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "__id bigint, __e array<double>").repartition(5)
    qd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "__q bigint, __v array<double>")
    monkey = rt.pv.PIVOTS
    rt.pv.PIVOTS = 20
    try:
        part = rt._by_pivots(qd, vd, 6, metric, 30).toPandas()
        placed = rt.pv.placed(vd, rt.pv.choose(vd, metric), metric, 30)
        assert placed.groupBy("shard").count().agg(F.max("count")).first()[0] <= 90
        visits = rt.pv.visits(qd, rt.pv.choose(vd, metric), rt.pv.radii(placed), 6, metric).count()
    finally:
        rt.pv.PIVOTS = monkey
    a, b = rt.pv.scaled(q, metric), rt.pv.scaled(v, metric)
    for i in range(len(q)):
        s = b @ a[i] if metric == "cosine" else -((b - a[i]) ** 2).sum(1)
        want = sorted(zip(-s, range(len(v))))[:6]
        got = sorted(zip(-part[part["__q"] == i]["similarity"], part[part["__q"] == i]["__id"]))[:6]
        assert [round(x, 9) for x, _ in got] == [round(x, 9) for x, _ in want]
    shards = placed.select("shard").distinct().count()
    assert shards > 12 and (metric == "cosine" or visits < 0.6 * shards * len(q))


# ------------------------------------------------------------ streams


def seg(minute, subject=1, hr=1.0):
    return (subject, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), hr)


SCHEMA = "subject int, ts timestamp, hr double"


def drain_windows(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    st = jobs.file_stream(spark, f"{folder}/in", SCHEMA)
    jobs.run_available(jobs.feature_windows(st, "subject", "ts", ["hr"]), f"{folder}/out", "update")
    return jobs.latest_per_key(spark, f"{folder}/out", ["subject", "window_start"])


def test_stream_equals_batch_when_in_order(spark, folder):
    batches = [[seg(m, m % 2, float(m)) for m in range(a, a + 9)] for a in (0, 9, 18)]
    got = drain_windows(spark, folder, batches)
    flat = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = jobs.feature_windows(flat, "subject", "ts", ["hr"]).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_behind_the_watermark_drop(spark, folder):
    got = drain_windows(spark, folder, [[seg(0)], [seg(60)], [seg(61)], [seg(1, hr=9.0)]])
    first = got.orderBy("window_start").first()
    assert (first["n"], first["hr_mean"]) == (1, 1.0)


TURNS = "conv_id int, turn int, text string"


def drain_newest(spark, folder, n=10, schema=TURNS, idle=None):
    state.newest_rows(jobs.file_stream(spark, f"{folder}/in", schema, files_per_batch=None), f"{folder}/out", "conv_id", "turn", n, idle)
    return sorted((tuple(r) for r in state.kept_rows(spark, f"{folder}/out").collect()), key=str)


def test_newest_rows_across_restarts(spark, folder):
    """Arrivals out of order, repeated and tied; a restart after each equals the batch result."""
    r, seen = random.Random(7), []
    for step in range(3):
        rows = [(r.randrange(5) if step < 2 else r.randrange(7), r.randrange(40), f"t{r.randrange(3)}") for _ in range(60)]
        rows += [(1, None, "no turn"), (2, 39, None)]
        seen += rows
        spark.createDataFrame(rows, TURNS).repartition(3).write.mode("append").parquet(f"{folder}/in")
        got = drain_newest(spark, folder, 6)
    want = []
    for c in {x[0] for x in seen}:
        own = [x for x in seen if x[0] == c]
        own.sort(key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or ""), reverse=True)
        want += own[:6]
    assert got == sorted(want, key=str) and len(got) > 30


def test_a_conversation_of_a_million_turns_keeps_ten(spark, folder):
    rows = spark.range(1_000_000).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("x").alias("text"))
    rows.unionByName(rows.limit(3).withColumn("conv_id", F.lit(2))).write.parquet(f"{folder}/in")
    got = drain_newest(spark, folder)
    assert sorted(x[:2] for x in got if x[0] == 1) == [(1, 999_990 + i) for i in range(10)] and sum(x[0] == 2 for x in got) == 3


def test_idle_conversations_are_forgotten(spark, folder):
    schema, idle = "conv_id int, turn int, at timestamp", state.Idle("at", 3600)
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    for rows, left in (
        ([(1, 1, at(1)), (2, 1, at(1))], [1, 2]),
        ([(2, 2, at(3)), (3, 1, at(3))], [2, 2, 3]),  # conversation 1 was silent for two hours
        ([(3, 2, at(9)), (1, 9, at(2))], [3, 3]),  # a late row of 1 drops
    ):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        got = [x[0] for x in drain_newest(spark, folder, 10, schema, idle)]
        assert got == left, got


def test_streamed_intervals_equal_the_batch(spark):
    """Rows of the stream, drained in three parts cut inside intervals, next to the same features of whole tables."""
    got = streams.streamed_window_scores(spark, SF)
    samples = streams.interval_samples(spark, SF).withColumn("interval", F.floor(F.col("sample_idx") / streams.INTERVAL))
    whole = samples.join(samples.groupBy("subject", "interval").count().where(F.col("count") == streams.INTERVAL), ["subject", "interval"])
    want = rounded(streams.interval_scores(whole, streams.interval_model(spark, SF))).select(*got.columns)
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (got, want))
    assert got == want and len(got) > 100 and len({r[3] for r in got}) > 1


def test_intervals_wait_for_their_samples(spark, folder):
    """Late, repeated and missing samples: an interval comes once, in order, when it is complete."""
    schema = "subject int, sample_idx long, bvp double"
    out = f"{folder}/out"
    steps = [[(1, i) for i in (0, 1, 3, 7, 6)], [(1, 2), (1, 2), (1, 0), (2, 5)], [(1, 5), (1, 4), (2, 4), (2, 7), (2, 6)]]
    for rows in steps:
        spark.createDataFrame([(s, i, float(i)) for s, i in rows], schema).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.file_stream(spark, f"{folder}/in", schema, files_per_batch=None)
        state.score_intervals(stream, out, "subject", "sample_idx", 4, lambda part: part)
    got = [(r.subject, r.interval, r.sample_idx, r.bvp) for r in state.scored(spark, out).collect()]
    # the repeated sample 0 of a closed interval opens one that never completes
    assert sorted(got) == [(1, 0, i, float(i)) for i in range(4)] + [(1, 1, i, float(i)) for i in range(4, 8)] + [(2, 1, i, float(i)) for i in range(4, 8)]


def test_feedback_log_tail(spark, folder):
    line = "rating=up response_preview='I hear you... how are you feeling now?'"
    spark.createDataFrame([(line,), ("noise",)], "value string").write.text(f"{folder}/in")
    jobs.run_available(jobs.rescored_feedback(jobs.file_stream(spark, f"{folder}/in", "value string", "text")), f"{folder}/out")
    r = spark.read.parquet(f"{folder}/out/data").first()
    assert (r["label"], r["score"]) == (1, 0.7)


# ------------------------------------------------------------ models


def test_oversampling_balances_and_stays_between_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, *map(float, rng.normal(5, 1, 2))) for i in range(40)] + [(100 + i, 1, *map(float, rng.normal(0, 1, 2))) for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, y int, a double, b double")
    out = md.oversample(df, "id", ["a", "b"], "y", 3).toPandas()
    assert (out["y"].value_counts() == 40).all() and out["id"].is_unique
    small = df.where("y = 1").toPandas()
    copies = out[(out["y"] == 1) & out["id"].str.startswith("copy")]
    assert copies["a"].between(small["a"].min(), small["a"].max()).all()


def test_platt_recovers_direction_and_guards(spark):
    df = spark.createDataFrame([(i / 50, int(i > 25)) for i in range(50)], "s double, y int")
    slope, icept = md.platt(df, "s", "y")
    assert slope > 0 and -icept / slope == pytest.approx(0.5, abs=0.05)
    assert md.platt(df.limit(3), "s", "y") == (1.0, 0.0)


def test_text_model_needs_twenty_examples(spark):
    ex = [(f"warm and kind words number {i}", 1) for i in range(12)] + [(f"cold clinical note number {i}", 0) for i in range(12)]
    df = spark.createDataFrame(ex, "preview string, label int")
    assert md.text_preference(df.limit(19)) is None
    p = md.probability(md.text_preference(df).transform(df), "p").groupBy("label").avg("p").toPandas().set_index("label")
    assert p.loc[1, "avg(p)"] > 0.8 > 0.2 > p.loc[0, "avg(p)"]


def test_variant_choice_breaks_ties_by_error(spark):
    rep = spark.createDataFrame([("a", 0.7, 3.0), ("b", 0.7, 2.0), ("c", None, 1.0)], "variant string, auc double, mae double")
    assert md.chosen_variant(rep).first()["variant"] == "b"
