"""What must not grow with the number of keys or partitions."""

import os

from pyspark.sql import functions as F

from vitalgrid.sources import files


def test_a_store_of_many_subjects_has_few_folders(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 2000 - 20).alias("subject"), F.col("id").alias("n"))
    path = str(tmp_path / "store")
    files.write_partitioned(rows, path, "subject", "n", folders=16)
    assert len([f for f in os.listdir(path) if f.startswith("subject=")]) <= 17
    back = spark.read.parquet(path)
    assert {(r.sid, r.n) for r in back.collect()} == {(str(n % 2000 - 20), n) for n in range(4000)}
    few = rows.where("subject between 0 and 9")
    files.write_partitioned(few, f"{path}2", "subject", "n", folders=16)
    assert len([f for f in os.listdir(f"{path}2") if f.startswith("subject=")]) == 10


def test_forest_scores_do_not_depend_on_partitions(spark):
    from vitalgrid.operators import models as md

    v = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    rows = spark.range(400).select(
        F.col("id").alias("row_id"), v.alias("a"), F.rand(3).alias("b"), (v > 0.5).cast("int").alias("y"),
        (F.col("id") % 3).cast("int").alias("fold"), F.lit(1.0).alias("weight"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert md.few_parts(rows.repartition(7), "row_id").select(F.spark_partition_id()).distinct().count() == 1
    draws = {"numTrees": (3,), "maxDepth": (None, 2), "minInstancesPerNode": (1,)}
    scores = [md.forest_search(rows.repartition(n), ["a", "b"], "y", "fold", 3, "weight", "row_id", draws) for n in (1, 7)]
    assert scores[0] == scores[1] and len(scores[0]) == 2 and min(scores[0]) > 0.9


def test_a_batch_is_scored_from_what_was_written_once(spark, tmp_path):
    """The scoring plan reads files, so its branches do not run the state's operator again; intervals are dealt over states."""
    from vitalgrid.streaming import jobs
    from vitalgrid.streaming import state

    schema, read = "subject int, sample_idx long, bvp double", []
    rows = [(1, i, float(i)) for i in range(40) if i % 4 != 3]  # one subject, ten open intervals
    spark.createDataFrame([*rows, (2, 0, 0.0), (2, 1, 1.0), (2, 2, 2.0), (2, 3, 3.0)], schema).write.parquet(f"{tmp_path}/in")

    def score(part):
        read.append(part.inputFiles())
        return part.join(part.groupBy("subject").count(), "subject")

    stream = jobs.file_stream(spark, f"{tmp_path}/in", schema, files_per_batch=None)
    state.score_intervals(stream, f"{tmp_path}/out", "subject", "sample_idx", 4, score)
    assert read and all(read)
    assert sorted(r.sample_idx for r in state.scored(spark, f"{tmp_path}/out").collect()) == [0, 1, 2, 3]
    held = spark.read.format("statestore").option("stateVarName", "samples").load(f"{tmp_path}/out/checkpoint")
    assert held.count() == 30 and held.select("key").distinct().count() > 1


def test_spectrum_makes_no_rows_of_grid_points(spark):
    from vitalgrid.operators import signal as sg

    e = spark.range(30).select(F.lit(1).alias("subject"), F.lit(0).alias("epoch_idx"), F.col("id").cast("int").alias("pos"), (0.5 + F.col("id") / 100).alias("ibi"))
    out = sg.interval_spectrum(e)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1 and sg.interval_spectrum(e.where("pos < 4")).count() == 0


def test_samples_of_a_task_do_not_grow(spark, monkeypatch):
    from vitalgrid.operators import epochs as ep
    from vitalgrid.operators import ordering

    rows = spark.range(1800).select((F.col("id") % 3).alias("subject"), F.col("id").alias("t"), F.lit(1).alias("s"))
    cut = lambda: ep.segment(rows, F.floor(F.col("t") / 100), [F.col("t")], F.col("s")).select("subject", "epoch_idx", "pos", "t")
    whole = sorted(map(tuple, cut().collect()))
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 100)
    parts = cut()
    assert parts.rdd.getNumPartitions() == 18 and sorted(map(tuple, parts.collect())) == whole and len(whole) == 1800


def test_stress_features_read_their_epochs_once(spark):
    from vitalgrid.plans import signals

    e = spark.range(90).select(
        F.lit(1).alias("subject"), F.floor(F.col("id") / 30).alias("epoch_idx"), (F.col("id") % 30).cast("int").alias("pos"),
        F.lit(2).alias("stage"), F.when(F.col("id") < 60, F.sin(F.col("id") * 0.9)).otherwise(1.0).alias("bvp"),
    )
    plan = signals.stress_features(e)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.epoch_idx: r for r in plan.collect()}
    assert len(got) == 3 and got[0].MEAN_RR > 0 and got[0].HR > 0 and got[2].MEAN_RR == 0.0 and got[2].stage == 2


def test_folds_are_fitted_side_by_side(spark):
    """The fits of the folds meet each other, and forests do not depend on how the rows are dealt."""
    import threading

    from vitalgrid.operators import models as md

    v = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    rows = spark.range(300).select(
        F.col("id").alias("row_id"), v.alias("a"), *[F.rand(s).alias(c) for s, c in enumerate("bcdef")], (v > 0.5).cast("int").alias("y"),
        (F.col("id") % 3).cast("int").alias("fold"), F.lit(1.0).alias("weight"),
    )
    rows, cols = spark.createDataFrame(rows.collect(), rows.schema), list("abcdef")
    meet = threading.Barrier(3, timeout=60)

    def fit(train):
        meet.wait()
        return md.Pipeline(stages=[md.assembler(cols), md.forest("y", 2)]).fit(train)

    assert md.out_of_fold(rows, fit, "fold", 3, lambda s: s.select("row_id", "prediction"), "row_id").count() == 300
    imp = [md.importance_by_fold(rows.repartition(n), cols, "y", "fold", 3, "weight", 3, "row_id") for n in (1, 5)]
    kept = [md.eliminate(rows.repartition(n), cols, "y", "fold", 3, "weight", 4, 2, 2, 3, "row_id") for n in (1, 5)]
    assert imp[0] == imp[1] and max(imp[0], key=imp[0].get) == "a" and kept[0] == kept[1] and "a" in kept[0] and len(kept[0]) <= 4


def test_postings_with_lengths_move_texts_only_once(spark):
    from vitalgrid.operators import maxscore
    from vitalgrid.operators import retrieval as rt

    docs = [(1, "red fox red"), (2, None), (3, ""), (4, "12 fox a31.5 fox"), (4, "blue fox"), (5, "red red")]
    docs = spark.createDataFrame(docs, "k long, text string")
    posts, plain = rt.measured_postings(docs, "k", "text"), rt.postings(docs, "k", "text")
    lengths = rt.section_lengths(plain, "k")
    assert posts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, posts.select("k", "term", "tf", "dl").collect())) == sorted(map(tuple, plain.join(lengths, "k").select("k", "term", "tf", "dl").collect()))
    weights = spark.createDataFrame([("fox", 1.0), ("red", 2.0)], "term string, idf double")
    found = [sorted(map(tuple, maxscore.impacts(p, lengths, weights, 2.5, "k", 1.5, 0.75).collect())) for p in (posts, plain)]
    assert found[0] == found[1] and len(found[0]) == 4
    asked = spark.createDataFrame([(9, "red fox")], "q long, qt string")
    best = [sorted(map(tuple, rt.bm25(asked, "q", "qt", p, lengths, "k", 3).collect())) for p in (posts, plain)]
    assert best[0] == best[1]


def test_an_index_is_written_where_its_sections_are_counted(spark, tmp_path, monkeypatch):
    """Only texts move: all postings of a section are in one segment, and a segment is in order of its terms."""
    from vitalgrid.operators import retrieval as rt

    monkeypatch.setattr(rt, "SECTIONS_PER_TASK", 50)
    docs = [(n % 190, f"red fox{n % 7} a31.5 word{n}") for n in range(200)] + [(500, None), (501, "12 7")]
    path = str(tmp_path / "index")
    rt.write_index(rt.postings(spark.createDataFrame(docs, "k long, text string"), "k", "text"), path, "k")
    back = spark.read.parquet(path).withColumn("file", F.input_file_name())
    files_of = back.groupBy("k").agg(F.count_distinct("file").alias("n")).collect()
    assert len(files_of) == 192 and {r.n for r in files_of} == {1}
    names = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(names) > 1
    for name in names:
        rows = [(r.term, r.k) for r in spark.read.parquet(f"{path}/{name}").collect()]
        assert rows == sorted(rows)
    count = {r.term: (r.n, r.c) for r in back.groupBy("term").agg(F.count("k").alias("n"), F.sum("tf").alias("c")).collect()}
    assert count["red"] == (190, 200) and count["a31.5"] == (190, 200) and count[""] == (2, 2) and count["word199"] == (1, 1)


def test_term_weights_count_postings_once(spark):
    from vitalgrid.operators import retrieval as rt

    posts = rt.postings(spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "red hen")], "k long, text string"), "k", "text")
    weights = rt.term_weights(posts, rt.corpus_stats(rt.section_lengths(posts, "k")))
    read = weights.inputFiles()
    assert read and all("term_counts" in f for f in read)
    assert {r.term: r.df for r in weights.collect()} == {"red": 3, "fox": 1, "hen": 1}


def test_search_tokens_by_first_character_equal_the_plain_rule(spark):
    import re

    from vitalgrid.functions import text as tx

    parts = ["a", "z9", "f32.1", "12", "123", "7", "a1.", "a1.5b", "b22.33.4", "1a", "12a", "99.9", "x", "\u00e9t\u00e9", "_", "a_b", "12.345", "aa1.5"]
    texts = [x + sep + y + sep + x for x in parts for y in parts for sep in ("", " ", ".", "-")]
    want = []
    for t in texts:
        k = [w for w in re.findall(r"[a-z][0-9]+\.[0-9]+|[a-z0-9]{2,}", t.lower()) if not (w.isdigit() and len(w) < 3)]
        want.append(k or [""])
    got = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", tx.search_tokens("t").alias("k")).orderBy("n").collect()
    assert [r.k for r in got] == want


def test_queries_far_from_all_pivots_move_once_a_group(spark, monkeypatch):
    """In many dimensions bounds leave every shard: a query goes to few groups all the same, and finds the exact best."""
    import numpy as np

    from vitalgrid.operators import retrieval as rt

    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 24)) * 1000 + 40_000  # far from the origin, where products round most
    rows[40:60] = rows[7]
    monkeypatch.setattr(rt.pv, "PIVOTS", 64)
    monkeypatch.setattr(rt.pv, "GROUPS", 4)
    monkeypatch.setattr(rt.pv, "PRODUCTS", 500)
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    v, q = spark.createDataFrame(data, "__id long, __e array<double>"), spark.createDataFrame(data, "__q long, __v array<double>")
    pivots = rt.pv.choose(v, "distance")
    shards = rt.pv.radii(rt.pv.placed(v, pivots, "distance", 100))
    assert shards.count() > 50 and rt.pv.visits(q, pivots, shards, 6, "distance").count() <= 5 * len(rows)
    for metric in ("distance", "cosine"):
        near = rt.nearest(q.toDF("k", "qv"), "k", "qv", v.toDF("n", "e"), "n", "e", 6, metric, block=10).collect()
        scaled = rt.pv.scaled(rows, metric)
        for i in range(len(rows)):
            s = (scaled * scaled[i]).sum(1) if metric == "cosine" else -((scaled - scaled[i]) ** 2).sum(1)
            want = sorted(zip((-s).tolist(), range(len(rows))))[:6]
            assert sorted((-r.similarity, r.n) for r in near if r.k == i) == want


def test_person_waves_parse_segments_once(spark):
    from vitalgrid.plans import waves

    read = waves.person_waves(spark, "/root/testdata/sf0.001").inputFiles()
    assert any("/waved-" in f for f in read) and not any("events" in f for f in read)
