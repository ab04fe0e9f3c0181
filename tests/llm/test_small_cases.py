"""Every operator and stage on awkward rows: nulls, empty and blank texts, repeats, ties, clashing names, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitalgrid.llm import chat, count_tree, decontamination, disclosure, line_frequency, line_runs, packing, simple8b
from vitalgrid.llm import token_counts, unit_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, node string, term int"
PASSAGE = " ".join(f"wort{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(70))
ROWS = [
    (1, None, "en", "a", None, 1, "x", 1),
    (2, "", "en", "a", 0, 2, "x", 1),
    (3, " \n\t\n ", None, None, 5, 3, "x", None),
    (4, f"First line.\n{PASSAGE}\n\nmail a.b@c.de now", "en", "a", 1, 4, None, 1),
    (5, f"Some more.\n{PASSAGE}\nmail a.b@c.de later", "en", "b", 1, 5, "x", 1),
    (5, f"Some more.\n{PASSAGE}\nmail a.b@c.de later", "en", "b", 1, 5, "x", 1),
    (5, OTHER, "en", "b", 1, 5, "x", 1),
    (None, f"{OTHER} end", "en", "b", 1, 5, "x", 1),
    (6, "one two", "en", "b", 1, 5, "x", 1),
    (7, "w " * 3000 + "x" * 30000, "en", "b", 1, 5, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(PASSAGE.split()[10:40])), (2, None), (3, "")], "item_id long, text string")


PER_ROW = {
    "op1": line_runs.repeated_runs,
    "op2": unit_dedup.without_repeated_units,
    "op3": disclosure.personal_data,
    "op4": line_frequency.quality_verdicts,
    "op6": token_counts.token_counts,
    "op9": simple8b.token_file,
    "op10": count_tree.jaccard_components,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(name, docs, empty):
    got = PER_ROW[name](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert PER_ROW[name](empty).count() == 0
    assert len({tuple(r) for r in got if r.doc_id == 5}) == (3 if name == "op9" else 2)  # equal rows, equal results


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, stage, docs, empty, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, empty):
        out = stage[1](spark, rows, str(tmp_path))
        assert out.schema.names == rows.schema.names and out.count() <= rows.count()
    assert {r.term for r in stage[1](spark, docs, str(tmp_path)).collect()} <= {1, None}


def test_packing_and_decontamination_of_awkward_rows(docs, empty, benchmark):
    pieces = packing.pack_texts(docs).collect()
    assert sum(p.length for p in pieces if p.start == 0 and p.doc_id in (1, 2, 3)) == 3  # the end id alone
    assert packing.pack_texts(empty).count() == 0
    found = decontamination.benchmark_leaks(docs, benchmark)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(4, 1), (5, 1), (5, 1)]
    assert decontamination.benchmark_leaks(empty, benchmark).count() == 0
    assert decontamination.benchmark_leaks(docs, benchmark.where("item_id > 1")).count() == 0


def test_repeats_go_and_the_first_stays(docs):
    runs = {(r.doc_id, r.text) for r in line_runs.repeated_runs(docs).collect()}
    assert any(d == 4 and PASSAGE in t for d, t in runs) and not any(d == 5 and PASSAGE in t for d, t in runs)
    units = {(r.doc_id, r.removed) for r in unit_dedup.without_repeated_units(docs).collect() if r.removed}
    assert units == {(5, f"11:{11 + len(PASSAGE)}")}


def test_near_copies_leave_one_of_each(docs):
    kept = count_tree.one_of_each(docs).collect()
    assert sum(r.text is not None and OTHER in r.text for r in kept) == 1
    assert {r.doc_id for r in kept} >= {1, 2, 3, 4, 6, 7}


def test_tags_replace_personal_data(docs):
    got = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "[EMAIL]" in got[4] and "@" not in got[4] and got[1] is None and got[6] == "one two"


def test_chat_of_awkward_rows(spark):
    part = f"array<struct<{', '.join(c.replace(' ', ':') for c in chat.PART.split(', '))}>>".replace("long", "bigint")
    schema = f"conv_id long, turn long, role string, parts {part}, segment string"
    rows = [
        (1, 0, "user", [("text", "a<b & [c] \"", None, None), ("image", None, "s3://x", 2), ("text", None, None, None)], "z"),
        (1, 1, "assistant", [("document", None, None, None), ("text", "&lt; ok", None, None)], "z"),
        (1, 1, "assistant", None, "z"),
        (None, None, None, [], "z"),
    ]
    segments = chat.format_turns(spark.createDataFrame(rows, schema))
    by = {(r.conv_id, r.turn, bool(r.attachments)): r for r in segments.collect()}
    image = by[1, 0, True]
    assert [(a.kind, a.ref, a.tokens) for a in image.attachments] == [("image", "s3://x", 512)]
    assert image.segment == '<turn role="user">\na&lt;b &amp; &lsqb;c] &quot;<image n="0"/></turn>\n'
    assert by[1, 1, True].expanded_tokens == 512
    back = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert back[1].n_turns == 3 and back[1].loss_chars == len("&lt; ok") and back[None].n_turns == 1
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], schema))).count() == 0
    with pytest.raises(ValueError, match="video"):
        chat.Flattener().visit({"kind": "video"})


def test_text_parts_hold_nulls(spark):
    one = spark.createDataFrame([(None,)], "t string").select(chat.text_parts(F.col("t")).alias("p")).first().p
    assert [(x.kind, x.text) for x in one] == [("text", "")]
