"""The pipeline's stages and result next to a plain version in Python."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from test_against_brute_force import check_pieces, word_bpe  # noqa: E402

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def good(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
    covered = {i + k for i, g in enumerate(grams) if g in seen for k in range(3)}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


def without_runs(docs):
    """Shortest runs of 50 words from and to every line; all but the first of equal ones go, then emptied documents."""
    runs = {}
    for d, text in docs:
        full = [(i, line.strip(" \t\x0b\x0c\r")) for i, line in enumerate(text.split("\n"))]
        full = [(i, line, len(words(line))) for i, line in full if line]
        for k in range(len(full)):
            for step in (1, -1):
                j, n = k, full[k][2]
                while n < 50 and 0 <= j + step < len(full):
                    j += step
                    n += full[j][2]
                if n >= 50:
                    a, b = min(j, k), max(j, k)
                    runs.setdefault(tuple(x[1] for x in full[a : b + 1]), set()).add((d, a, tuple(x[0] for x in full[a : b + 1])))
    gone = set()
    for places in runs.values():
        (first, at, run), *later = sorted(places)
        gone |= {(d, i) for d, a, lines in later if d != first or a >= at + len(run) for i in lines}
    out = []
    for d, text in docs:
        lines = text.split("\n")
        kept = [line for i, line in enumerate(lines) if (d, i) not in gone]
        if len(kept) == len(lines) or words("\n".join(kept)):
            out.append((d, "\n".join(kept)))
    return out


def first_of_each(docs):
    sets = {}
    for d, text in docs:
        w = text.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {d: d for d, _ in docs}
    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    return [(d, t) for d, t in docs if root[d] == d]


def without_items(docs, items):
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    found = [plain(t) for t in items]
    return [(d, t) for d, t in docs if not any(f" {i} " in f" {plain(t)} " for i in found)]


@pytest.fixture(scope="module")
def plain(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = [docs, [x for x in docs if good(x[1])]]
    stages.append(without_runs(stages[-1]))
    stages.append(first_of_each(stages[-1]))
    stages.append(without_items(stages[-1], items))
    return stages


@pytest.mark.parametrize("k", range(4), ids=[n for n, _ in corpus_pipeline.STAGES[:4]])
def test_stage_equals_plain_version(spark, plain, k):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    texts = spark.createDataFrame(plain[k], "doc_id long, text string")
    docs = texts.join(given.drop("text"), "doc_id").select(*given.columns)
    got = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert got.columns == given.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == plain[k + 1]


def test_pipeline_packs_what_is_left(spark, plain):
    ids = {d: [*x, 1] for (d, _), x in zip(plain[-1], word_bpe([t for _, t in plain[-1]]))}
    check_pieces(corpus_pipeline.run(spark, SF).collect(), ids)
