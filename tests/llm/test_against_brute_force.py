"""Operators that SQL cannot express next to plain versions on small data."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tools.compare import canon, connect, same
from vitalgrid.llm import count_tree, decontamination, packing, shingles, simple8b, token_counts, word_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if re.match(r"op\d+_", n)])
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols, rows = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(SF).execute(entry.oracle_sql()[name])
    want_cols, want = canon([c[0] for c in cur.description], cur.fetchall())
    assert cols == want_cols and len(rows) == len(want)
    assert not [(c, a, b) for x, y in zip(rows, want) for c, a, b in zip(cols, x, y) if not same(a, b)]


def word_bpe(texts):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file(spark, documents):
    want, at = [], 0
    for (name, _), ids in zip(documents, word_bpe([t for _, t in documents])):
        want.append((name, at, len(ids) + 1, crc([*ids, 1])))
        at += len(ids) + 1
    assert sorted(map(tuple, run(spark, "op9_simple8b_token_file"))) == want


def test_packing(spark, documents):
    ids = {d: [*x, 1] for (d, _), x in zip(documents, word_bpe([t for _, t in documents]))}
    check_pieces(run(spark, "op5_vector_bin_packing"), ids)


def check_pieces(rows, ids):
    pieces, sequences = {}, {}
    for r in rows:
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, total in [(pieces[d], len(ids[d])) for d in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total else at <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(sequences)) > 0.95


def test_limits_hold_together():
    limits = packing.Limits(tokens=100, segments=4, loss=60, pool=64)
    pool, r = packing.Pool(limits), random.Random(5)
    sizes = [r.randrange(1, 250) for _ in range(300)]
    for i, n in enumerate(sizes):
        pool.add(i, np.arange(n, dtype=np.uint32), r.randrange(0, n + 1))
    seen = {}
    for sequence in pool.pack(True):
        assert len(sequence) <= 4 and sum(len(p[2]) for p in sequence) <= 100
        assert sum(pool.loss_of(p) for p in sequence) <= 60
        for name, start, ids, _, _ in sequence:
            seen.setdefault(name, []).extend(ids.tolist())
            assert ids[0] == start
    assert {k: sorted(v) for k, v in seen.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def test_token_counts(spark, documents):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = [len(e.ids) for e in coder.encode_batch([t for _, t in documents], add_special_tokens=False)]
    want = [(d, len(t.encode()), n, n > 1024) for (d, t), n in zip(documents, counts)]
    assert sorted(tuple(r)[:4] for r in run(spark, "op6_prefix_token_counts")) == want


PIECES = ["a", "the", "ing", " ", "  ", "\n", "'", "'re", "'ve", "1", "23", ".", "!!", "é", "中", "😀", "\t", "\x85", "aaaa"]


def test_counts_at_every_prefix():
    table = token_counts.prefix_counts("byte_bpe_50k.json")
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda x: len(coder.encode(x, add_special_tokens=False).ids)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(PIECES) for _ in range(r.randrange(0, 12)))
        want = [count(text[:i]) for i in range(1, len(text) + 1)]
        assert table.prefixes(text) == want
        units = table.split(text)
        for budget in range(6):
            fit = max([i for i, n in enumerate(want, 1) if n <= budget], default=0)
            assert table.within(units, table.counts(units), budget) == fit
    special = "x <|endoftext|> y<|endoftext|>"
    assert int(table.counts(table.split(special)).sum()) == count(special)


def test_word_ids_equal_the_library():
    coder, r = word_ids.word_ids("word_bpe_49k.json"), random.Random(3)
    texts = ["", "DON'T ''s", "a<|endoftext|>b", "İΣΑΣ", "x\x85y", "²½ １", "é", "ÀÉ ŒŸ ſ"]
    texts += ["".join(r.choice([*PIECES, ",", ".,", "-", "_", "…"]) for _ in range(r.randrange(14))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == word_bpe(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    words, offsets = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(words, offsets, len(values)).tolist() == values


def test_personal_data(spark, documents):
    # the patterns as the task states them
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    got = {r.doc_id: r for r in run(spark, "op3_disclosure_sanitising")}
    for name, text in documents:
        found = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if valid(k, m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert got[name].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert got[name].spans.startswith(joined)


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def sets_of(texts, size):
    return shingles.shingle_sets(pa.array(texts, pa.string()), size)


def test_shingles_equal_plain_ones():
    r = random.Random(1)
    texts = ["".join(r.choice("aAbé \n\t") for _ in range(r.randrange(40))) for _ in range(300)] + [None]
    for size in (3, 5):
        got = sets_of(texts, size)
        for text, found in zip(texts, got):
            w = (text or "").encode().lower().split()
            want = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
            assert len(found) == len(want)
    assert (sets_of(["x y z q"], 3)[0] == sets_of(["  X y\nZ q "], 3)[0]).all()


def near_copies(seed=4, groups=30):
    r, out = random.Random(seed), []
    for _ in range(groups):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(3, 260))]
        for _ in range(r.randrange(1, 9)):
            copy = list(words)
            for _ in range(r.randrange(0, 1 + len(words) // 25)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(5000)}"
            out.append(" ".join(copy))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_equal_all_pairs(spark, monkeypatch, size, percent):
    monkeypatch.setattr(count_tree, "POINT_BLOCK", 4)  # many blocks
    monkeypatch.setattr(count_tree, "PAIRS_PER_TEXT", 3)
    if size == 5:
        monkeypatch.setattr(count_tree, "BROADCAST_ROWS", 0)  # every join shuffles
    texts = near_copies()
    sets, forest = sets_of(texts, size), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if count_tree.linked(sets[i], sets[j], percent):
                a, b = forest[i], forest[j]
                forest = [min(a, b) if x in (a, b) else x for x in forest]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in count_tree.jaccard_components(docs, size, percent).collect()}
    assert [got[i] for i in range(len(texts))] == forest


def test_linked_sets_share_a_page():
    r = np.random.default_rng(0)
    for percent in (80, 90):
        for _ in range(400):
            n = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
            drop = int(r.integers(0, len(a) * (100 - percent) // 100 + 1))
            b = np.unique(np.append(a[drop:], r.integers(0, 2**64 - 1, int(r.integers(0, drop + 1)), dtype=np.uint64)))
            if len(b) and count_tree.linked(a, b, percent):
                shared = np.intersect1d(count_tree.page_keys(a, percent), count_tree.page_keys(b, percent))
                assert len(shared) or np.array_equal(a, b)


def test_tree_finds_what_the_bound_allows(monkeypatch):
    r = np.random.default_rng(1)
    points = r.poisson(1.5, (200, count_tree.COORDINATES)) + r.poisson(0.5, (1, count_tree.COORDINATES)) * 4
    monkeypatch.setattr(count_tree, "LEAF", 7)
    tree = count_tree.CountTree(points, 80)
    want = set()
    for k, q in enumerate(points[:40]):
        bound = np.minimum(points, q).sum(axis=1)
        want |= {(k, int(r)) for r in np.flatnonzero(bound >= count_tree.needed(q.sum() + points.sum(axis=1), 80))}
    found = [(int(a), int(b)) for q, r in tree.near(points[:40]) for a, b in zip(q, r)]
    assert set(found) == want and len(found) == len(want)


def test_latent_search_recalls_exact_cosines(spark):
    r = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    items = [" ".join(r.choice([r.choice(common), f"u{r.randrange(3000)}"]) for _ in range(r.randrange(15, 60))) for _ in range(40)]
    docs, want = [], set()
    for d in range(300):
        words = [r.choice([r.choice(common), f"v{r.randrange(9000)}"]) for _ in range(r.randrange(20, 300))]
        if d % 5 == 0:
            k = r.randrange(40)
            leak = [w for w in items[k].split() if r.random() > (0.1 if d % 2 else 0)]  # half of them paraphrased
            at = r.randrange(len(words))
            words[at:at] = leak
            want.add((d, k))
        docs.append((d, " ".join(words)))
    found = decontamination.benchmark_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
    )
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_common_subsequence_lengths():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontamination.common_subsequence(masks, b) == table[-1][-1]
