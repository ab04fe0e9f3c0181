"""URL rules over aliases, the prefix trie and whitening next to plain versions, and on awkward rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from vitalgrid.llm import prefix_trie, url_rules, whitening

SF = "/root/testdata/sf0.001"

CANONICAL = '<html><head><link rel="canonical" href="{}"></head></html>'
PAGES = [
    (1, "http://a.example.org/de/1", CANONICAL.format("http://b.example.net/es/1")),  # alias of a blocked address
    (2, "https://b.example.net/es/1#top", "<p>"),  # blocked by its rule
    (3, "http://c.example.org/x", '<META http-equiv="Refresh" content="0; url=/y?q=1&amp;r=2">'),
    (4, "http://c.example.org/y?q=1&r=2", "<link href='//a.example.org/de/1' rel='nofollow Canonical'>"),  # two steps off
    (5, "http://www.example.com/en/1", CANONICAL.format("http://b.example.net/es/1")),  # explicit allow stands
    (6, "http://d.example.org/z", f"<!-- {CANONICAL.format('http://b.example.net/es/1')} -->"),  # a comment is no link
    (7, "http://e.example.org/z", CANONICAL.format("mailto:someone")),
    (8, "http://f.example.org/p/q.html", CANONICAL.format("../r/./s.html")),
    (9, "http://f.example.org/r/s.html", CANONICAL.format("http://gone.example.com/en/9")),  # a target never fetched
    (10, None, CANONICAL.format("http://b.example.net/es/1")),
    (11, "no scheme", None),
    (12, "HTTP://M.Example.COM/en/#x", ""),
    (13, "http://", "<p>"),
    (14, "http://h.org", CANONICAL.format("")),
    (14, "http://h.org", CANONICAL.format("")),
    (15, "http://xexample.com/en/", None),
    (None, "http://net/fr/1", "x" * 3_000_000),
]
VERDICTS = {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block",
            10: "allow", 11: "allow", 12: "block", 13: "allow", 14: "allow", 15: "allow", None: "block"}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(p, u, h, "x", 1, "own") for p, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, component int, rule string")


def test_blocks_reach_aliases(pages):
    got = url_rules.judged_pages(pages).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: r.verdict for r in got} == VERDICTS
    found = {r.page_id: r for r in got}
    assert found[12].host == "m.example.com" and found[12].path == "/en/" and found[12].rule == "example.com/en/"
    assert found[15].rule == "com/" and found[5].rule == "www.example.com/en/"
    assert found[1].alias_of == found[4].alias_of == "a.example.org/de/1" and found[2].alias_of is None
    assert (found[10].host, found[10].path, found[11].host) == ("", "", "")


def test_pages_with_links_equal_their_sql(spark, pages):
    rows = [r for r in PAGES if r[0] not in (8,)]  # the SQL leaves dot segments alone
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cur = con.execute(entry.oracle_sql()["op11_redirect_equivalence"])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = url_rules.judged_pages(pages.where("page_id is null or page_id <> 8")).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_given_redirects_and_empty_tables(spark, pages):
    hops = spark.createDataFrame(
        [("http://e.example.org/z", "http://k.example.net/fr/"), (None, "x"), ("http://q.org/", None)], "url string, target string"
    )
    got = {r.page_id: r.verdict for r in url_rules.judged_pages(pages, redirects=hops).collect()}
    assert got[7] == "block" and got[6] == "allow"
    assert url_rules.judged_pages(pages.limit(0)).count() == 0
    assert url_rules.judged_pages(pages.limit(0), redirects=hops).count() == 0


def plain_trie(rows):
    """conv_id, turn, role, text -> the query's rows, by dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            order = (turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).hexdigest())
            own.setdefault(c, []).append((order, role or "", text))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        inner = {p[:-1] for p in nodes if p}
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path))
        up = min(nodes[path[:-1]]) if path else None
        leaves = sum(p not in inner for p in below)
        out.append((min(members), len(path), up, len(members), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk():
    rows = []
    for c in range(60):
        for turn in range(0, (c * 7) % 13):
            rows.append((c, turn, ("user", "assistant", None)[turn % 3], f"turn {turn} {'é' * (c % 3)}" if turn > 2 else "hello"))
    rows += [(200, None, "user", None), (200, 0, None, "x"), (200, 0, "user", "x"), (200, 0, "user", "x"), (None, 1, "user", "lost")]
    rows += [(205, t, "user", f"long {t}") for t in range(150)] + [(206, t, "user", f"long {t}") for t in range(150)]
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("heavy, shard", [(1 << 17, 1 << 17), (40, 16), (8, 1 << 17), (1, 1)])
def test_trie_equals_dictionaries(spark, heavy, shard):
    given = [(*r, 1, 2) for r in talk()]
    turns = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, depth int, p1 long")
    got = prefix_trie.conversation_trie(turns, heavy, shard)
    rows = got.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str) == plain_trie(talk())
    slots = [(r.shard, r.slot) for r in rows if r.slot is not None]
    assert len(slots) == len(set(slots))
    for shard_id in {s for s, _ in slots}:  # minimal: no slot is left out
        taken = sorted(n for s, n in slots if s == shard_id)
        assert taken == list(range(len(taken)))
    assert prefix_trie.conversation_trie(turns.limit(0)).count() == 0


@pytest.mark.parametrize("levels", [0, 1, 40])
def test_perfect_hash_knows_its_keys_only(levels):
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    index = prefix_trie.PerfectHash(keys, levels)
    assert sorted(index.lookup(keys)) == list(range(5000))
    others = keys ^ np.uint64(1)
    assert (index.lookup(others) == -1).all() and (index.lookup(keys[:, ::-1].copy()) == -1).all()
    assert len(prefix_trie.PerfectHash(keys[:0]).lookup(keys)) == 5000


def plain_whitening(vectors, most=16):
    kept = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for _, v in kept]
    fit = np.array(sorted(set(map(tuple, x))), dtype=np.int64)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = (fit - np.array(total) / n).astype(np.longdouble).astype(float)
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    some = min(most, int((value > 1e-12 * value[0]).sum()))
    rows = {}
    for (i, _), v in zip(kept, x):
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, total))
        p = (np.array(v) - np.array(total) / n) @ vector[:, :some] / np.sqrt(value[:some])
        for k in range(some):
            rows.setdefault((i, k + 1), []).append((n, deviation, abs(p[k]), value[k] / value.sum()))
    return rows


def check_whitening(got, vectors):
    want = plain_whitening(vectors)
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error < 1e-6 and r.deviation == int(r.deviation_exact)
    assert set(seen) == set(want)
    for key, rows in want.items():
        for a, b in zip(sorted(seen[key]), sorted(rows)):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 and abs(a[3] - b[3]) < 1e-6 * b[3], key


def test_whitening_equals_eigenvectors(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in frame.collect()]
    check_whitening(whitening.whitened(frame).collect(), vectors)


def test_whitening_of_awkward_vectors(spark):
    r = np.random.default_rng(3)
    wide = r.normal(size=(300, 12)) * np.array([1e4, 1e3, 1e2, 30, 10, 5, 3, 2, 1, 1, 1, 0])  # a constant column
    wide[:, 10] = wide[:, 9]  # and one that repeats another
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(wide)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12),
             (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0])]
    rows += [(1000 + i, rows[5][1]) for i in range(500)]  # copies count once
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x int, n int")
    got = whitening.whitened(frame).collect()
    assert {g.component for g in got} == set(range(1, 11))
    check_whitening(got, [x for x in rows if x[0] != 905])


def test_whitening_without_directions(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).count() == 0
    two = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)], schema)).collect()
    assert [(r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in two] == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(10**12 * i)], 0) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    x = [64 * 10**12 * i + 1000000 for i in range(5)]
    for r in got:
        exact = (5 * x[r.vec_id] - sum(x)) ** 2
        assert int(r.deviation_exact) == exact and r.deviation == (exact if exact < 1 << 63 else None)
