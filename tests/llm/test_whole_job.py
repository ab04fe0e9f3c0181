"""Cases a cut of the job would miss."""

import collections
import math
import random
import re

import regex

from vitalgrid.llm import decontamination, disclosure, line_frequency, line_runs, unit_dedup


def test_verbatim_items_of_any_length_are_found(spark):
    r = random.Random(4)
    words = [f"b{i}" for i in range(4000)]
    shares = [1 / (i + 20) for i in range(4000)]
    sizes = [3, 4, 5, 8, 15, 31, 32, 33, 48, 60, 100, 150, 200, 250, 300, 400, 600, 1000] * 2
    items = [" ".join(r.choices(words, shares, k=n)) for n in sizes]
    docs = []
    for k, item in enumerate(items):
        around = [" ".join(r.choices(words[2000:], k=r.randrange(40, 200))) for _ in range(2)]
        docs.append((k, f"{around[0]} {item} {around[1]}"))
    found = decontamination.benchmark_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
    )
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert {(k, k) for k in range(len(items))} <= got
    assert not [(d, k) for d, k in got if d != k and sizes[k] > 8]


def test_items_whose_rare_words_were_replaced_are_found(spark):
    r = random.Random(8)
    common = [f"c{i}" for i in range(80)]
    docs = [(1000 + d, " ".join(r.choices(common, k=200))) for d in range(200)]
    items = []
    for k in range(20):
        item = r.sample(common, 20)
        for i in range(10):
            item.insert(2 * i, f"u{k}x{i}")
        items.append((k, " ".join(item)))
        reworded = [f"other{r.randrange(10**6)}" if w[0] == "u" else w for w in item]
        docs.append((k, " ".join([f"n{i}" for i in range(40)] + reworded + [f"m{i}" for i in range(40)])))
    found = decontamination.benchmark_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(k, k) for k, _ in items} <= {(x.doc_id, x.item_id) for x in found.collect()}


def test_short_lines_and_lines_without_blanks_are_removed(spark):
    rows = [(1, "Menu\nmore\n***\n本作品依许可协议发布"), (2, "menu!\n本作品依许可协议发布\n***\nown line"), (3, "MORE\n\nmenu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in unit_dedup.without_repeated_units(docs).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "***\nown line"), 3: (2, "")}


def test_disclosing_terms_are_tagged_wherever_they_occur(spark):
    r = random.Random(2)
    rows = [(d, "\n".join(" ".join(f"w{r.randrange(60)}" for _ in range(8)) for _ in range(6))) for d in range(60)]
    rows += [(100, "write to Zork at z.o@x.org now"), (101, "Zork of 李四 answers as z.o@x.org there"), (102, "ask 李四 for z.o@x.org")]
    rows += [(103, "no mail here\nZORK, only once more"), (104, f"{'long ' * 400}\nzork z.o@x.org\nand zork 李四")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in disclosure.personal_data(docs).collect()}
    for name, text in rows:
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"(?i)zork|李四", text)}
        assert want <= set(got[name].split(",")), name
    clean = {x.doc_id: x.text for x in disclosure.sanitised(docs).collect()}
    assert not any(re.search("(?i)zork|李四", t) for t in clean.values())
    assert all(clean[d] == rows[d][1] for d in range(60))


LINE = " ".join(f"word{i}" for i in range(25))


def test_lines_repeated_in_a_row_leave_the_first_run_whole(spark):
    rows = [(1, "\n".join([LINE] * 4)), (2, "\n".join([LINE] * 2)), (3, LINE)]
    got = {r.doc_id: r.text for r in line_runs.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "\n".join([LINE] * 2), 2: "", 3: LINE}


def test_single_lines_count_as_runs_on_demand(spark):
    rows = [(1, f"menu\n{LINE}\n{LINE}\n\nmenu"), (2, f"{LINE}\n{LINE}\nown\n menu "), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_in_runs, r.text) for r in line_runs.repeated_runs(docs, lines_too=True).collect()}
    assert got == {1: (2, 0, f"menu\n{LINE}\n"), 2: (3, 2, "own"), 3: (0, 0, "")}


def test_emptied_copies_go_on_demand(spark):
    text = "\n".join([LINE] * 2)
    rows = [(1, text, "a"), (2, text, "a"), (3, f"{text}\nmore", "a"), (4, "", "a"), (5, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __x string")
    got = {r.doc_id: r.text for r in line_runs.without_repeats(docs, keep_emptied=False).collect()}
    assert got == {1: text, 3: "more", 4: "", 5: None}


def test_copies_on_one_host_are_documents(spark):
    own = " ".join(f"own{i}" for i in range(60))
    rows = [(d, f"{own}\nfoot", "h") for d in range(150)] + [(500 + d, f"{own}\nfoot", "k") for d in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in line_frequency.quality_verdicts(docs).collect() if r.kept}
    assert kept == {0} | {500 + d for d in range(100)}
    assert {r.doc_id for r in line_frequency.keep_good(docs).collect()} == kept


def test_ten_megabytes_in_one_text(spark):
    """Removal is linear: 400 000 lines, half of them gone."""
    lines = [f"line {i} " + "x" * 12 if i % 2 else "twice the same" for i in range(400_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines), "h")], "doc_id long, text string, source string")
    got = unit_dedup.without_repeated_units(docs).first()
    assert got.n_removed == 199_999 and len(got.text.split("\n")) == 200_001
    got = line_runs.repeated_runs(docs, 3).first()
    assert got.n_removed == 199_999 and got.text.count("twice") == 1
    letters = str.maketrans("0123456789", "abcdefghij")
    shared = [f"foot {i} of {i + 7}".translate(letters) for i in range(3000)]
    own = [f"own {i} and {i + 3}".translate(letters) for i in range(150_000)]
    texts = {i: "\n".join([*shared, *(f"{x} in {i}".translate(letters) for x in own[:3000])]) for i in range(101)}
    texts[500] = "\n".join(x for k, line in enumerate(own) for x in ([line, shared[k // 50]] if k % 50 == 0 else [line]))
    many = spark.createDataFrame([(i, t, "h") for i, t in texts.items()], docs.schema)
    left = {r.doc_id: r.text for r in line_frequency.keep_good(many).collect()}
    assert left[500] == "\n".join(own) and left[0] == texts[0] and len(left) == 102 and "foot" not in left[7]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_leak(item, words, s):
    """Every place of the grid is tried with every item."""
    n = len(item)
    for middle in range(0, len(words) + 17, 16):
        around = words[max(0, middle - 16 - n) : middle + 16 + n]
        share = plain_common(item, around) / n
        tail = item[-s.answer :]
        if share >= s.same or (share >= s.close and sum(w in around for w in tail) >= s.answer_share * len(tail)):
            return True
    return False


def test_leaks_are_exactly_those_of_trying_everything(spark):
    """Planted items, from verbatim to hopeless, at the edge of the check; the latent search adds none of its own."""
    r, s = random.Random(12), decontamination.Settings()
    vocabulary = [f"v{i}" for i in range(300)]
    shares = [1 / (i + 3) for i in range(300)]
    items = [r.choices(vocabulary, shares, k=n) for n in (1, 2, 3, 4, 6, 9, 14, 20, 25, 31, 32, 33, 40, 55, 70)]
    docs = []
    for d in range(150):
        words = r.choices(vocabulary, shares, k=r.randrange(0, 120))
        if d % 2:
            item = r.choice(items)
            kept = [w if r.random() > (d % 7) / 10 else r.choice(vocabulary) for w in item]
            at = r.randrange(len(words) + 1)
            words[at:at] = kept
        docs.append(words)
    found = decontamination.benchmark_leaks(
        spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"),
    )
    want = {(d, k) for d, words in enumerate(docs) for k, item in enumerate(items) if words and plain_leak(item, words, s)}
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want and len(want) > 100


def test_paraphrases_are_found_by_the_latent_search_alone(spark):
    """Words of one concept are used alike. An item whose every second word is said otherwise is found through them."""
    r = random.Random(5)
    concept = lambda c: [f"c{c}w{i}" for i in range(4)]
    docs = [(1000 + d, " ".join(w for c in r.sample(range(30), 4) for w in r.choices(concept(c), k=32))) for d in range(400)]
    items = [(k, [concept(c)[0] for c in r.sample(range(30), 24)]) for k in range(6)]
    for k, item in items:
        docs.append((k, " ".join(w[:-1] + "1" if i % 2 else w for i, w in enumerate(item))))
        docs.append((100 + k, " ".join(r.sample(item, 24))))  # the same words in another order are no leak
    given = [
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"),
    ]
    settings = decontamination.Settings(rank=30, alike=3, cosine=0.9)
    with_latent = {(x.doc_id, x.item_id) for x in decontamination.benchmark_leaks(*given, settings).collect()}
    words_only = {(x.doc_id, x.item_id) for x in decontamination.benchmark_leaks(*given, decontamination.Settings(cosine=2.0)).collect()}
    assert {(k, k) for k, _ in items} <= with_latent and not words_only & {(k, k) for k, _ in items}
    assert not [d for d, _ in with_latent if d >= 1000]


def test_a_bounded_sample_fits_the_space(spark):
    docs = [(d, " ".join(f"w{(d * 7 + i) % 90}" for i in range(200))) for d in range(60)]
    items = [(0, " ".join(docs[3][1].split()[40:70]))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [
        sorted(x.doc_id for x in decontamination.benchmark_leaks(*frames, decontamination.Settings(fit=n)).collect())
        for n in (1, 40, 1 << 19)
    ]
    assert got[0] == got[1] == got[2] and 3 in got[0]


def plain_terms(rows, threshold=0.8):
    """doc_id -> term spans, from the rule as it is written, for e-mail addresses."""
    word, mail = regex.compile(r"\p{L}[\p{L}\p{N}]*"), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    rows = sorted(set(rows))
    lines = [set(word.findall(x.lower())) for _, t in rows for x in t.split("\n")]
    n = sum(1 for x in lines if x)
    d_t = collections.Counter(w for x in lines for w in x)
    met = {}
    for row in rows:
        text = row[1]
        spans = [(m.start(), m.end()) for m in mail.finditer(text)]
        for a, b in spans:
            left, right = text[max(0, a - 200) : a], text[b : b + 200]
            left = re.sub(r"\A\S+", "", left) if len(left) == 200 else left
            right = re.sub(r"\S+\Z", "", right) if len(right) == 200 else right
            words = [(m.start() + a - len(left), m.end() + a - len(left), m[0].lower()) for m in word.finditer(left)]
            words += [(m.start() + b, m.end() + b, m[0].lower()) for m in word.finditer(right)]
            words = [w for w in words if not any(x < w[1] and w[0] < y for x, y in spans)]
            met.setdefault(text[a:b].lower(), []).append((row, (left, right), words))
    out, alone = {}, set()
    for places in met.values():
        d_e, contexts = len(places), len({c for _, c, _ in places})
        for t in {w for _, _, ws in places for _, _, w in ws}:
            having = [(row, c, ws) for row, c, ws in places if any(w == t for _, _, w in ws)]
            enough = len({c for _, c, _ in having}) >= min(2, contexts) and n > d_e
            ic = math.log2(n / d_e)
            if enough and math.log2(n * min(len(having), d_t[t]) / (d_t[t] * d_e)) >= threshold * ic - 1e-9:
                for row, _, ws in having:
                    out.setdefault(row, set()).update((x, y) for x, y, w in ws if w == t)
                if d_t[t] > 1 and 2 * len(having) >= d_t[t]:
                    alone.add(t)
    for row in rows:
        spans = [(m.start(), m.end()) for m in mail.finditer(row[1])]
        for m in word.finditer(row[1]):
            if m[0].lower() in alone and not any(x < m.end() and m.start() < y for x, y in spans):
                out.setdefault(row, set()).add((m.start(), m.end()))
    return out


def test_terms_equal_the_plain_rule(spark):
    r = random.Random(31)
    common = [f"w{i}" for i in range(40)]
    people = [(f"Zork{i} Müller{i}", f"p{i}@x{i % 3}.org") for i in range(12)]
    rows = []
    for d in range(120):
        parts = [" ".join(r.choices(common, k=r.randrange(1, 9))) for _ in range(r.randrange(1, 7))]
        if d % 2:
            name, address = r.choice(people)
            at = r.randrange(len(parts) + 1)
            parts[at:at] = [f"ask {name if r.random() < 0.8 else 'them'}", f"{address} {r.choice(common)}"][:: r.choice((1, -1))]
        rows.append((d, "\n".join(parts)))
    rows += [(200, "Reach Zyx Quux\nunder z.y@q.org\n"), (201, "no address, only ZORK3 here"), (1, rows[1][1]), (1, rows[1][1])]
    rows += [(202, "w1 " * 150 + "near n.n@far.org " + "w2 " * 150)]
    want = plain_terms(rows)
    got = {}
    for x in disclosure.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        terms = {tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s.startswith("term")}
        got.setdefault(x.doc_id, []).append(terms)
    for row in set(rows):
        assert all(t == want.get(row, set()) for t in got[row[0]]), row
    assert {"Zyx", "Quux"} <= {rows[120][1][a:b] for a, b in got[200][0]} and sum(map(len, want.values())) > 60


def test_twenty_thousand_addresses_in_one_text(spark):
    text = " ".join(f"a{i}@b{i % 7}.org" for i in range(20_000))
    got = disclosure.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_email == 20_000
    spans = [tuple(map(int, s.split(":")[1:])) for s in got.spans.split(",") if s.startswith("email")]
    assert all(text[a:b] == f"a{i}@b{i % 7}.org" for i, (a, b) in enumerate(spans))
