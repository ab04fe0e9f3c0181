"""Personal data: patterns, and terms that give a protected entity away.

Built-in functions only. Patterns find the entities: e-mail addresses, IP addresses, card and phone numbers. The corpus
then tells which words near an entity disclose it. With N lines in the corpus, d(t) of them holding term t, d(e)
occurrences of entity e and d(t, e) of these with t near by, the information that t gives about e is

    PMI(t; e) = log2( N d(t, e) / (d(t) d(e)) ),  out of  IC(e) = log2( N / d(e) )

and t discloses e when PMI / IC reaches the threshold. An entity met in several contexts needs a term in two of them at
least, so that copies of one text are no evidence; an entity met in one context has its rare words there, as they point
at nothing else. A disclosing term goes wherever it stands near its entity; if it is in several lines and at least half
of them are near the entity, it gives the entity away by itself and goes everywhere in the corpus. A term that never occurs without its entity is
removed from the text, other disclosing terms are generalised to a tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import KEY, keyed, text_or_empty
from vitalgrid.session import materialize

# The kinds in output order. Possessive repeats and the look-behinds keep every search linear; they
# change no match, since each repeat is followed by a character outside its class.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to be searched at all.
HINTS = {"email": r"@[A-Za-z0-9]|@-", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){16}", "phone": r"\+[0-9]"}
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}[\p{L}\p{N}]*+"

#: Share of an entity's information a term must carry to disclose it; contexts asked for, where an entity has them;
#: characters of the passage on either side of an entity, across lines.
THRESHOLD = 0.8
MIN_CONTEXTS = 2
REACH = 200
#: Matches summed up in one go; code points of a text's chunks and cells; spans on either side that can touch a passage.
CHUNK = 256
CUT = 4096
CELL = 64
AROUND = 4 * (REACH // 5 + 1)
#: Rows of a few longs that a join may broadcast.
BROADCAST_ROWS = 500_000

SPAN = "array<struct<start:int,end:int,value:string>>"


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost matches with code-point offsets: lengths of the matches and of the gaps between them, summed up.

    Sums go by chunks of matches, then over the chunks, so that a text with very many matches stays cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        first = a["at"] + x["g"]
        span = F.struct(first.alias("start"), (first + x["m"]).alias("end"), x["v"].alias("value"))
        return F.struct((first + x["m"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    def chunked(all_pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_pairs), F.lit(CHUNK))
        return F.transform(starts, lambda i: F.aggregate(F.slice(all_pairs, i, F.lit(CHUNK)), start, add))

    def joined(chunks: Column) -> Column:
        totals = F.aggregate(
            chunks,
            F.array(F.lit(0)),
            lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c["at"])),
        )
        moved = lambda c, by: F.transform(
            c["out"],
            lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")),
        )
        return _once(totals, lambda t: F.flatten(F.transform(chunks, lambda c, i: moved(c, F.get(t, i)))))

    some = _once(pairs, lambda p: F.when(F.size(p) > 0, _once(chunked(p), joined)))
    return F.coalesce(some, F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{IP_PART}(?:\.{IP_PART}){{3}}\z")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def entity_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in a text: candidates by pattern, failing ones dropped without another try."""
    found = F.filter(find_all(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(SPAN))


def _cut(chunks: Column, start: Column, length: Column) -> Column:
    """Part of a text from its chunks of CUT code points; only two chunks are looked at."""
    at = F.floor(start / CUT).cast("int")
    two = F.concat(F.coalesce(F.get(chunks, at), F.lit("")), F.coalesce(F.get(chunks, at + 1), F.lit("")))
    return F.substring(two, start - at * CUT + 1, length)


def with_entities(docs: DataFrame) -> DataFrame:
    """Adds ``__email`` ... ``__phone``, and ``__near``: per entity its value, its passage left and right, and the spans
    around it."""
    out = docs.withColumn("__t", text_or_empty())
    out = out.withColumns({f"__{k}": entity_spans(F.col("__t"), k) for k in PATTERNS})
    spans = F.array_sort(F.concat(*[F.col(f"__{k}") for k in PATTERNS]))

    def contexts(x: Column) -> Column:
        def context(s: Column, i: Column) -> Column:
            first = F.greatest(s["start"] - REACH, F.lit(0))
            left = _cut(x["chunks"], first, s["start"] - first)
            right = _cut(x["chunks"], s["end"], F.lit(REACH))
            # a word cut by the window's edge does not count
            left = F.when(F.length(left) == REACH, F.regexp_replace(left, r"\A\S+", "")).otherwise(left)
            right = F.when(F.length(right) == REACH, F.regexp_replace(right, r"\S+\z", "")).otherwise(right)
            around = F.slice(x["spans"], F.greatest(i + 1 - AROUND, F.lit(1)), F.lit(2 * AROUND + 1))
            return F.struct(
                F.lower(s["value"]).alias("entity"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                left.alias("left"),
                right.alias("right"),
                F.transform(around, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"))).alias("base"),
            )

        return F.transform(x["spans"], context)

    chunks = F.regexp_extract_all("__t", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    given = F.struct(spans.alias("spans"), F.when(F.size(spans) > 0, chunks).alias("chunks"))
    return out.withColumn("__near", _once(given, contexts)).drop("__t")


def _term_lines(docs: DataFrame, twice: DataFrame) -> tuple[DataFrame, int]:
    """(term, d_t): the lines with each term (by hash), summed up in the tasks first; and all lines with any term.

    ``twice`` has the number of rows of row keys that are there more than once; such rows share their count.
    """
    rows = keyed(docs.select("doc_id", "text"))
    one = F.lit(1.0)
    if twice.limit(1).count():
        rows = rows.join(_small(twice), KEY, "left")
        one = 1.0 / F.coalesce("copies", F.lit(1))
    lines = rows.select(one.alias("one"), F.explode(F.split(F.lower(text_or_empty()), "\n")).alias("line"))
    terms = F.array_distinct(F.regexp_extract_all("line", F.lit(TERM), F.lit(0)))
    hashes = F.transform(terms, lambda t: F.xxhash64(t))
    # under the hash null: the lines with any term
    marked = F.when(F.size(hashes) > 0, F.concat(hashes, F.array(F.lit(None).cast("long"))))
    counts = lines.select("one", F.explode(marked).alias("term")).groupBy("term").agg(F.sum("one").alias("n"))
    table = materialize(counts.select("term", F.round("n").cast("long").alias("d_t")), "term-lines")
    total = table.where("term is null").select("d_t").first()
    return table.where("term is not null"), total[0] if total else 0


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if a count proves it small; else the join shuffles both sides."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def disclosing_terms(
    entities: DataFrame, docs: DataFrame, twice: DataFrame, threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS
) -> DataFrame:
    """Term spans per row key: ``__terms`` with start, end and ``always`` (the term never occurs without its entity)."""
    near = entities.select(*KEY, F.explode("__near").alias("n")).select(
        *KEY,
        F.xxhash64("n.entity").alias("entity"),
        F.xxhash64("n.left", "n.right").alias("context"),
        F.concat(
            F.transform(
                find_all(F.col("n.left"), TERM),
                lambda s: F.struct(
                    (s["start"] + F.col("n.start") - F.length("n.left")).alias("start"),
                    (s["end"] + F.col("n.start") - F.length("n.left")).alias("end"),
                    F.xxhash64(F.lower(s["value"])).alias("term"),
                ),
            ),
            F.transform(
                find_all(F.col("n.right"), TERM),
                lambda s: F.struct(
                    (s["start"] + F.col("n.end")).alias("start"),
                    (s["end"] + F.col("n.end")).alias("end"),
                    F.xxhash64(F.lower(s["value"])).alias("term"),
                ),
            ),
        ).alias("words"),
        F.col("n.base").alias("base"),
    )
    clear = F.filter(
        "words", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    )
    near = materialize(near.select(*KEY, "entity", "context", clear.alias("words")), "entity-words")
    occurrences = near.groupBy("entity", "context").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(
        F.sum("n").alias("d_e"), F.count(F.lit(1)).alias("places")
    )
    terms = F.array_distinct(F.transform("words", lambda w: w["term"]))
    both = (
        near.select("entity", "context", F.explode(terms).alias("term"))
        .groupBy("entity", "term", "context")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("d_te"), F.count(F.lit(1)).alias("contexts"))
        .join(occurrences, "entity")
        .where(F.col("contexts") >= F.least(F.lit(min_contexts), "places"))
    )
    both = materialize(both, "entity-terms")
    lines, total = _term_lines(docs, twice)
    scored = both.join(lines, "term").withColumn("n", F.lit(total))
    seen = F.least("d_te", "d_t")
    pmi = F.log2(F.col("n") * seen / (F.col("d_t") * F.col("d_e")))
    ic = F.log2(F.col("n") / F.col("d_e"))
    found = materialize(
        scored.where((ic > 0) & (pmi >= threshold * ic - 1e-9)).select(
            "entity",
            "term",
            (F.col("d_te") >= F.col("d_t")).alias("always"),
            ((F.col("d_t") > 1) & (2 * F.col("d_te") >= F.col("d_t"))).alias("alone"),
        ),
        "disclosing-terms",
    )
    words = near.select(*KEY, "entity", F.explode("words").alias("w")).select(*KEY, "entity", "w.*")
    hits = words.join(_small(found), ["entity", "term"]).select(*KEY, "start", "end", "always")
    others = _occurrences(docs, materialize(found.where("alone").select("term").distinct(), "disclosing-words"))
    # spans and words meet in cells of the text
    cell = lambda start, end: F.sequence(F.floor(start / CELL), F.floor((end - 1) / CELL))
    spans = F.concat(*[F.transform(f"__{k}", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))) for k in PATTERNS])
    base = entities.select(*KEY, F.explode(spans).alias("s")).select(*KEY, "s.*")
    base = base.withColumn("cell", F.explode(cell(F.col("a"), F.col("b"))))
    met = others.withColumn("cell", F.explode(cell(F.col("start"), F.col("end")))).join(base, [*KEY, "cell"])
    inside = met.where("a < end and start < b").select(*KEY, "start", "end").distinct()
    others = others.join(inside, [*KEY, "start", "end"], "left_anti").select(
        *KEY, "start", "end", F.lit(None).cast("boolean").alias("always")
    )
    # a term away from its entity is no longer one that never occurs without it
    each = hits.unionByName(others).groupBy(*KEY, "start", "end").agg(F.coalesce(F.min("always"), F.lit(False)).alias("always"))
    return each.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end", "always"))).alias("__terms"))


def _occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurrence of the terms (by hash) in the documents: row key, start, end."""
    rows = keyed(docs.select("doc_id", "text"))
    terms = _small(terms)
    held = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(t)))
    some = rows.select(*KEY, F.explode(held).alias("term")).join(terms, "term", "left_semi")
    some = materialize(some.select(*KEY).distinct(), "disclosed-documents")
    texts = rows.join(_small(some), KEY, "left_semi").select(*KEY, "text").dropDuplicates(KEY)
    values = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    gaps = F.slice(F.split("text", TERM, -1), F.lit(1), F.size(values))
    word = F.zip_with(
        gaps, values, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), F.xxhash64(F.lower(m)).alias("term"))
    )
    each = texts.select(*KEY, F.posexplode(word).alias("i", "w")).select(*KEY, "i", "w.*")
    upto = Window.partitionBy(*KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("g") + F.col("m")).over(upto).cast("int"))
    each = each.withColumn("start", (F.col("end") - F.col("m")).cast("int"))
    return materialize(each.join(terms, "term", "left_semi").select(*KEY, "start", "end"), "occurrences")


def _written(kind: str) -> Column:
    spans = F.coalesce(F.col("__terms"), F.array()) if kind == "terms" else F.col(f"__{kind}")
    label = F.lit("term" if kind == "terms" else kind)
    return F.transform(spans, lambda s: F.concat_ws(":", label, s["start"], s["end"]))


def _joined(kinds: list[str]) -> Column:
    return F.array_join(F.concat(*[_written(k) for k in kinds]), ",")


def _spans(docs: DataFrame, threshold: float, min_contexts: int) -> DataFrame:
    rows = keyed(docs.select("doc_id", "text"))
    kept = [F.transform(f"__{k}", lambda s: F.struct(s["start"], s["end"])).alias(f"__{k}") for k in PATTERNS]
    base = materialize(with_entities(rows).select("doc_id", *KEY, *kept, "__near"), "entities")
    some = base.where(F.size("__near") > 0).dropDuplicates(KEY)
    twice = base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    twice = materialize(twice, "rows-twice")
    return base.drop("__near").join(disclosing_terms(some, docs, twice, threshold, min_contexts), KEY, "left")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    Null text counts as empty: no spans. Rows equal in doc_id and text count once as evidence and get equal results, a
    row each. Empty table: no rows. A very long text is searched whole in one task, its matches summed up in chunks.
    Other columns are ignored, whatever their names.
    """
    kinds = list(PATTERNS)
    return _spans(docs, threshold, min_contexts).select(
        "doc_id",
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(kinds), 256).alias("base_sha256"),
        _joined([*kinds, "terms"]).alias("spans"),
        F.coalesce(F.size("__terms"), F.lit(0)).cast("long").alias("n_terms"),
    )


def sanitised(docs: DataFrame, threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """The documents with entities and disclosing terms replaced by tags or removed; null texts stay null.

    Rows equal in doc_id and text get equal texts, a row each. Empty table: no rows. Time grows with a text's length times
    its spans. Names after two underscores are reserved.
    """
    names = docs.columns
    spans = _spans(docs, threshold, min_contexts).drop("doc_id").dropDuplicates(KEY)
    span = lambda s, tag: F.struct(s["start"], s["end"], tag.alias("tag"))

    def tagged(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda s: span(s, F.lit(f"[{kind.upper()}]")))

    terms = F.transform("__terms", lambda s: span(s, F.when(s["always"], F.lit("")).otherwise(F.lit("[TERM]"))))
    every = F.sort_array(F.concat(*[tagged(k) for k in PATTERNS], F.coalesce(terms, F.array())))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a: Column, s: Column) -> Column:
        piece = F.concat(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), s["tag"])
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], piece).otherwise(a["out"]).alias("out"),
        )

    done = F.aggregate("__all", start, add, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    joined = keyed(docs).join(spans, KEY, "left").withColumn("__all", every)
    return joined.withColumn("text", F.when(F.size("__all") > 0, done).otherwise(F.col("text"))).select(*names)
