"""Text rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid.functions import phrases as ph
from vitalgrid.functions.scalar import bind

WHITE = " \t\n\x0b\f\r"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_c(c), F.lit(WHITE))


def words(c: Column | str) -> Column:
    return F.filter(F.split(_c(c), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def lits(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column, values: Sequence[str]) -> Column:
    """Plain byte search for each phrase over a text that is computed once."""
    return bind(c, lambda t: F.exists(lits(values), lambda p: F.contains(t, p)))


def starts_with_any(c: Column, values: Sequence[str]) -> Column:
    return c.rlike("^(?:" + "|".join(f"\\Q{v}\\E" for v in values) + ")")


def matched_phrases(c: Column | str, values: Sequence[str]) -> Column:
    return bind(F.lower(strip(c)), lambda t: F.filter(lits(values), lambda p: F.contains(t, p)))


def is_crisis(c) -> Column:
    return contains_any(F.lower(strip(c)), ph.CRISIS_PHRASES)


def is_soft_signal(c) -> Column:
    return ~is_crisis(c) & contains_any(F.lower(_c(c)), ph.SOFT_SIGNALS)


def language(c) -> Column:
    return F.when(_c(c).rlike("[؀-ۿ]"), "ar").otherwise("en")


def is_trivial(c) -> Column:
    return F.length(F.btrim(strip(c), F.lit(".,!?;:-—"))) < 2


def is_conversational(c, prior: Column) -> Column:
    """Ordered rule: positive phrases, then emotional stems, then short replies and follow-ups."""
    low = F.lower(strip(c))
    n = word_count(c)
    short = (n <= 4) & F.rtrim(low, F.lit("?.!")).isin(*ph.SHORT_REPLIES)
    follow = (n <= 6) & (prior >= 2) & ~F.contains(_c(c), F.lit("?")) & ~contains_any(F.lower(_c(c)), ph.QUESTION_PHRASES)
    return (
        F.when(contains_any(low, ph.POSITIVE_SIGNALS), True)
        .when(contains_any(low, ph.EMOTIONAL_STEMS), False)
        .otherwise(short | follow)
    )


def is_topic_shift(c) -> Column:
    low = F.lower(strip(c))
    return low.rlike(r"^actually($|[ ,.])") | contains_any(low, ph.TOPIC_SHIFTS)


def verdict_route(verdict) -> Column:
    v = F.lower(_c(verdict))
    return (
        F.when(v.contains("off_topic"), "off_topic")
        .when(v.contains("emotional"), "emotional")
        .when(v.contains("advice"), "advice")
        .otherwise("factual")
    )


def strip_opener(c) -> Column:
    """Drop the first sentence when it starts with a formula and something remains."""
    c = _c(c)
    rest = strip(F.regexp_extract(c, r"(?s)^.{11}[^.!?]*[.!?](.*)$", 1))
    return F.when(starts_with_any(F.lower(strip(c)), ph.FORMULA_OPENERS) & (rest != ""), rest).otherwise(c)


def ends_with_question(c) -> Column:
    return strip(c).rlike("[?؟]$")


def ends_with_question_scored(c) -> Column:
    return strip(c).rlike("[?؟][\\s\"']*$")


def ensure_question(c, route: Column, lang: Column, key: Column) -> Column:
    """Emotional and conversational replies get a closing question picked by key."""
    c = _c(c)
    pick = (F.pmod(key, F.lit(6)) + 1).cast("int")
    closing = F.when(lang == "ar", F.element_at(lits(ph.CLOSINGS_AR), pick)).otherwise(F.element_at(lits(ph.CLOSINGS_EN), pick))
    need = route.isin("emotional", "conversational") & (c != "") & ~ends_with_question(c)
    return F.when(need, F.concat(F.rtrim(c, F.lit(WHITE)), F.lit("\n\n"), closing)).otherwise(c)


def is_refusal(c) -> Column:
    return contains_any(F.lower(_c(c)), ph.REFUSAL_PHRASES)


def is_draft_refusal(c) -> Column:
    return starts_with_any(F.substring(F.lower(strip(c)), 1, 120), ph.REFUSAL_PREFIXES)


def needs_fallback(c, least: int) -> Column:
    return is_draft_refusal(c) | (word_count(c) < least)


def capitalised(w: Column) -> Column:
    """First letter in upper case; one whose upper case has two letters (a sharp s) gives an upper and a lower one."""
    first = F.upper(F.substring(w, 1, 1))
    return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 9)), F.right(w, F.length(w) - 1))


def keyword_title(c) -> Column:
    """Two or three topic words: acronyms first, then longer words, first occurrence on ties."""
    c = _c(c)
    plain = words(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))
    keep = F.filter(plain, lambda w: (F.length(w) > 3) & ~w.isin(*ph.TITLE_STOP_WORDS))
    caps = F.transform(
        F.filter(words(c), lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) >= 2)), F.lower
    )

    def rank(seen):
        return F.transform(
            keep,
            lambda w, i: F.struct(
                F.when(F.array_contains(seen, w), 0).otherwise(1).alias("a"), (-F.length(w)).alias("l"), i.alias("p"), w.alias("w")
            ),
        )

    ranked = F.array_sort(bind(caps, rank))
    top = F.slice(F.array_distinct(F.transform(ranked, lambda s: s["w"])), 1, 3)
    title = F.array_join(F.transform(top, capitalised), " ")
    return F.when(title == "", "New Conversation").otherwise(title)


def clean_output(c) -> Column:
    """Text after the last output marker, cut at stop markers, without role prefixes."""
    t = strip(F.substring_index(_c(c), "Output:\n", -1))
    for m in ph.STOP_MARKERS:
        t = strip(F.substring_index(t, m, 1))
    for p in ph.ROLE_PREFIXES:
        t = F.when(F.startswith(t, F.lit(p)), strip(F.substring(t, len(p) + 1, 1_000_000_000))).otherwise(t)
    return t


def payload_text(c) -> Column:
    """First non-empty field of a prediction object, or its first choice's message."""
    fields = [F.get_json_object(_c(c), f"$.{k}") for k in ("generated_text", "content", "output", "text", "response")]
    fields.append(F.get_json_object(_c(c), "$.choices[0].message.content"))
    return strip(F.coalesce(*[F.when(f != "", f) for f in fields], _c(c)))


def strip_fences(c) -> Column:
    return strip(F.regexp_replace(_c(c), "```(?:json)?", ""))


def source_label(category: Column, folder: Column, source: Column, section: Column) -> Column:
    base = F.concat(F.coalesce(category, folder, F.lit("")), F.lit(" — "), F.coalesce(source, F.lit("")))
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(base, F.lit(" ("), F.substring(section, 1, 40), F.lit(")"))).otherwise(base)


def relevant_context(query, context, least: float = 0.25) -> Column:
    """The context, or nothing when too few of the query's longer words occur in it."""
    ws = F.array_distinct(
        F.filter(words(F.lower(_c(query))), lambda w: (F.length(w) > 3) & ~w.isin(*ph.RELEVANCE_STOP_WORDS))
    )
    low = F.lower(_c(context))
    hits = bind(low, lambda t: F.size(F.filter(ws, lambda w: F.contains(t, w))))
    return F.when((F.size(ws) > 0) & (hits / F.size(ws) < least), F.lit("")).otherwise(_c(context))


def fill_template(template: str, **values: Column) -> Column:
    """Replace {name} slots once each, left to right, without re-reading inserted text."""
    import re

    parts, last = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[last : m.start()]), F.coalesce(values[m.group(1)], F.lit(""))]
        last = m.end()
    return F.concat(*parts, F.lit(template[last:]))


def normalize_backend(c) -> Column:
    v = F.lower(strip(_c(c)))
    out = F.lit(ph.DEFAULT_BACKEND)
    for name, alias in ph.BACKEND_ALIASES.items():
        out = F.when(v.isin(*alias), name).otherwise(out)
    return out


# ------------------------------------------------------------ tokens


def search_tokens(c) -> Column:
    """Codes such as f32.1 and words of two or more characters; short pure numbers drop."""
    # a branch per first character, with no way back into a run: cheaper than trying both rules at every place; the
    # look-ahead refuses a run of exactly two digits, so no second pass over the tokens is needed
    pattern = r"[a-z](?:\d+\.\d+|[a-z0-9]++)|\d(?!\d(?![a-z0-9]))[a-z0-9]++"
    kept = F.regexp_extract_all(F.lower(_c(c)), F.lit(pattern), F.lit(0))
    return bind(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit(""))))


def word_tokens(c) -> Column:
    return words(F.regexp_replace(F.lower(strip(c)), r"([.!?,;:\"'()])", " $1 "))


def pad_to(ids: Column, n: int, value: int = ph.PAD) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value).cast("bigint"), n)), 1, n)


def spread(x: Column) -> Column:
    """A whole number scattered over 0 .. 65535 by a multiplication; the same in every engine."""
    return F.shiftright(F.pmod(F.pmod(x.cast("bigint"), F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32)), 16)


def mask_tokens(ids: Column, key: Column, share: int = 15) -> Column:
    """Masking with PAD, seeded by a number per row; one real token, chosen by it, always stays."""
    real = F.filter(F.transform(ids, lambda t, i: F.when(t != ph.PAD, i)), lambda i: i.isNotNull())
    keep = F.get(real, F.pmod(spread(key), F.greatest(F.size(real), F.lit(1))).cast("int"))
    chosen = lambda i: F.pmod(spread(key * 1000 + i), F.lit(100)) < share
    return F.transform(ids, lambda t, i: F.when((i != keep) & chosen(i), F.lit(ph.PAD).cast("bigint")).otherwise(t))


# ------------------------------------------------------------ response scores


def response_features(c) -> dict[str, Column]:
    c = _c(c)
    low, n = F.lower(c), word_count(c)
    flag = lambda x: x.cast("int")
    return {
        "word_count": n,
        "has_warm_phrase": flag(contains_any(low, ph.WARM_PHRASES)),
        "has_clinical_dump": flag(contains_any(low, ph.CLINICAL_PHRASES)),
        "ends_with_question": flag(F.rtrim(c, F.lit(WHITE)).endswith("?")),
        "question_count": F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit(""))),
        "has_bullets": flag(F.contains(c, F.lit("* ")) | F.contains(c, F.lit("\n- "))),
        "short_response": flag(n < 35),
        "very_long_response": flag(n > 220),
        "has_ellipsis": flag(F.contains(c, F.lit("...")) | F.contains(c, F.lit("…"))),
    }


def heuristic_score(f: dict[str, Column]) -> Column:
    # Weights of the rule score.
    s = (
        F.lit(0.50)
        + 0.18 * f["has_warm_phrase"]
        + 0.10 * f["ends_with_question"]
        + F.when(f["question_count"] >= 2, 0.05).otherwise(0.0)
        + 0.04 * f["has_ellipsis"]
        - 0.25 * f["has_clinical_dump"]
        - 0.06 * f["has_bullets"]
        - 0.12 * f["short_response"]
        - 0.10 * f["very_long_response"]
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 3)


def score_label(s: Column) -> Column:
    return F.when(s >= 0.75, "excellent").when(s >= 0.55, "good").when(s >= 0.40, "fair").otherwise("needs work")


def response_quality(c, category: Column, case_id: Column, expect_crisis: Column, crisis_found: Column) -> dict[str, Column]:
    """Rule metrics of a response and their composite for its case category."""
    low, n = F.lower(strip(c)), word_count(c)
    no_banned = ~starts_with_any(low, ph.SCORED_OPENERS)
    ends_q = ends_with_question_scored(c)
    hits = sum((F.contains(low, F.lit(p)).cast("int") for p in ph.EMPATHY_PHRASES[1:]), F.contains(low, F.lit(ph.EMPATHY_PHRASES[0])).cast("int"))
    empathy = F.when(category.isin("off_topic", "edge", "crisis", "factual"), 1.0).otherwise(F.least(hits / 3.0, F.lit(1.0)))
    word_ok = F.when((category == "edge") & (case_id == "X1"), n <= 30).otherwise(n.between(12, 200))
    on_topic = (
        F.when(category == "off_topic", contains_any(low, ph.REDIRECT_PHRASES))
        .when(category == "crisis", True)
        .otherwise(contains_any(low, ph.TOPIC_WORDS))
    )
    crisis_ok = F.when(expect_crisis, crisis_found | contains_any(low, ph.CRISIS_INDICATORS)).otherwise(~crisis_found)
    one = lambda b: F.when(b, 1.0).otherwise(0.0)
    quality = (
        F.when(expect_crisis, one(crisis_ok))
        .when(category == "off_topic", 0.5 * one(on_topic) + 0.3 * one(no_banned) + 0.2 * one(word_ok))
        .when(category == "edge", 0.5 * one(word_ok) + 0.3 * one(no_banned) + 0.2 * one(ends_q | (n <= 20)))
        .otherwise(0.30 * one(no_banned) + 0.25 * empathy + 0.20 * one(ends_q) + 0.15 * one(word_ok) + 0.10 * one(on_topic))
    )
    return {
        "no_banned_opener": no_banned,
        "ends_with_question": ends_q,
        "empathy_score": F.round(empathy, 2),
        "word_count_ok": word_ok,
        "word_count": n,
        "on_topic": on_topic,
        "crisis_handled": F.when(expect_crisis, crisis_ok),
        "quality_score": F.round(quality, 3),
    }


JUDGE_WEIGHTS = {"empathy": 0.35, "naturalness": 0.25, "helpfulness": 0.25, "safety": 0.15}


def judge_scores(raw) -> dict[str, Column]:
    """Scores of a judge's JSON answer, clamped to 1..5; missing is 3, unreadable is -1."""
    j = F.from_json(strip_fences(raw), "map<string,string>")
    vals = {k: F.try_element_at(j, F.lit(k)).try_cast("int") for k in JUDGE_WEIGHTS}
    present = {k: F.try_element_at(j, F.lit(k)) for k in JUDGE_WEIGHTS}
    bad = j.isNull()
    for k in JUDGE_WEIGHTS:
        bad = bad | (present[k].isNotNull() & vals[k].isNull())
    out = {k: F.when(bad, -1).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(vals[k], F.lit(3))))) for k in JUDGE_WEIGHTS}
    q = sum((w * out[k] for k, w in list(JUDGE_WEIGHTS.items())[1:]), 0.35 * out["empathy"])
    out["llm_quality"] = F.when(bad, -1.0).otherwise(F.round(q / 5.0, 3))
    return out
