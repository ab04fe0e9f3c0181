"""Queries over conversations, responses and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions import phrases as ph
from vitalgrid.functions import text as tx
from vitalgrid.operators import conversation as cv
from vitalgrid.operators.ordering import join_per_key
from vitalgrid.plans.registry import query
from vitalgrid.plans.tables import FEEDBACK_SQL, feedback_lines
from vitalgrid.plans.waves import rounded
from vitalgrid.session import materialize, scratch_dir
from vitalgrid.sources import files
from vitalgrid.sources import tables as src


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# Endings so that every rule has rows that meet it: after each turn's own text, and alone as rows with keys of their own.
TAILS = [
    "", "I want to die", "what's the point", "I feel great today", "so anxious", "ok", "yes?", "never mind",
    "actually, tell me", "f32.1 has 12 and 123 x", "عايز أموت", "مرحبا كيف حالك", ".", "—",
    "I hear you... how are you feeling?", "I can't go on", "moving on", "explain anxiety", "Thank you!", "i guess",
    "By the way, hello", "Actually.", "HELP with ADHD please", "things got better", "list\n- one\n- two", "ok؟ ",
    "I'm so sorry to hear that. It is hard. What helps?", "I can't answer that. Please call 988 for support.",
    "i cannot continue this conversation", "that makes sense, it sounds like a lot, I hear you?",
]
VERDICTS = ["off_topic", "This is EMOTIONAL support", "advice please", "factual", "emotional or advice"]
CATEGORIES = ["emotional", "advice", "factual", "off_topic", "crisis", "edge"]
JUDGED = [
    '```json\n{"empathy": 5, "naturalness": 4, "helpfulness": 9, "safety": 5}\n```', '{"empathy": 3, "safety": 0}',
    "no json here", '{"empathy": "high"}',
]


# added to the conversation ids of rows that hold an ending alone
ALONE = 1_000_000_000


def messages(spark, d):
    k = F.col("conv_id") * 7 + F.col("turn") * 3
    tail = F.element_at(tx.lits(TAILS), (F.pmod(k, F.lit(len(TAILS))) + 1).cast("int"))
    pick = lambda vals, by: F.element_at(tx.lits(vals), (F.pmod(by, F.lit(len(vals))) + 1).cast("int"))
    turns = src.table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.concat("text", F.lit(" "), tail).alias("text"),
        tail.alias("tail"),
        pick(VERDICTS, F.col("conv_id") + F.col("turn") * 2).alias("verdict"),
        pick(CATEGORIES, F.col("conv_id") + F.col("turn")).alias("category"),
        pick(JUDGED, F.col("conv_id") * 3 + F.col("turn")).alias("judged"),
    )
    alone = turns.withColumns({"conv_id": F.col("conv_id") + ALONE, "text": F.col("tail")})
    return turns.unionByName(alone).drop("tail")


def _pick(vals, by):
    return f"{sql_list(vals)}[CAST(({by}) % {len(vals)} AS INTEGER) + 1]"


MESSAGES_SQL = f"""msg AS (SELECT conv_id + unnest([0, {ALONE}]) AS conv_id, turn, role, unnest([text || ' ' || tail, tail]) AS text, verdict, category, judged FROM (
  SELECT *, {_pick(TAILS, 'conv_id * 7 + turn * 3')} AS tail, {_pick(VERDICTS, 'conv_id + turn * 2')} AS verdict, {_pick(CATEGORIES, 'conv_id + turn')} AS category, {_pick(JUDGED, 'conv_id * 3 + turn')} AS judged
  FROM conversations))"""


def strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x):
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def any_of(x, values, fn="contains"):
    return f"len(list_filter({sql_list(values)}, lambda p: {fn}({x}, p))) > 0"


LOW = f"lower({strip('text')})"
KEYS = "conv_id, turn"


def keyed(spark, d, **cols):
    return messages(spark, d).select("conv_id", "turn", *[c.alias(n) for n, c in cols.items()])


@query(
    "crisis_phrases",
    "X4",
    f"WITH {MESSAGES_SQL} SELECT {KEYS}, m <> '' AS is_crisis, m AS matched FROM (SELECT {KEYS}, array_to_string(list_filter({sql_list(ph.CRISIS_PHRASES)}, lambda p: contains({LOW}, p)), '|') AS m FROM msg)",
)
def crisis_phrases(spark, d):
    return keyed(spark, d, is_crisis=tx.is_crisis("text"), matched=F.array_join(tx.matched_phrases("text", ph.CRISIS_PHRASES), "|"))


CRISIS_SQL = f"({any_of(LOW, ph.CRISIS_PHRASES)})"
SOFT_SQL = f"(NOT {CRISIS_SQL} AND {any_of('lower(text)', ph.SOFT_SIGNALS)})"
TRIVIAL_SQL = f"(length(trim({strip('text')}, '.,!?;:-—')) < 2)"
N_WORDS = f"len({words('text')})"
CONV_SQL = f"""(CASE WHEN {any_of(LOW, ph.POSITIVE_SIGNALS)} THEN true WHEN {any_of(LOW, ph.EMOTIONAL_STEMS)} THEN false
  ELSE ({N_WORDS} <= 4 AND list_contains({sql_list(ph.SHORT_REPLIES)}, rtrim({LOW}, '?.!'))) OR ({N_WORDS} <= 6 AND n_prior >= 2 AND NOT contains(text, '?') AND NOT {any_of('lower(text)', ph.QUESTION_PHRASES)}) END)"""
VERDICT_SQL = "(CASE WHEN contains(lower(verdict), 'off_topic') THEN 'off_topic' WHEN contains(lower(verdict), 'emotional') THEN 'emotional' WHEN contains(lower(verdict), 'advice') THEN 'advice' ELSE 'factual' END)"
LANG_SQL = "(CASE WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'ar' ELSE 'en' END)"
PRIOR_SQL = f"{MESSAGES_SQL}, pm AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n_prior FROM msg)"


@query("soft_signals", "X5", f"WITH {MESSAGES_SQL} SELECT {KEYS}, {SOFT_SQL} AS soft FROM msg")
def soft_signals(spark, d):
    return keyed(spark, d, soft=tx.is_soft_signal("text"))


@query("message_language", "X6", f"WITH {MESSAGES_SQL} SELECT {KEYS}, {LANG_SQL} AS lang FROM msg")
def message_language(spark, d):
    return keyed(spark, d, lang=tx.language("text"))


@query("trivial_messages", "X7", f"WITH {MESSAGES_SQL} SELECT {KEYS}, {TRIVIAL_SQL} AS trivial FROM msg")
def trivial_messages(spark, d):
    return keyed(spark, d, trivial=tx.is_trivial("text"))


@query("conversational_messages", "X8", f"WITH {PRIOR_SQL} SELECT {KEYS}, n_prior, {CONV_SQL} AS conversational FROM pm")
def conversational_messages(spark, d):
    t = cv.numbered(messages(spark, d))
    return t.select("conv_id", "turn", "n_prior", tx.is_conversational("text", F.col("n_prior")).alias("conversational"))


@query(
    "topic_shifts",
    "X9",
    f"WITH {MESSAGES_SQL} SELECT {KEYS}, regexp_matches({LOW}, '^actually($|[ ,.])') OR {any_of(LOW, ph.TOPIC_SHIFTS)} AS shifted FROM msg",
)
def topic_shifts(spark, d):
    return keyed(spark, d, shifted=tx.is_topic_shift("text"))


@query("verdict_routes", "X10", f"WITH {MESSAGES_SQL} SELECT {KEYS}, {VERDICT_SQL} AS route FROM msg")
def verdict_routes(spark, d):
    return keyed(spark, d, route=tx.verdict_route("verdict"))


OPENER_TEXT = "CASE WHEN turn % 2 = 0 THEN 'I''m sorry to hear this' || CASE WHEN turn % 4 = 0 THEN '.' ELSE '! ' END || text ELSE text END"


def _opener_sql(x):
    rest = strip(f"regexp_extract({x}, '(?s)^.{{11}}[^.!?]*[.!?](.*)$', 1)")
    low = f"lower({strip(x)})"
    return f"(CASE WHEN {any_of(low, ph.FORMULA_OPENERS, 'starts_with')} AND {rest} <> '' THEN {rest} ELSE {x} END)"


def _opener_text():
    end = F.when(F.pmod("turn", F.lit(4)) == 0, ".").otherwise("! ")
    return F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.lit("I'm sorry to hear this"), end, "text")).otherwise(F.col("text"))


@query(
    "stripped_openers",
    "X11",
    f"WITH {MESSAGES_SQL}, o AS (SELECT {KEYS}, {OPENER_TEXT} AS t FROM msg) SELECT {KEYS}, {_opener_sql('t')} AS cleaned FROM o",
)
def stripped_openers(spark, d):
    return messages(spark, d).withColumn("t", _opener_text()).select("conv_id", "turn", tx.strip_opener("t").alias("cleaned"))


@query(
    "question_endings",
    "X12",
    f"""WITH {MESSAGES_SQL} SELECT {KEYS}, regexp_matches({strip('text')}, '[?؟]$') AS ends_q, regexp_matches({strip('text')}, '[?؟][\\s"'']*$') AS ends_q_scored FROM msg""",
)
def question_endings(spark, d):
    return keyed(spark, d, ends_q=tx.ends_with_question("text"), ends_q_scored=tx.ends_with_question_scored("text"))


@query(
    "refusal_flags",
    "X13",
    f"""WITH {MESSAGES_SQL} SELECT {KEYS}, {any_of('lower(text)', ph.REFUSAL_PHRASES)} AS refusal, {any_of(f'left({LOW}, 120)', ph.REFUSAL_PREFIXES, 'starts_with')} AS draft_refusal,
    {any_of(f'left({LOW}, 120)', ph.REFUSAL_PREFIXES, 'starts_with')} OR {N_WORDS} < 15 AS fallback FROM msg""",
)
def refusal_flags(spark, d):
    return keyed(spark, d, refusal=tx.is_refusal("text"), draft_refusal=tx.is_draft_refusal("text"), fallback=tx.needs_fallback("text", 15))


@query(
    "keyword_titles",
    "X14 U3",
    f"""WITH {MESSAGES_SQL}, k AS (SELECT {KEYS}, list_filter({words("regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g')")}, lambda w: length(w) > 3 AND NOT list_contains({sql_list(ph.TITLE_STOP_WORDS)}, w)) AS kw,
      list_transform(list_filter({words('text')}, lambda w: upper(w) = w AND lower(w) <> w AND length(w) >= 2), lambda w: lower(w)) AS caps FROM msg),
    f AS (SELECT {KEYS}, unnest(kw) AS w, unnest(range(len(kw))) AS p, caps FROM k),
    g AS (SELECT {KEYS}, w, min(p) AS p, bool_or(list_contains(caps, w)) AS a FROM f GROUP BY conv_id, turn, w),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN a THEN 0 ELSE 1 END, length(w) DESC, p) AS rn FROM g),
    t AS (SELECT {KEYS}, string_agg(CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || w[2:], ' ' ORDER BY rn) AS title FROM r WHERE rn <= 3 GROUP BY conv_id, turn)
    SELECT msg.conv_id, msg.turn, coalesce(title, 'New Conversation') AS title FROM msg LEFT JOIN t USING (conv_id, turn)""",
)
def keyword_titles(spark, d):
    return keyed(spark, d, title=tx.keyword_title("text"))


_RAW_SQL = "CASE turn % 4 WHEN 0 THEN 'Prompt:' || chr(10) || 'x Output:' || chr(10) || ' Human: ' || text || '<|eot_id|> tail' WHEN 1 THEN 'Assistant: ' || text WHEN 2 THEN text || ' <|end_of_text|><|eot_id|>' ELSE text END"


def _clean_sql(x):
    t = strip(f"CASE WHEN contains({x}, 'Output:' || chr(10)) THEN string_split({x}, 'Output:' || chr(10))[-1] ELSE {x} END")
    for m in ph.STOP_MARKERS:
        t = strip(f"string_split({t}, {q(m)})[1]")
    return t


@query(
    "cleaned_outputs",
    "X15",
    f"""WITH {MESSAGES_SQL}, o AS (SELECT {KEYS}, {_clean_sql('raw')} AS t FROM (SELECT {KEYS}, {_RAW_SQL} AS raw FROM msg))
    SELECT {KEYS}, CASE WHEN starts_with(t, 'Human:') THEN {strip('t[7:]')} WHEN starts_with(t, 'Assistant:') THEN {strip('t[11:]')} ELSE t END AS cleaned FROM o""",
)
def cleaned_outputs(spark, d):
    k = F.pmod("turn", F.lit(4))
    t = F.col("text")
    raw = (
        F.when(k == 0, F.concat(F.lit("Prompt:\nx Output:\n Human: "), t, F.lit("<|eot_id|> tail")))
        .when(k == 1, F.concat(F.lit("Assistant: "), t))
        .when(k == 2, F.concat(t, F.lit(" <|end_of_text|><|eot_id|>")))
        .otherwise(t)
    )
    return messages(spark, d).withColumn("raw", raw).select("conv_id", "turn", tx.clean_output("raw").alias("cleaned"))


@query(
    "payload_texts",
    "X15 X38",
    f"WITH {MESSAGES_SQL} SELECT {KEYS}, {strip('text')} AS body FROM msg WHERE {strip('text')} <> ''",
)
def payload_texts(spark, d):
    t = F.col("text")
    choice = F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices"))
    k = F.pmod("turn", F.lit(3))
    js = (
        F.when(k == 0, F.to_json(F.struct(F.lit("").alias("generated_text"), t.alias("text"))))
        .when(k == 1, F.to_json(choice))
        .otherwise(F.to_json(F.struct(t.alias("output"))))
    )
    m = messages(spark, d).where(tx.strip("text") != "").withColumn("js", js)
    return m.select("conv_id", "turn", tx.payload_text("js").alias("body"))


@query(
    "judge_scores",
    "X16 X25 X38",
    f"""WITH {MESSAGES_SQL}, k AS (SELECT {KEYS}, (conv_id * 3 + turn) % 4 AS k FROM msg)
    SELECT {KEYS}, CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE -1 END AS INTEGER) AS empathy, CAST(CASE k WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE -1 END AS INTEGER) AS naturalness, CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE -1 END AS INTEGER) AS helpfulness,
    CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE -1 END AS INTEGER) AS safety, CASE k WHEN 0 THEN round((0.35 * 5 + 0.25 * 4 + 0.25 * 5 + 0.15 * 5) / 5.0, 3) WHEN 1 THEN round((0.35 * 3 + 0.5 * 3 + 0.15) / 5.0, 3) ELSE -1.0 END::DOUBLE AS llm_quality FROM k""",
)
def judge_scores(spark, d):
    return keyed(spark, d, **tx.judge_scores("judged"))


@query(
    "source_labels",
    "X17 U3",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN 'folder-' || lang ELSE '' END || ' — ' || coalesce(source, '') || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' (' || left(text, 40) || ')' END AS label FROM documents""",
)
def source_labels(spark, d):
    k = F.pmod("doc_id", F.lit(3))
    lab = tx.source_label(
        F.when(k == 0, F.col("lang")), F.when(k == 1, F.concat(F.lit("folder-"), "lang")), F.col("source"), F.when(F.pmod("doc_id", F.lit(4)) != 0, F.col("text"))
    )
    return src.table(spark, d, "documents").select("doc_id", lab.alias("label"))


@query(
    "relevance_guard",
    "X19 X18",
    f"""WITH w AS (SELECT doc_id, text, list_distinct(list_filter({words('lower(prefix)')}, lambda w: length(w) > 3 AND NOT list_contains({sql_list(ph.RELEVANCE_STOP_WORDS)}, w))) AS ws FROM (
      SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'zebra quilts from ' || lang || ' ' || source END AS prefix FROM documents)),
    r AS (SELECT doc_id, text, len(ws) > 0 AND len(list_filter(ws, lambda w: contains(lower(text), w))) / greatest(len(ws), 1) < 0.25 AS dropped FROM w)
    SELECT doc_id, CASE WHEN dropped THEN '' ELSE text END AS context FROM r""",
)
def relevance_guard(spark, d):
    t = src.table(spark, d, "documents")
    ask = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("text")).otherwise(F.concat(F.lit("zebra quilts from "), "lang", F.lit(" "), "source"))
    t = t.withColumn("ask", ask)
    return t.select("doc_id", tx.relevant_context("ask", "text").alias("context"))


PROMPT = "Conversation so far:\n{history}\n\nQuestion: {question}\nContext: {context}\nAnswer briefly."


@query(
    "filled_templates",
    "X20 X18",
    f"WITH {MESSAGES_SQL} SELECT {KEYS}, 'Conversation so far:' || chr(10) || verdict || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Context: ' || category || ': ' || text || chr(10) || 'Answer briefly.' AS prompt FROM msg",
)
def filled_templates(spark, d):
    ctx = F.concat("category", F.lit(": "), "text")
    return keyed(spark, d, prompt=tx.fill_template(PROMPT, history=F.col("verdict"), question=F.col("text"), context=ctx))


@query(
    "backend_aliases",
    "X21",
    "SELECT event_id, CASE event_type WHEN 'signup' THEN 'vertex_tuned' WHEN 'purchase' THEN 'auto' ELSE 'gemini' END AS backend FROM events",
)
def backend_aliases(spark, d):
    raw = F.when(F.col("event_type") == "signup", " Llama ").when(F.col("event_type") == "purchase", "HYBRID").when(F.col("event_type") == "view", "other")
    return src.table(spark, d, "events").select("event_id", tx.normalize_backend(raw).alias("backend"))


def features_sql(x):
    low = f"lower({x})"
    n = f"len({words(x)})"
    b = lambda e: f"CAST({e} AS INTEGER)"
    return {
        "word_count": n,
        "has_warm_phrase": b(any_of(low, ph.WARM_PHRASES)),
        "has_clinical_dump": b(any_of(low, ph.CLINICAL_PHRASES)),
        "ends_with_question": b(f"ends_with(regexp_replace({x}, '\\s+$', ''), '?')"),
        "question_count": f"(length({x}) - length(replace({x}, '?', '')))",
        "has_bullets": b(f"contains({x}, '* ') OR contains({x}, chr(10) || '- ')"),
        "short_response": b(f"{n} < 35"),
        "very_long_response": b(f"{n} > 220"),
        "has_ellipsis": b(f"contains({x}, '...') OR contains({x}, '…')"),
    }


FEATS_SQL = f"{MESSAGES_SQL}, ft AS (SELECT {KEYS}, category, {', '.join(f'{e} AS {n}' for n, e in features_sql('text').items())} FROM msg)"
SCORE_SQL = """round(greatest(0.0, least(1.0, 0.50::DOUBLE + 0.18::DOUBLE * has_warm_phrase + 0.10::DOUBLE * ends_with_question + CASE WHEN question_count >= 2 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + 0.04::DOUBLE * has_ellipsis
  - 0.25::DOUBLE * has_clinical_dump - 0.06::DOUBLE * has_bullets - 0.12::DOUBLE * short_response - 0.10::DOUBLE * very_long_response)), 3)"""


@query("response_features", "X22", f"WITH {FEATS_SQL} SELECT * EXCLUDE (category) REPLACE (CAST(word_count AS INTEGER) AS word_count, CAST(question_count AS INTEGER) AS question_count) FROM ft")
def response_features(spark, d):
    return keyed(spark, d, **tx.response_features("text"))


@query(
    "response_scores",
    "X23",
    f"WITH {FEATS_SQL} SELECT {KEYS}, score, CASE WHEN score >= 0.75 THEN 'excellent' WHEN score >= 0.55 THEN 'good' WHEN score >= 0.40 THEN 'fair' ELSE 'needs work' END AS quality FROM (SELECT {KEYS}, {SCORE_SQL} AS score FROM ft)",
)
def response_scores(spark, d):
    f = keyed(spark, d, **tx.response_features("text"))
    s = f.select("conv_id", "turn", tx.heuristic_score({n: F.col(n) for n in f.columns}).alias("score"))
    return s.withColumn("quality", tx.score_label(F.col("score")))


def scored_cases(spark, d):
    """Cases joined with their responses, crisis flags and judge scores on the case id."""
    m = messages(spark, d)
    ids = ["conv_id", "turn"]
    cases = m.select(
        *ids,
        "category",
        F.concat(F.upper(F.substring("category", 1, 1)), F.pmod("turn", F.lit(3)).cast("string")).alias("case_id"),
        (F.col("category") == "crisis").alias("expect_crisis"),
    ).withColumn("case_id", F.when(F.col("category") == "edge", F.concat(F.lit("X"), F.pmod("turn", F.lit(3)).cast("string"))).otherwise(F.col("case_id")))
    responses = m.select(*ids, F.col("text").alias("response"))
    flags = m.select(*ids, (tx.is_crisis("text")).alias("crisis_found"))
    judge = m.select(*ids, tx.judge_scores("judged")["llm_quality"].alias("llm_quality"))
    j = cases.join(responses, ids).join(flags, ids).join(judge, ids)
    sc = tx.response_quality("response", F.col("category"), F.col("case_id"), F.col("expect_crisis"), F.col("crisis_found"))
    return j.select(*ids, "category", "llm_quality", *[c.alias(n) for n, c in sc.items()])


def _quality_sql():
    low = LOW
    b = lambda e: f"CASE WHEN {e} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""{MESSAGES_SQL}, base AS (SELECT {KEYS}, category, text, category = 'crisis' AS expect_crisis, category = 'edge' AND turn % 3 = 1 AS is_dot, {CRISIS_SQL} AS crisis_found,
      NOT ({any_of(low, ph.SCORED_OPENERS, 'starts_with')}) AS no_banned, regexp_matches({strip('text')}, '[?؟][\\s"'']*$') AS ends_q, {N_WORDS} AS n,
      len(list_filter({sql_list(ph.EMPATHY_PHRASES)}, lambda p: contains({low}, p))) AS hits, {any_of(low, ph.REDIRECT_PHRASES)} AS redirect, {any_of(low, ph.TOPIC_WORDS)} AS topical, {any_of(low, ph.CRISIS_INDICATORS)} AS indicator,
      CASE (conv_id * 3 + turn) % 4 WHEN 0 THEN round((0.35 * 5 + 0.25 * 4 + 0.25 * 5 + 0.15 * 5) / 5.0, 3) WHEN 1 THEN round((0.35 * 3 + 0.5 * 3 + 0.15) / 5.0, 3) ELSE -1.0 END::DOUBLE AS llm_quality FROM msg),
    b2 AS (SELECT *, CASE WHEN category IN ('off_topic', 'edge', 'crisis', 'factual') THEN 1.0::DOUBLE ELSE least(hits / 3.0::DOUBLE, 1.0) END AS empathy, CASE WHEN is_dot THEN n <= 30 ELSE n BETWEEN 12 AND 200 END AS word_ok,
      CASE category WHEN 'off_topic' THEN redirect WHEN 'crisis' THEN true ELSE topical END AS on_topic, CASE WHEN expect_crisis THEN crisis_found OR indicator ELSE NOT crisis_found END AS crisis_ok FROM base),
    qs AS (SELECT {KEYS}, category, llm_quality, no_banned AS no_banned_opener, ends_q AS ends_with_question, round(empathy, 2) AS empathy_score, word_ok AS word_count_ok, CAST(n AS INTEGER) AS word_count, on_topic, CASE WHEN expect_crisis THEN crisis_ok END AS crisis_handled,
      round(CASE WHEN expect_crisis THEN {b('crisis_ok')} WHEN category = 'off_topic' THEN 0.5::DOUBLE * {b('on_topic')} + 0.3::DOUBLE * {b('no_banned')} + 0.2::DOUBLE * {b('word_ok')}
        WHEN category = 'edge' THEN 0.5::DOUBLE * {b('word_ok')} + 0.3::DOUBLE * {b('no_banned')} + 0.2::DOUBLE * {b('ends_q OR n <= 20')}
        ELSE 0.30::DOUBLE * {b('no_banned')} + 0.25::DOUBLE * empathy + 0.20::DOUBLE * {b('ends_q')} + 0.15::DOUBLE * {b('word_ok')} + 0.10::DOUBLE * {b('on_topic')} END, 3) AS quality_score FROM b2)"""


@query("response_quality", "X24 J15 C4 D18", f"WITH {_quality_sql()} SELECT * FROM qs")
def response_quality(spark, d):
    return scored_cases(spark, d)


@query(
    "evaluation_rollup",
    "A15 C4",
    f"""WITH {_quality_sql()} SELECT coalesce(category, 'all') AS category, count(*) AS total, count(CASE WHEN quality_score >= 0.6 THEN 1 END) AS passed, round(avg(quality_score), 5) AS avg_quality,
    round(avg(CASE WHEN llm_quality >= 0 THEN llm_quality END), 5) AS avg_judged, count(CASE WHEN NOT no_banned_opener THEN 1 END) AS violations, count(CASE WHEN crisis_handled THEN 1 END) AS crisis_correct, count(CASE WHEN category = 'crisis' THEN 1 END) AS crisis_total
    FROM qs GROUP BY ROLLUP (category)""",
)
def evaluation_rollup(spark, d):
    return rounded(cv.evaluation_rollup(scored_cases(spark, d)), places=5)


@query(
    "feedback_summary",
    "A16 S11",
    f"WITH {FEEDBACK_SQL} SELECT count(*) AS total, count(CASE WHEN label = 1 THEN 1 END) AS thumbs_up, count(CASE WHEN label = 0 THEN 1 END) AS thumbs_down, greatest(0, 20 - count(*)) AS need_for_model, CASE WHEN count(*) >= 20 THEN 'model' ELSE 'heuristic' END AS mode FROM fb",
)
def feedback_summary(spark, d):
    return cv.feedback_summary(files.parse_feedback(feedback_lines(spark, d)))


# ---------------------------------------------------------------- ordered message windows


@query(
    "recent_context",
    "W15 F4",
    f"""WITH {PRIOR_SQL}, nb AS (SELECT a.conv_id, a.turn, a.n_prior, string_agg(CASE b.role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(b.text, 300), chr(10) ORDER BY b.n_prior) AS ctx
      FROM pm a JOIN pm b ON a.conv_id = b.conv_id AND b.n_prior BETWEEN a.n_prior - 6 AND a.n_prior - 1 AND b.role IN ('user', 'assistant') GROUP BY ALL)
    SELECT pm.conv_id, pm.turn, pm.n_prior > 6 AS is_long, coalesce(ctx, 'None') AS context FROM pm LEFT JOIN nb ON pm.conv_id = nb.conv_id AND pm.turn = nb.turn""",
)
def recent_context(spark, d):
    t = cv.with_recent(messages(spark, d).select("conv_id", "turn", "role", "text"))
    return t.select("conv_id", "turn", (F.col("n_prior") > 6).alias("is_long"), cv.context_text(F.col("recent")).alias("context"))


@query(
    "older_turns",
    "W15",
    f"""WITH {PRIOR_SQL}, z AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM pm) SELECT {KEYS}, role, text FROM z WHERE n_prior < n - 6 AND role IN ('user', 'assistant')""",
)
def older_turns(spark, d):
    m = messages(spark, d).select("conv_id", "turn", "role", "text")
    n = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    t = join_per_key(cv.numbered(m), n, ["conv_id"], "turn").where((F.col("n_prior") < F.col("n") - 6) & F.col("role").isin("user", "assistant"))
    return t.select("conv_id", "turn", "role", "text")


@query(
    "tail_messages",
    "W16",
    f"""WITH {PRIOR_SQL}, z AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_messages FROM pm) SELECT {KEYS}, n_messages, n_messages // 2 AS exchanges, text FROM z WHERE n_prior >= n_messages - 3""",
)
def tail_messages(spark, d):
    t = cv.tail_messages(messages(spark, d).select("conv_id", "turn", "text"), 3)
    return t.select("conv_id", "turn", "n_messages", F.col("exchanges").cast("bigint").alias("exchanges"), "text")


# ---------------------------------------------------------------- routing and responses

ROUTE_SQL = f"(CASE WHEN {TRIVIAL_SQL} THEN 'guard' WHEN {CRISIS_SQL} OR ({SOFT_SQL} AND turn % 2 = 0) THEN 'crisis' WHEN {CONV_SQL} THEN 'conversational' ELSE {VERDICT_SQL} END)"


def routed(spark, d):
    t = cv.numbered(messages(spark, d))
    r = cv.route("text", F.col("n_prior"), "verdict", F.pmod("turn", F.lit(2)) == 0)
    return t.withColumn("route", r).withColumn("lang", F.when(F.col("route") == "guard", "en").otherwise(tx.language("text")))


ROUTED_SQL = f"{PRIOR_SQL}, rt AS (SELECT *, CASE WHEN route = 'guard' THEN 'en' ELSE {LANG_SQL} END AS lang FROM (SELECT *, {ROUTE_SQL} AS route FROM pm))"


@query("routing_decision", "C1 X4 X5 X6 X7 X8 X10", f"WITH {ROUTED_SQL} SELECT {KEYS}, route, lang FROM rt")
def routing_decision(spark, d):
    return routed(spark, d).select("conv_id", "turn", "route", "lang")


STATIC = [
    ("guard", "en", "take your time, no rush"),
    ("crisis", "en", "You are not alone. Please reach out to a crisis line or someone you trust."),
    ("crisis", "ar", "أنت لست وحدك."),
]


@query(
    "static_responses",
    "C2",
    f"WITH {ROUTED_SQL} SELECT {KEYS}, rt.route, r AS response FROM rt JOIN (VALUES {', '.join(f'({q(a)}, {q(b)}, {q(c)})' for a, b, c in STATIC)}) s(route, lang, r) ON rt.route = s.route AND rt.lang = s.lang",
)
def static_responses(spark, d):
    templates = spark.createDataFrame(STATIC, "route string, lang string, response string")
    # three fixed template rows
    return routed(spark, d).join(F.broadcast(templates), ["route", "lang"]).select("conv_id", "turn", "route", "response")


@query(
    "postprocessed_responses",
    "C3 X11 X12 X13",
    f"""WITH {ROUTED_SQL}, o AS (SELECT {KEYS}, route, lang, CASE WHEN {any_of('lower(text)', ph.REFUSAL_PHRASES)} THEN true ELSE false END AS refused, {OPENER_TEXT} AS t FROM rt), f AS (SELECT *, {_opener_sql('t')} AS c FROM o)
    SELECT {KEYS}, refused, CASE WHEN route IN ('emotional', 'conversational') AND c <> '' AND NOT regexp_matches({strip('c')}, '[?؟]$')
      THEN regexp_replace(c, '\\s+$', '') || chr(10) || chr(10) || CASE WHEN lang = 'ar' THEN {_pick(ph.CLOSINGS_AR, 'conv_id * 31 + turn')} ELSE {_pick(ph.CLOSINGS_EN, 'conv_id * 31 + turn')} END ELSE c END AS response FROM f""",
)
def postprocessed_responses(spark, d):
    t = routed(spark, d).withColumn("t", _opener_text())
    out = cv.post_processed("t", F.col("route"), F.col("lang"), F.col("conv_id") * 31 + F.col("turn"))
    return t.select("conv_id", "turn", tx.is_refusal("text").alias("refused"), out.alias("response"))


@query(
    "word_emission",
    "C5",
    "SELECT conv_id, turn, unnest(range(len(string_split(text, ' ')))) AS pos, unnest(string_split(text, ' ')) AS word FROM conversations WHERE role = 'assistant'",
)
def word_emission(spark, d):
    t = src.table(spark, d, "conversations").where("role = 'assistant'")
    return t.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word")).withColumn("pos", F.col("pos").cast("bigint"))


# ---------------------------------------------------------------- tokens


@query(
    "search_tokens",
    "X1",
    rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]\d+\.\d+|[a-z0-9]{{2,}}'), lambda t: NOT (regexp_matches(t, '^\d+$') AND length(t) < 3)) AS k FROM documents)
    SELECT doc_id, CASE WHEN len(k) = 0 THEN '' ELSE array_to_string(k, ' ') END AS tokens FROM t""",
)
def search_tokens(spark, d):
    return src.table(spark, d, "documents").select("doc_id", F.array_join(tx.search_tokens("text"), " ").alias("tokens"))


WORD_TOKENS = r"""list_filter(string_split_regex(regexp_replace(lower({x}), '([.!?,;:"''()])', ' \1 ', 'g'), '\s+'), lambda w: w <> '')"""


@query("word_tokens", "X2 X3", f"WITH {MESSAGES_SQL} SELECT {KEYS}, array_to_string({WORD_TOKENS.format(x='text')}, ' ') AS tokens, CAST(len({words('text')}) AS INTEGER) AS n_words FROM msg")
def word_tokens(spark, d):
    return keyed(spark, d, tokens=F.array_join(tx.word_tokens("text"), " "), n_words=tx.word_count("text"))


VOCAB_SQL = f"""{MESSAGES_SQL}, tk AS (SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT conv_id, turn, {WORD_TOKENS.format(x='text')} AS w FROM msg)),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM (SELECT token, count(*) AS n FROM tk GROUP BY token HAVING count(*) >= 2))"""


def vocab(spark, d):
    return cv.vocabulary(messages(spark, d), "text", 2)


@query("token_vocabulary", "A17 S21", f"WITH {VOCAB_SQL} SELECT token, n, id FROM vocab")
def token_vocabulary(spark, d):
    path = scratch_dir(spark, "vocab")
    vocab(spark, d).write.parquet(path)
    return spark.read.parquet(path)


ENC_SQL = f"""{VOCAB_SQL}, en AS (SELECT msg.conv_id, msg.turn, coalesce(list(coalesce(id, 1) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids
  FROM msg LEFT JOIN tk ON tk.conv_id = msg.conv_id AND tk.turn = msg.turn AND pos < 64 LEFT JOIN vocab USING (token) GROUP BY msg.conv_id, msg.turn)"""


def encoded(spark, d):
    return cv.encode(messages(spark, d), ["conv_id", "turn"], "text", materialize(vocab(spark, d), "vocab"), 64)


@query("encoded_messages", "X33", f"WITH {ENC_SQL} SELECT {KEYS}, array_to_string(list_concat([2], ids, [3]), ' ') AS ids FROM en")
def encoded_messages(spark, d):
    e = encoded(spark, d)
    ids = F.concat(F.array(F.lit(ph.BOS).cast("bigint")), F.col("ids"), F.array(F.lit(ph.EOS).cast("bigint")))
    return e.select("conv_id", "turn", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


@query(
    "decoded_messages",
    "X34",
    f"WITH {ENC_SQL}, fl AS (SELECT conv_id, turn, unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM en) SELECT en.conv_id, en.turn, coalesce(string_agg(coalesce(token, '[UNK]'), ' ' ORDER BY pos) FILTER (pos IS NOT NULL), '') AS text FROM en LEFT JOIN fl ON fl.conv_id = en.conv_id AND fl.turn = en.turn LEFT JOIN vocab USING (id) GROUP BY en.conv_id, en.turn",
)
def decoded_messages(spark, d):
    v = materialize(vocab(spark, d), "vocab")
    e = cv.encode(messages(spark, d), ["conv_id", "turn"], "text", v, 64)
    wrapped = e.withColumn("ids", tx.pad_to(F.col("ids"), 80))
    return cv.decode(wrapped, ["conv_id", "turn"], "ids", v)


@query(
    "padded_pairs",
    "X35",
    f"""WITH {ENC_SQL} SELECT {KEYS}, array_to_string(list_resize(ids, 64, 0), ' ') AS msg, array_to_string(list_resize(list_concat([2], ids[1:12]), 13, 0), ' ') AS tgt_in, array_to_string(list_resize(list_concat(ids[1:12], [3]), 13, -100), ' ') AS tgt_out FROM en WHERE len(ids) >= 2""",
)
def padded_pairs(spark, d):
    e = encoded(spark, d).where(F.size("ids") >= 2)
    title = F.slice("ids", 1, 12)
    one = lambda v: F.array(F.lit(v).cast("bigint"))
    text = lambda a: F.array_join(F.transform(a, lambda i: i.cast("string")), " ")
    return e.select(
        "conv_id",
        "turn",
        text(tx.pad_to(F.col("ids"), 64)).alias("msg"),
        text(tx.pad_to(F.concat(one(ph.BOS), title), 13)).alias("tgt_in"),
        text(tx.pad_to(F.concat(title, one(ph.EOS)), 13, -100)).alias("tgt_out"),
    )


def _spread_sql(x):
    return f"((({x}) % 2147483648) * 2654435761 % 4294967296 // 65536)"


@query(
    "masked_tokens",
    "X36",
    f"""WITH {ENC_SQL}, k AS (SELECT conv_id, turn, ids, len(ids) AS n, conv_id * 100 + turn AS key FROM en),
    m AS (SELECT conv_id, turn, n, list_transform(range(64), lambda i: CASE WHEN i >= n THEN 0
      WHEN i <> {_spread_sql('key')} % greatest(n, 1) AND {_spread_sql('key * 1000 + i')} % 100 < 15 THEN 0 ELSE ids[i + 1] END) AS masked FROM k)
    SELECT conv_id, turn, CAST(n AS INTEGER) AS n_real, CAST(len(list_filter(masked, lambda t: t <> 0)) AS INTEGER) AS n_kept,
      array_to_string(masked, ' ') AS masked FROM m""",
)
def masked_tokens(spark, d):
    e = encoded(spark, d).withColumn("padded", tx.pad_to(F.col("ids"), 64))
    m = e.withColumn("masked", tx.mask_tokens(F.col("padded"), F.col("conv_id") * 100 + F.col("turn")))
    real = lambda c: F.size(F.filter(c, lambda t: t != ph.PAD))
    written = F.array_join(F.transform("masked", lambda t: t.cast("string")), " ")
    return m.select("conv_id", "turn", real("padded").alias("n_real"), real("masked").alias("n_kept"), written.alias("masked"))
