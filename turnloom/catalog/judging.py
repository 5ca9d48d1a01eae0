"""Queries over prompts, judging, preferences and generation."""

from functools import reduce

from pyspark.sql import functions as F

from turnloom.catalog.corpus import TOKENS, examples_sql, lead_sql
from turnloom.catalog.registry import AS_QUESTIONS, LEXICAL, SENTENCES, TURNS, WORDS, as_questions, query, table, turns
from turnloom.catalog.statistics import rounded
from turnloom.catalog.texts import ASKED
from turnloom.functions import dialogue as dg
from turnloom.functions import text as tx
from turnloom.operators import judging as jd
from turnloom.operators import preferences as pf
from turnloom.operators import rubrics as rb
from turnloom.operators import turns as tn
from turnloom.plans import evaluation as ev
from turnloom.plans import generation as gn
from turnloom.session import fresh_dir
from turnloom.sources import sinks

big = lambda c: c.cast("bigint")


def judged_inputs(spark, d):
    """Turns as judge inputs: text, source as paper; gold releases are unknown."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("sc_intro"))
    rows = table(spark, d, "conversations").join(docs, "conv_id")
    return rows.select(
        F.concat_ws("/", "conv_id", "turn").alias("row_id"), F.col("role").alias("system"), F.col("text").alias("conversation"),
        F.col("text").alias("parsed_pr_article"), "sc_intro",
    )


INPUTS = "inp AS (SELECT c.conv_id || '/' || c.turn AS row_id, c.role AS system, c.text AS conversation, c.text AS parsed_pr_article, d.source AS sc_intro FROM conversations c JOIN documents d ON c.conv_id = d.doc_id)"
KNOWN = ("conversation", "parsed_pr_article", "sc_intro")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def prompt_sql(rubrics, sep: str = ": ") -> str:
    parts = []
    for r in rubrics:
        blocks = "".join(f" || chr(10) || chr(10) || {quoted(label + sep)} || {c if c in KNOWN else quoted('None')}" for label, c in r.inputs)
        parts.append(f"SELECT row_id, system, '{r.subject}' AS subject, '{r.aspect}' AS aspect, {quoted(r.instruction)}{blocks} AS prompt FROM inp")
    return "pr AS (" + " UNION ALL ".join(parts) + ")"


@query("rubric_prompts", f"WITH {INPUTS}, {prompt_sql(rb.RUBRICS)} SELECT row_id, subject, aspect, md5(prompt) AS prompt_md5 FROM pr")
def rubric_prompts(spark, d):
    out = jd.build_prompts(judged_inputs(spark, d), rb.RUBRICS, ["row_id"])
    return out.select("row_id", "subject", "aspect", F.md5("prompt").alias("prompt_md5"))


@query("dialogue_prompts", f"WITH {INPUTS}, {prompt_sql(rb.dialogue_prompts(), ':' + chr(10))} SELECT row_id, aspect, md5(prompt) AS prompt_md5 FROM pr")
def dialogue_prompts(spark, d):
    out = jd.build_prompts(judged_inputs(spark, d), rb.dialogue_prompts(), ["row_id"], ":\n")
    return out.select("row_id", "aspect", F.md5("prompt").alias("prompt_md5"))


N_WORDS = f"len({WORDS.format('prompt')})"
POINTS = f"CASE WHEN {N_WORDS} < 50 THEN 1 WHEN {N_WORDS} < 150 THEN 2 ELSE 3 END"


@query("judge_scores", f"""
WITH {INPUTS}, {prompt_sql(rb.RUBRICS)} SELECT row_id, system, subject, aspect, CAST({POINTS} AS BIGINT) AS score, {N_WORDS} || ' words' AS reasons, true AS parse_ok FROM pr""")
def judge_scores(spark, d):
    out = jd.judge(judged_inputs(spark, d), rb.RUBRICS, "rule")
    return out.select("row_id", "system", "subject", "aspect", big(F.col("score")).alias("score"), "reasons", "parse_ok")


@query("resumed_judging", f"""
WITH {INPUTS}, {prompt_sql(rb.RUBRICS)} SELECT row_id, system, subject, aspect, system = 'user' AS was_stored, CAST({POINTS} AS INT) AS score FROM pr""")
def resumed_judging(spark, d):
    inputs = judged_inputs(spark, d)
    path = fresh_dir(spark, "scores")
    stored = sinks.append_scores(jd.judge(inputs.where("system = 'user'"), rb.RUBRICS, "rule"), path)
    fresh = jd.judge(inputs, rb.RUBRICS, "rule", cache=stored)
    both = stored.withColumn("was_stored", F.lit(True)).unionByName(fresh.withColumn("was_stored", F.lit(False)))
    return both.select("row_id", "system", "subject", "aspect", "was_stored", "score")


@query("evaluated_systems", f"""
WITH {INPUTS}, {prompt_sql(rb.RUBRICS)}, s AS (SELECT *, {POINTS} AS score FROM pr)
SELECT system, subject, aspect, count(*) AS n_rows, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, 0::BIGINT AS n_asked_again FROM s GROUP BY ALL""")
def evaluated_systems(spark, d):
    """A first run judges two systems, a second one the third, a last one finds all stored and would fail if it asked."""
    inputs = judged_inputs(spark, d)
    of = lambda *names: {n: inputs.where(F.col("system") == n).drop("system") for n in names}
    folder = fresh_dir(spark, "scores")
    ev.evaluate_systems(of("user", "system"), rb.RUBRICS, "rule", folder)
    ev.evaluate_systems(of("user", "system", "assistant"), rb.RUBRICS, "rule", folder)
    never = lambda prompt: F.raise_error(F.concat(F.lit("judged again: "), prompt)).cast("string")
    scores = ev.evaluate_systems(of("user", "system", "assistant"), rb.RUBRICS, "rule", folder, model=never)
    counted = scores.groupBy("system", "subject", "aspect").agg(F.count_if(F.col("reply_error").isNotNull()).alias("n_asked_again"))
    spread = ev.metric_spread(scores, "score", ("system", "subject", "aspect")).join(counted, ["system", "subject", "aspect"])
    return rounded(spread, "mean", "std")


@query("length_gated_judging", f"""
WITH {INPUTS}, {prompt_sql(rb.RUBRICS)}, n AS (SELECT *, CAST(len({TOKENS.format("prompt[strpos(prompt, chr(10) || chr(10)) + 2:]")}) AS BIGINT) AS n_tokens FROM pr)
SELECT row_id, subject, aspect, n_tokens, n_tokens >= 120 AS skipped_too_long, CASE WHEN n_tokens < 120 THEN CAST({POINTS} AS BIGINT) END AS score FROM n""")
def length_gated_judging(spark, d):
    out = jd.gated_judge(judged_inputs(spark, d), rb.RUBRICS, 120)
    return out.select("row_id", "subject", "aspect", big(F.col("n_tokens")).alias("n_tokens"), "skipped_too_long", big(F.col("score")).alias("score"))


ASPECTS = ", ".join(f"('{r.aspect}', {len(r.instruction.split()) - 6})" for r in rb.QUESTION_RUBRICS)


@query("question_judging", f"""
WITH {TURNS}, q AS (SELECT conv_id, turn, {ASKED} AS qs FROM turns WHERE author = 'Journalist'), a(aspect, least) AS (VALUES {ASPECTS}),
s AS (SELECT *, list_filter(qs, lambda x: len({WORDS.format('x')}) > least) AS good FROM q, a)
SELECT conv_id, turn, aspect, CAST(len(qs) AS BIGINT) AS n_questions, md5(array_to_string(good, '|')) AS good_md5, round(coalesce(len(good) / nullif(len(qs), 0), 0), 6) AS score FROM s""")
def question_judging(spark, d):
    rows = turns(spark, d).where("author = 'Journalist'").select("conv_id", "turn", as_questions("text").alias("journalist_text"))
    out = jd.judge_questions(rows, rb.QUESTION_RUBRICS, ["conv_id", "turn"])
    good = F.md5(F.array_join("reasons.good_questions", "|")).alias("good_md5")
    out = out.select("conv_id", "turn", "aspect", big(F.size("reasons.all_questions")).alias("n_questions"), good, "score")
    return rounded(out, "score")


QUALITY = f"""rated AS (SELECT conv_id, turn, role, CAST(len({WORDS.format('text')}) < 12 AS INT) AS is_vague,
  list_distinct(list_filter({LEXICAL.format('text')}, lambda t: len(t) >= 12)) AS hard FROM conversations)"""


@query("answer_quality", f"WITH {QUALITY} SELECT conv_id, turn, is_vague, CAST(len(hard) AS BIGINT) AS n_complex FROM rated")
def answer_quality(spark, d):
    out = pf.rate_answers(table(spark, d, "conversations"), "text")
    return out.select("conv_id", "turn", "is_vague", big(F.size("complex_aspects")).alias("n_complex"))


@query("quality_shares", f"""
WITH {QUALITY} SELECT role, round(avg(CAST(is_vague = 0 AS INT)), 6) AS clear_share, round(avg(CAST(len(hard) > 0 AS INT)), 6) AS complex_share, count(*) AS n_rows FROM rated GROUP BY 1""")
def quality_shares(spark, d):
    out = jd.flag_ratios(pf.rate_answers(table(spark, d, "conversations"), "text"), ["role"])
    return rounded(out, "clear_share", "complex_share")


LEFT, RIGHT = pf.COMPLEX.split("{}")


@query("follow_up_instructions", f"""
WITH {QUALITY}, o AS (SELECT *, list_transform(list_filter(list_transform(hard, lambda h: h), lambda h: true), lambda h: h) AS hs FROM rated)
SELECT conv_id, turn, CASE WHEN len(hs) > 0 THEN 'complex' WHEN is_vague = 1 THEN 'vague' ELSE 'clear' END AS fixed, CASE WHEN len(hs) > 0 THEN 'complex' ELSE 'clear' END AS compat FROM o""")
def follow_up_instructions(spark, d):
    rated = pf.rate_answers(table(spark, d, "conversations"), "text")
    kind = lambda c: F.when(c == pf.VAGUE, "vague").when(c == pf.CLEAR, "clear").otherwise("complex")
    ask = lambda compat: pf.follow_up_instruction(F.col("is_vague"), F.col("complex_aspects"), compat)
    return rated.select("conv_id", "turn", kind(ask(False)).alias("fixed"), kind(ask(True)).alias("compat"))


def asked_sql(instruction: str) -> str:
    return f"md5({instruction} || chr(10) || chr(10) || content)"


@query("preference_pairs", f"""
WITH {TURNS}, {examples_sql('Journalist', 1000)}, l AS (SELECT conv_id, i, tx[h.k[-1] + 1] AS answer, list_transform(h.k, lambda j: {{'role': CASE WHEN au[j + 1] = 'Journalist' THEN 'assistant' ELSE 'user' END, 'content': tx[j + 1]}}) AS hist
  FROM p WHERE len(h.k) > 0 AND au[h.k[-1] + 1] <> 'Journalist'),
rt AS (SELECT *, CAST(len({WORDS.format('answer')}) < 12 AS INT) AS is_vague, list_distinct(list_filter({LEXICAL.format('answer')}, lambda t: len(t) >= 12)) AS hard_set,
  list_filter({LEXICAL.format('answer')}, lambda t: len(t) >= 12) AS hard FROM l),
c AS (SELECT rt.*, list_filter(hard, lambda t, k: list_position(hard, t) = k) AS hs, '[PAPER]:' || chr(10) || chr(10) || d.text || chr(10) || chr(10) || '[CONVERSATION HISTORY]:' || chr(10) || to_json(hist) AS content
  FROM rt JOIN documents d ON rt.conv_id = d.doc_id)
SELECT conv_id, CAST(i AS BIGINT) AS example, CASE WHEN len(hs) > 0 THEN {asked_sql(f"'{LEFT}' || array_to_string(hs, ', ') || '{RIGHT}'")} WHEN is_vague = 1 THEN {asked_sql(f"'{pf.VAGUE}'")} ELSE {asked_sql(f"'{pf.CLEAR}'")} END AS chosen_md5,
  {asked_sql(f"'{pf.GENERIC}'")} AS rejected_md5, is_vague, CAST(len(hs) AS BIGINT) AS n_complex FROM c""")
def preference_pairs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "source", F.col("text").alias("paper"))
    ex = tn.turn_examples(turns(spark, d), "Journalist").join(docs, "conv_id")
    chat = dg.chat("Journalist", F.col("source"), F.col("paper"), F.col("prompt"))
    rows = ex.select("conv_id", "example", chat.alias("prompt"))
    out = pf.preference_pairs(rows, generator=lambda p: F.md5(p), keep=("conv_id", "example"))
    return out.select(
        "conv_id", big(F.col("example")).alias("example"), F.col("chosen").alias("chosen_md5"), F.col("rejected").alias("rejected_md5"),
        "is_vague", big(F.size("complex_aspects")).alias("n_complex"),
    )


PAPERS = f"""pa AS (SELECT doc_id AS paper_id, source AS paper_title, text, {SENTENCES.format('text')} AS ss, len({TOKENS.format('text')}) AS n FROM documents)"""


def papers(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("paper_title"), F.col("text").alias("paper_text"))


def cut_sql(n: int) -> str:
    return f"CASE WHEN n <= {n} THEN text ELSE array_to_string(ss[1:{lead_sql('ss', f'a.u + b.u > {n}')}], ' ') END"


digest = lambda p: F.concat(F.lit("Intro. Press Release Article "), F.md5(p))


def inputs_sql(prompt, columns: dict[str, str]) -> str:
    return " || chr(10) || chr(10) || ".join(f"{quoted(label + ':' + chr(10))} || {columns.get(c, quoted('None'))}" for label, c in prompt.inputs)


def releases_sql(prompt) -> str:
    return f"""SELECT doc_id AS paper_id, '{prompt.aspect}' AS strategy, md5({quoted(prompt.instruction)} || chr(10) || chr(10) || {cut_sql(200)}) AS parsed_pr_article
FROM (SELECT *, {SENTENCES.format('text')} AS ss, len({TOKENS.format('text')}) AS n FROM (SELECT doc_id, {inputs_sql(prompt, {'paper_text': 'text', 'conversation': 'reverse(text)'})} AS text FROM documents))"""


RELEASES = rb.GENERATION_PROMPTS[:4]


@query("press_releases", " UNION ALL ".join(releases_sql(p) for p in RELEASES))
def press_releases(spark, d):
    """All four strategies: from the paper, step by step, with a conversation, from a conversation alone."""
    rows = papers(spark, d).withColumn("conversation", F.reverse("paper_text"))
    made = [gn.press_releases(rows, p, digest, limit=200).select("paper_id", F.lit(p.aspect).alias("strategy"), "parsed_pr_article") for p in RELEASES]
    return reduce(lambda a, b: a.unionByName(b), made)


@query("article_summaries", f"""
SELECT doc_id AS paper_id, source AS topic, md5({quoted(gn.SUMMARY_INSTRUCTION)} || chr(10) || chr(10) || text) AS pr_summary FROM documents""")
def article_summaries(spark, d):
    rows = papers(spark, d).select("paper_id", F.col("paper_title").alias("topic"), F.col("paper_text").alias("pr_article"))
    out = gn.article_summaries(rows, lambda p: F.concat(F.lit(" "), F.md5(p), F.lit("\n")))
    return out.select("paper_id", "topic", "pr_summary")


@query("paper_releases", """
SELECT doc_id AS paper_id, md5('Write.' || chr(10) || chr(10) || '[PAPER]:' || text || chr(10) || chr(10) || '[CONVERSATION]:' || source) AS press_release FROM documents""")
def paper_releases(spark, d):
    out = gn.paper_releases(papers(spark, d), "Write.", lambda p: F.md5(p), conversation="paper_title")
    return out.select("paper_id", "press_release")


@query("topic_lists", f"""
WITH i AS (SELECT doc_id, 'Press Release:' || chr(10) || text AS x FROM documents)
SELECT doc_id AS paper_id, md5({quoted(rb.GENERATION_PROMPTS[4].instruction)} || chr(10) || chr(10) || x) AS parsed_topics FROM i WHERE len({TOKENS.format('x')}) < 400""")
def topic_lists(spark, d):
    rows = papers(spark, d).withColumnRenamed("paper_text", "pr_article")
    model = lambda p: F.concat(F.lit("Topics\n "), F.md5(p), F.lit(" \n\nEnd"))
    return gn.topics(rows, rb.GENERATION_PROMPTS[4], model, limit=400).select("paper_id", "parsed_topics")


def dialogues_sql(prompt) -> str:
    x = inputs_sql(prompt, {"sc_intro": "text", "pr_article": "reverse(text)"})
    return f"SELECT doc_id AS paper_id, '{prompt.aspect}' AS strategy, 2 AS n_turns, ' ' || md5({quoted(prompt.instruction)} || chr(10) || chr(10) || {x}) AS question, ' yes: indeed' AS answer FROM documents"


@query("full_conversations", " UNION ALL ".join(dialogues_sql(p) for p in rb.dialogue_prompts()))
def full_conversations(spark, d):
    """All combinations of guidelines for both speakers."""
    rows = papers(spark, d).withColumnRenamed("paper_text", "sc_intro").withColumn("pr_article", F.reverse("sc_intro"))
    model = lambda p: F.concat(F.lit("hm</think>**Journalist**: "), F.md5(p), F.lit("\n\n**Researcher**: yes: indeed"))
    made = [
        gn.full_conversations(rows, p, model, max_input_tokens=10**6).select(
            "paper_id", F.lit(p.aspect).alias("strategy"), F.size("parsed_conv").alias("n_turns"), F.col("parsed_conv")[0]["text"].alias("question"),
            F.col("parsed_conv")[1]["text"].alias("answer"),
        )
        for p in rb.dialogue_prompts()
    ]
    return reduce(lambda a, b: a.unionByName(b), made)


def opening(role: str) -> str:
    return f"'<|system|>{dg.ROLE_PROMPTS[role]}' || chr(10) || '<|user|>[PAPER-TITLE]' || chr(10) || paper_title || chr(10) || '[PAPER]' || chr(10) || paper || chr(10)"


END = "'<|assistant|>'"
MINE = "'<|assistant|>' || {} || chr(10)"
THEIRS = "'<|user|>' || {} || chr(10)"


def turns_sql(*parts: str) -> str:
    return " || ".join(parts)


def rounds_sql(rounds: int) -> str:
    """One step per reply; both speakers see the same turns, their own as the assistant's."""
    steps, said = [f"s0 AS (SELECT paper_id, paper_title, {cut_sql(100)} AS paper FROM pa)"], []
    for k in range(2 * rounds):
        speaker, name = ("Journalist", f"q{k}") if k % 2 == 0 else ("Researcher", f"a{k}")
        seen = [(MINE if n[0] == name[0] else THEIRS).format(n) for n in said]
        steps.append(f"s{k + 1} AS (SELECT *, md5({turns_sql(opening(speaker), *seen, END)}) || '.' AS {name} FROM s{k})")
        said.append(name)
    text = " || chr(10) || chr(10) || ".join(f"'{'Journalist' if n[0] == 'q' else 'Researcher'}: ' || {n}" for n in said)
    return f"WITH {PAPERS}, {', '.join(steps)} SELECT paper_id, {2 + 2 * rounds} AS n_messages, {text} AS conversation FROM s{2 * rounds}"


@query("interactive_conversations", rounds_sql(5))
def interactive_conversations(spark, d):
    model = lambda p: F.concat(F.md5(p), F.lit(".\n\ncut off"))
    out = gn.interactive_conversations(papers(spark, d), model, model, max_input_tokens=100)
    return out.select("paper_id", F.size("generated_conversation").alias("n_messages"), "conversation")


Q = [quoted(q) for q in rb.FIXED_QUESTIONS]


@query("fixed_question_conversations", f"""
WITH {PAPERS}, b AS (SELECT paper_id, paper_title, {cut_sql(100)} AS paper FROM pa),
s1 AS (SELECT *, md5({opening('Researcher')} || {THEIRS.format(Q[0])} || {END}) || '.' AS a1 FROM b),
s2 AS (SELECT *, md5({opening('Researcher')} || {THEIRS.format(Q[0])} || {MINE.format('a1')} || {THEIRS.format(Q[1])} || {END}) || '.' AS a2 FROM s1),
s3 AS (SELECT *, md5({opening('Researcher')} || {THEIRS.format(Q[0])} || {MINE.format('a1')} || {THEIRS.format(Q[1])} || {MINE.format('a2')} || {THEIRS.format(Q[2])} || {END}) || '.' AS a3 FROM s2)
SELECT paper_id, 'Journalist: ' || {Q[0]} || chr(10) || chr(10) || 'Researcher: ' || a1 || chr(10) || chr(10) || 'Journalist: ' || {Q[1]} || chr(10) || chr(10) || 'Researcher: ' || a2
  || chr(10) || chr(10) || 'Journalist: ' || {Q[2]} || chr(10) || chr(10) || 'Researcher: ' || a3 AS conversation FROM s3""")
def fixed_question_conversations(spark, d):
    model = lambda p: F.concat(F.md5(p), F.lit("."))
    out = gn.fixed_question_conversations(papers(spark, d), model, max_input_tokens=100)
    return out.select("paper_id", "conversation")


def generated(spark, d):
    """Conversations as chat arrays with the paper as second message."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "source", F.col("text").alias("paper"))
    item = F.struct("turn", dg.message(F.col("role"), as_questions("text")).alias("m"))
    rows = turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("_t"))
    chat = dg.chat("Journalist", F.col("source"), F.col("paper"), F.transform("_t", lambda t: t["m"]))
    system = F.concat(F.lit("s"), (F.col("conv_id") % 2).cast("string"))
    return rows.join(docs, "conv_id").select(
        F.col("conv_id").cast("string").alias("paper_id"), system.alias("system"), chat.alias("generated_conversation")
    )


@query("conversation_quality")
def conversation_quality(spark, d):
    return rounded(ev.conversation_quality(generated(spark, d), threshold=0.5), "mean", "std")


@query("journalist_answers", f"""
WITH {TURNS}, j AS (SELECT conv_id, string_agg({AS_QUESTIONS.format('text')}, chr(10) || chr(10) ORDER BY turn) AS h FROM turns WHERE author = 'Journalist' GROUP BY 1)
SELECT t.conv_id::VARCHAR AS paper_id, md5(coalesce(any_value(h), '')) AS hypothesis_md5 FROM turns t LEFT JOIN j USING (conv_id) GROUP BY t.conv_id""")
def journalist_answers(spark, d):
    return ev.journalist_pairs(generated(spark, d)).select("paper_id", F.md5("hypothesis").alias("hypothesis_md5"))
