"""Queries over text functions."""

from pyspark.sql import functions as F

from turnloom.catalog.registry import (
    AS_QUESTIONS, LEXICAL, NAIVE, SENTENCES, STRIP, TOKENS, TURNS, WORDS, as_questions, query, table, turns,
)
from turnloom.functions import dialogue as dg
from turnloom.functions import labels as lb
from turnloom.functions import parsing as ps
from turnloom.functions import text as tx
from turnloom.operators import masking as mk
from turnloom.operators.turns import conversation_segments, explode_dialogues, render_conversations
from turnloom.plans.corpus import clean_corpus, list_questions
from turnloom.session import durable

big = lambda c: c.cast("bigint")


@query("text_counts", f"""
SELECT doc_id, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_words,
  CAST(len({TOKENS.format('text')}) AS BIGINT) AS n_tokens, CAST(len({SENTENCES.format('text')}) AS BIGINT) AS n_sentences,
  CAST(len({NAIVE.format('text')}) AS BIGINT) AS n_naive_sentences,
  md5(array_to_string(({WORDS.format('text')})[1:100], ' ')) AS head_md5
FROM documents""")
def text_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", big(tx.word_count(t)).alias("n_words"), big(tx.token_count(t)).alias("n_tokens"),
        big(F.size(tx.sentences(t))).alias("n_sentences"), big(F.size(tx.naive_sentences(t))).alias("n_naive_sentences"),
        F.md5(tx.first_words(t, 100)).alias("head_md5"),
    )


@query("document_sentences", f"""
WITH s AS (SELECT doc_id, {SENTENCES.format('text')} AS ss FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, md5(ss[i]) AS sentence_md5
FROM s, LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i)""")
def document_sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", big(F.col("pos")).alias("pos"), F.md5("s").alias("sentence_md5"))


COMPLETE = r"""regexp_matches({}, '[.?!…]([''”"\)]*)\s*$')"""


@query("complete_paragraphs", rf"""
WITH t AS (SELECT conv_id, turn, replace(regexp_replace(text, 'n\.\n', 'n' || chr(10), 'g'), chr(10), chr(10) || chr(10)) AS x FROM conversations),
p AS (SELECT *, list_filter(list_transform(string_split({STRIP.format('x')}, chr(10) || chr(10)), lambda q: {STRIP.format('q')}), lambda q: q <> '') AS ps FROM t),
c AS (SELECT *, list_position(list_transform(ps, lambda q: {COMPLETE.format('q')}), false) AS cut FROM p),
n AS (SELECT *, least(CASE WHEN cut IS NULL OR cut = 0 THEN len(ps) ELSE cut - 1 END, 3) AS k FROM c)
SELECT conv_id, turn, CAST(k AS BIGINT) AS n_kept,
  md5(CASE WHEN k > 0 THEN array_to_string(ps[1:k], chr(10) || chr(10)) ELSE x END) AS kept_md5 FROM n""")
def complete_paragraphs(spark, d):
    x = F.replace(F.regexp_replace("text", r"n\.\n", "n\n"), F.lit("\n"), F.lit("\n\n"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", x.alias("x"))
    kept = tx.complete_paragraphs(F.col("x"))
    blocks = F.filter(F.split(kept, "\n\n"), lambda p: p != "")
    whole = F.when(tx.is_complete(F.element_at(blocks, 1)), F.size(blocks)).otherwise(0)
    return rows.select("conv_id", "turn", big(whole).alias("n_kept"), F.md5(kept).alias("kept_md5"))


@query("parsed_dialogues", rf"""
WITH {TURNS}
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, author, md5(' ' || text) AS text_md5
FROM turns WHERE conv_id % 10 <> 3""")
def parsed_dialogues(spark, d):
    marked = F.when(F.col("author") == "Journalist", "**Journalist**: ").otherwise("**Researcher (R)**: ")
    # one conversation in ten has a speaker nobody knows
    stranger = F.when((F.col("conv_id") % 10 == 3), F.lit("**Reviewer**: ")).otherwise(marked)
    rows = turns(spark, d).select("conv_id", "turn", F.concat(stranger, "text").alias("text"))
    raw = rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("t")
    )
    raw = raw.select("conv_id", F.concat(F.lit("Let me think: **J** first.</think>\n\n"), "t").alias("conversation"))
    parsed = clean_corpus(raw, marker="**R")
    long = explode_dialogues(parsed, keep=("conv_id",))
    return long.select("conv_id", big(F.col("turn")).alias("turn"), "author", F.md5("text").alias("text_md5"))


DOCTOR = r"regexp_replace(text, '([.] )([A-Z][a-z]+)', '\1Dr. \2', 'g')"


@query("masked_names", rf"""
SELECT doc_id, md5(regexp_replace({DOCTOR}, '\bDr\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*', '[name]', 'g')) AS masked_md5,
  len(string_split(regexp_replace({DOCTOR}, '\bDr\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*', '[name]', 'g'), '[name]')) - 1 AS n_names
FROM documents""")
def masked_names(spark, d):
    named = F.regexp_replace("text", r"([.] )([A-Z][a-z]+)", "$1Dr. $2")
    masked = tx.mask_names(named)
    return table(spark, d, "documents").select(
        "doc_id", F.md5(masked).alias("masked_md5"), big(F.size(F.split(masked, r"\[name\]")) - 1).alias("n_names")
    )


OPENERS = "|".join(tx.QUESTION_OPENERS)
ASKED = rf"""list_transform(list_filter(list_transform({NAIVE.format(AS_QUESTIONS.format('text'))}, lambda s: {STRIP.format('s')}),
  lambda s: s LIKE '%?' OR regexp_matches(lower(s), '^({OPENERS})([^\p{{L}}\p{{N}}_]|$)')),
  lambda s: CASE WHEN s LIKE '%?' THEN s ELSE s || '?' END)"""


@query("extracted_questions", f"""
WITH {TURNS}, q AS (SELECT conv_id, turn, {ASKED} AS qs FROM turns WHERE author = 'Journalist')
SELECT conv_id, turn, i - 1 AS pos, md5(qs[i]) AS question_md5 FROM q, LATERAL (SELECT unnest(range(1, len(qs) + 1)) AS i)""")
def extracted_questions(spark, d):
    asked = turns(spark, d).where("author = 'Journalist'").select(
        "conv_id", "turn", F.posexplode(tx.questions(as_questions("text"))).alias("pos", "q")
    )
    return asked.select("conv_id", "turn", big(F.col("pos")).alias("pos"), F.md5("q").alias("question_md5"))


WH = "|".join(tx.INTERROGATIVES)


@query("interrogative_sentences", rf"""
WITH s AS (SELECT doc_id, {SENTENCES.format(AS_QUESTIONS.format('text'))} AS ss FROM documents)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(len(list_filter(ss, lambda s: s LIKE '%?' OR
  regexp_matches(lower(s), '(^|[^\p{{L}}\p{{N}}_])({WH})([^\p{{L}}\p{{N}}_]|$)'))) AS BIGINT) AS n_questions FROM s""")
def interrogative_sentences(spark, d):
    x = as_questions("text")
    return table(spark, d, "documents").select(
        "doc_id", big(F.size(tx.sentences(x))).alias("n_sentences"), big(F.size(tx.question_sentences(x))).alias("n_questions")
    )


@query("rendered_conversations", f"""
WITH {TURNS}, l AS (SELECT conv_id, turn, author || ': ' || CASE WHEN author = 'Journalist'
    THEN replace(replace('Journalist: ' || text, 'Researcher: ', ''), 'Journalist: ', '') ELSE 'Journalist: ' || text END AS line FROM turns)
SELECT conv_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM l GROUP BY 1""")
def rendered_conversations(spark, d):
    rows = turns(spark, d).withColumn("text", F.concat(F.lit("Journalist: "), "text"))
    return render_conversations(rows).select("conv_id", F.md5("text").alias("text_md5"))


FORMS = f"""m AS (SELECT t.conv_id, t.turn, t.author, t.role, 'Journalist: ' || t.text AS text FROM turns t),
f AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'Researcher' ELSE 'Journalist' END || ': ' || replace(replace(text, 'Researcher: ', ''), 'Journalist: ', ''), chr(10) || chr(10) ORDER BY turn) AS b,
  string_agg(author || ': ' || text, chr(10) ORDER BY turn) AS c, string_agg(author || ':' || text, chr(10) || chr(10) ORDER BY turn) AS d FROM m GROUP BY 1)"""


@query("rendered_forms", f"""
WITH {TURNS}, {FORMS} SELECT f.conv_id, md5(b) AS both_md5, md5('Researcher: ' || '[PAPER-TITLE]' || chr(10) || source || chr(10) || '[PAPER]' || chr(10) || p.text || chr(10) || c) AS plain_md5, md5(d) AS bare_md5
FROM f JOIN documents p ON f.conv_id = p.doc_id""")
def rendered_forms(spark, d):
    """The other three renderings of a message array: both speakers cleaned, all but the first message, no blank."""
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "source", F.col("text").alias("paper"))
    item = F.struct("turn", dg.message(F.col("role"), F.concat(F.lit("Journalist: "), F.col("text"))).alias("m"))
    rows = turns(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda t: t["m"]).alias("_m"))
    chat = rows.join(papers, "conv_id").select("conv_id", dg.chat("Journalist", F.col("source"), F.col("paper"), F.col("_m")).alias("c"))
    form = lambda **how: F.md5(dg.render(F.col("c"), **how))
    return chat.select("conv_id", form(style="both").alias("both_md5"), form(skip=1, sep="\n", style="plain").alias("plain_md5"), form(style="bare").alias("bare_md5"))


@query("conversation_segments", f"""
WITH {TURNS}, l AS (SELECT conv_id, turn, author || ': ' || CASE WHEN author = 'Journalist' THEN replace(replace(text, 'Researcher: ', ''), 'Journalist: ', '') ELSE text END AS line FROM turns)
SELECT conv_id, turn, md5(line) AS segment_md5, (sum(length(line) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(line) - 2)::BIGINT AS start FROM l""")
def rendered_segments(spark, d):
    return conversation_segments(turns(spark, d)).select("conv_id", "turn", F.md5("segment").alias("segment_md5"), "start")


@query("chat_messages", f"""
WITH {TURNS}, j AS (SELECT t.conv_id, t.turn, t.text, d.source, d.text AS paper FROM turns t JOIN documents d ON t.conv_id = d.doc_id WHERE author = 'Journalist')
SELECT conv_id, turn, md5('<|system|>{dg.ROLE_PROMPTS["Journalist"]}' || chr(10) || '<|user|>[PAPER-TITLE]' || chr(10) || source || chr(10) || '[PAPER]' || chr(10) || paper
  || chr(10) || '<|assistant|>' || text || chr(10) || '<|assistant|>') AS prompt_md5,
  md5(conv_id || ' ==> ' || text) AS line_md5, md5(string_split(paper, '[PAPER]')[-1]) AS paper_md5 FROM j""")
def chat_messages(spark, d):
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "source", F.col("text").alias("paper"))
    rows = turns(spark, d).join(papers, "conv_id")
    lines = list_questions(rows.select("conv_id", "turn", "author", "text"))
    history = F.array(dg.message("assistant", F.col("text")))
    chat = rows.where("author = 'Journalist'").select(
        "conv_id", "turn", dg.chat("Journalist", F.col("source"), F.col("paper"), history).alias("m")
    )
    return chat.join(lines, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.md5(dg.chat_template(F.col("m"))).alias("prompt_md5"), F.md5("line").alias("line_md5"),
        F.md5(F.regexp_replace(dg.paper_of(F.col("m")), "^\n", "")).alias("paper_md5"),
    )


REPLY = """CASE turn % 5 WHEN 0 THEN '{"reasons": "r' || turn || '", "score": ' || (conv_id % 5 + 1) || '}'
  WHEN 1 THEN 'Some thoughts.' || chr(10) || '{"reasons": "r' || turn || '", "score": "' || (conv_id % 5 + 1) || '"}'
  WHEN 2 THEN 'hm</think> {"reasons": "r' || turn || '", "score": "' || (conv_id % 5 + 1) || '"} end'
  WHEN 3 THEN 'not a judgement' ELSE '  ' || (conv_id % 5 + 1) || ' ' END"""


@query("parsed_replies", f"""
SELECT conv_id, turn,
  CAST(CASE WHEN turn % 5 IN (0, 1) THEN conv_id % 5 + 1 WHEN turn % 5 = 4 THEN 5 ELSE 5 END AS BIGINT) AS json_score,
  CAST(CASE WHEN turn % 5 IN (0, 1, 2) THEN conv_id % 5 + 1 ELSE 1 END AS BIGINT) AS reasoned_score,
  CASE WHEN turn % 5 IN (0, 1, 2) THEN 'r' || turn ELSE '' END AS reasoned_text,
  CAST(CASE WHEN turn % 5 = 0 THEN conv_id % 5 + 1 ELSE 1 END AS BIGINT) AS structured_score,
  CASE WHEN turn % 5 = 0 THEN 'r' || turn ELSE 'no reason' END AS structured_text,
  turn % 5 = 0 AS structured_ok,
  CAST(CASE WHEN turn % 5 = 4 THEN conv_id % 5 + 1 ELSE 0 END AS BIGINT) AS rating
FROM conversations""")
def parsed_replies(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{REPLY.replace('chr(10)', 'char(10)')} AS reply")
    r = F.col("reply")
    return rows.select(
        "conv_id", "turn", ps.parse_json_reply(r).alias("a"), ps.parse_reasoned_reply(r).alias("b"),
        ps.parse_structured_reply(r).alias("c"), tx.rating(r).alias("rating"),
    ).select(
        "conv_id", "turn", big(F.col("a.score")).alias("json_score"), big(F.col("b.score")).alias("reasoned_score"),
        F.col("b.reasons").alias("reasoned_text"), big(F.col("c.score")).alias("structured_score"),
        F.col("c.reasons").alias("structured_text"), F.col("c.parse_ok").alias("structured_ok"), big(F.col("rating")).alias("rating"),
    )


@query("generated_texts", rf"""
WITH t AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN text ELSE 'Plan. Press Release Article ' || text || ' ' END AS g FROM documents),
l AS (SELECT *, string_split(text, chr(10)) AS ls FROM t)
SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN text ELSE {STRIP.format("' ' || text || ' '")} END) AS body_md5,
  md5(array_to_string(list_filter(list_transform(ls[2:len(ls) - 1], lambda x: {STRIP.format('x')}), lambda x: x <> ''), chr(10))) AS topics_md5
FROM l""")
def generated_texts(spark, d):
    made = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(
        F.concat(F.lit("Plan. Press Release Article "), "text", F.lit(" "))
    )
    return table(spark, d, "documents").select(
        "doc_id", F.md5(tx.article_body(made)).alias("body_md5"), F.md5(tx.topic_lines(F.col("text"))).alias("topics_md5")
    )


CLAIM = "lower(c.text)"


@query("cleaned_claims", rf"""
WITH p AS (SELECT c.conv_id, c.turn, list_reverse({WORDS.format('d.text')}) AS ctx, {WORDS.format(CLAIM)} AS cw
  FROM conversations c JOIN documents d ON c.conv_id = d.doc_id),
low AS (SELECT *, list_transform(ctx, lambda w: lower(w)) AS lctx FROM p),
r AS (SELECT conv_id, turn, array_to_string(list_transform(cw, lambda w: coalesce(ctx[nullif(list_position(lctx, lower(w)), 0)], w)), ' ') AS t FROM low),
q AS (SELECT conv_id, turn, {SENTENCES.format('t')} AS ss FROM r)
SELECT conv_id, turn, md5(array_to_string(list_transform(ss, lambda s: upper(s[1:1]) || s[2:]), ' ')) AS claim_md5 FROM q""")
def cleaned_claims(spark, d):
    said = table(spark, d, "conversations")
    # documents that a claim is about, dealt anew: those may stand side by side
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "text").join(said.select("conv_id"), "conv_id", "left_semi")
    # once per document: what is joined is the map, not the text
    docs = durable(asked.repartition("conv_id").select("conv_id", tx.case_map(F.col("text")).alias("known")))
    rows = said.join(docs, "conv_id")
    claim = tx.clean_claim_by(F.col("known"), F.lower("text"))
    return rows.select("conv_id", "turn", F.md5(claim).alias("claim_md5"))


@query("string_helpers", rf"""
WITH b AS (SELECT *, {TOKENS.format('text')} AS tk FROM documents)
SELECT doc_id, md5(regexp_replace(text, '[^\x20-\x7E\t\n\r\x0B\x0C]', '', 'g')) AS printable_md5, md5(text) AS unwrapped_md5,
  md5({STRIP.format('text[6:25]')}) AS span_md5, md5('Score: ' || (doc_id % 12) || chr(10) || 'Reason: ' || source) AS judged_md5,
  CAST(doc_id % 12 AS BIGINT) AS judged_score, md5({STRIP.format("' ' || text")}) AS reply_md5,
  md5(CASE WHEN len(tk) > 20 THEN array_to_string(tk[1:20], ' ') || '...' ELSE text END) AS cut_md5,
  replace(source || ' v' || doc_id, ' ', '_') AS file_key,
  md5(array_to_string(list_transform(({SENTENCES.format('text')}), lambda s, i: i || '. ' || s), chr(10))) AS numbered_md5
FROM b""")
def string_helpers(spark, d):
    t = F.col("text")
    title = F.concat("source", F.lit(" v"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    judged = tx.judged_text(F.col("doc_id") % 12, F.col("source"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(tx.printable(t)).alias("printable_md5"),
        F.md5(tx.unwrap_bytes_literal(F.concat(F.lit("b'"), t, F.lit("'")))).alias("unwrapped_md5"),
        F.md5(tx.span(t, F.lit(5), F.lit(25))).alias("span_md5"), F.md5(judged).alias("judged_md5"),
        big(tx.judged_score(judged)).alias("judged_score"),
        F.md5(tx.strip_address(F.concat(F.lit("Journalist: [name], "), t))).alias("reply_md5"),
        F.md5(tx.cut_tokens(t, 20)).alias("cut_md5"), tx.file_key(title).alias("file_key"),
        F.md5(tx.numbered(tx.sentences(t))).alias("numbered_md5"),
    )


@query("pronoun_substitution", """
SELECT doc_id, md5(text[1:strpos(text, ' ')] || 'NAME' || text[strpos(text, ' ') + 4:]) AS text_md5 FROM documents""")
def pronoun_substitution(spark, d):
    at = F.instr("text", " ")
    old = F.substr(F.col("text"), at + 1, F.lit(3))
    out = tx.substitute_span(F.col("text"), at, old, F.lit("NAME"))
    short = F.length(old) < 3
    return table(spark, d, "documents").select("doc_id", F.md5(F.when(short, F.concat(F.substr(F.col("text"), F.lit(1), at), F.lit("NAME"))).otherwise(out)).alias("text_md5"))


@query("label_conversions", """
WITH e AS (SELECT event_id, event_type, value, CASE event_id % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' ELSE 'OTHER' END AS verdict,
  CASE WHEN event_id % 2 = 0 THEN 'entailment' ELSE 'other' END AS relation, event_id % 4 - 1 AS code FROM events)
SELECT event_id, CAST(CASE verdict WHEN 'SUPPORTS' THEN 0 WHEN 'REFUTES' THEN 2 ELSE 1 END AS BIGINT) AS fact,
  CAST(relation = 'entailment' AS BIGINT) AS entails, CAST(CASE code WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE code END AS BIGINT) AS commitment,
  CAST(CASE code WHEN -1 THEN 1 ELSE code END AS BIGINT) AS known, round(value / 5.0, 6) AS fifth, CAST(value >= 4 AS BIGINT) AS at_least_4,
  CAST(code = 0 AS BIGINT) AS is_zero FROM e""")
def label_conversions(spark, d):
    code = F.col("event_id") % 4 - 1
    verdict = F.when(F.col("event_id") % 3 == 0, "SUPPORTS").when(F.col("event_id") % 3 == 1, "REFUTES").otherwise("OTHER")
    relation = F.when(F.col("event_id") % 2 == 0, "entailment").otherwise("other")
    return table(spark, d, "events").select(
        "event_id", big(lb.fact_label(verdict)).alias("fact"), big(lb.entailment_label(relation)).alias("entails"),
        big(lb.commitment_label(code)).alias("commitment"), big(lb.known_or_neutral(code)).alias("known"),
        F.round(lb.fifth(F.col("value")), 6).alias("fifth"), big(lb.at_least(F.col("value"), 4)).alias("at_least_4"),
        big(lb.equals(code, 0)).alias("is_zero"),
    )


@query("cloze_options", rf"""
WITH o AS (SELECT doc_id, text, unnest([{{'pos': 0, 'o': lang}}, {{'pos': 1, 'o': source}}]) AS e FROM documents),
q AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'the ', '_ ') ELSE text END AS question FROM o)
SELECT doc_id, CAST(e.pos AS BIGINT) AS pos, md5(CASE WHEN contains(question, '_') THEN
  array_to_string({WORDS.format("replace(question, '_', ' ' || e.o || ' ')")}, ' ') ELSE question || ' ' || e.o || ' ' END) AS filled_md5 FROM q""")
def cloze_options(spark, d):
    question = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("the "), F.lit("_ "))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", question.alias("q"), F.posexplode(F.array("lang", "source")).alias("pos", "o"))
    return rows.select("doc_id", big(F.col("pos")).alias("pos"), F.md5(tx.fill_blank(F.col("q"), F.col("o"))).alias("filled_md5"))


def deleted_sql(text: str, answer: str) -> str:
    """An answer deleted where no letter, digit, hyphen or dash touches it; twice, as neighbours share what stands between them."""
    edge = r"[^\p{L}\p{M}\p{N}_\-–]"
    once = lambda t: f"regexp_replace({t}, '(?i)(^|{edge})' || regexp_escape({answer}) || '($|{edge})', '\\1\\2', 'g')"
    return once(once(text))


@query("masked_answers", f"""
WITH t AS (SELECT doc_id, text, list_sort(list_transform(({WORDS.format('text')})[1:3], lambda w, i: {{'n': -length(w), 'i': i, 'w': w}})) AS ans FROM documents),
a AS (SELECT doc_id, {deleted_sql("text", "coalesce(ans[1].w, chr(1))")} AS m, ans FROM t), b AS (SELECT doc_id, {deleted_sql("m", "coalesce(ans[2].w, chr(1))")} AS m, ans FROM a),
c AS (SELECT doc_id, {deleted_sql("m", "coalesce(ans[3].w, chr(1))")} AS m FROM b)
SELECT doc_id, CAST(length(m) AS BIGINT) AS n_chars, md5(m) AS masked_md5 FROM c""")
def masked_answers(spark, d):
    answers = F.slice(tx.words(F.col("text")), 1, 3)
    masked = tx.mask_answers(F.col("text"), answers)
    return table(spark, d, "documents").select("doc_id", big(F.length(masked)).alias("n_chars"), F.md5(masked).alias("masked_md5"))


MASKED = """list_transform(ws, lambda w, i: CASE WHEN n > 0 AND md5('7|' || doc_id || '|' || (i - 1)) <= cut THEN '[MASK]' ELSE w END)"""


@query("masked_tokens", f"""
WITH t AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
h AS (SELECT *, CAST(floor(len(ws) * 0.25) AS INT) AS n, list_sort(list_transform(ws, lambda w, i: md5('7|' || doc_id || '|' || (i - 1)))) AS hs FROM t),
c AS (SELECT *, hs[n] AS cut FROM h), m AS (SELECT doc_id, n, ws, {MASKED} AS ms FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n_masked, md5(array_to_string(ms, ' ')) AS masked_md5,
  md5(array_to_string(list_transform(ms, lambda w, i: CASE WHEN w = '[MASK]' THEN ws[i % len(ws) + 1] ELSE w END), ' ')) AS filled_md5 FROM m""")
def masked_tokens(spark, d):
    docs = table(spark, d, "documents").withColumn("m", mk.mask_share(F.col("text"), F.col("doc_id"), 0.25, 7))
    return docs.select(
        "doc_id", big(F.size(F.filter(F.split("m", " "), lambda w: w == mk.MASK))).alias("n_masked"), F.md5("m").alias("masked_md5"),
        F.md5(mk.infill_next_word(F.col("text"), F.col("m"))).alias("filled_md5"),
    )


FRACTION = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0"


@query("language_model_masks", f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
e AS (SELECT doc_id, ws, i - 1 AS i, len(ws) AS n, substr(md5('0|' || doc_id || '|' || (i - 1)), 1, 8) AS h, ('0x' || substr(md5('0-swap|' || doc_id || '|' || (i - 1)), 1, 15))::BIGINT % len(ws) AS j
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
t AS (SELECT doc_id, i, CASE WHEN h < '{mk.draw_below(0.15 * 0.8)}' THEN '[MASK]' WHEN h < '{mk.draw_below(0.15 * 0.9)}' THEN ws[j + 1] ELSE ws[i + 1] END AS token,
  CASE WHEN h < '{mk.draw_below(0.15)}' THEN ws[i + 1] END AS label FROM e)
SELECT doc_id, count(*) AS n_tokens, count(label) AS n_labelled, md5(string_agg(token, ' ' ORDER BY i)) AS tokens_md5, md5(string_agg(coalesce(label, '-'), ' ' ORDER BY i)) AS labels_md5 FROM t GROUP BY 1""")
def language_model_masks(spark, d):
    out = mk.language_model_mask(F.col("text"), F.col("doc_id"))
    rows = table(spark, d, "documents").select("doc_id", out.alias("m")).where(F.size("m.tokens") > 0)
    shown = F.transform("m.labels", lambda w: F.coalesce(w, F.lit("-")))
    return rows.select(
        "doc_id", big(F.size("m.tokens")).alias("n_tokens"), big(F.size(F.array_compact("m.labels"))).alias("n_labelled"),
        F.md5(F.array_join("m.tokens", " ")).alias("tokens_md5"), F.md5(F.array_join(shown, " ")).alias("labels_md5"),
    )
