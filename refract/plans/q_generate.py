"""Registered queries: prompt rendering, generation, dataset build
(J1-J4, F10, F11, F19, P1-P4, P2, W1, W2, W6, A1, A5, T2-T8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from refract.functions import prompts as P
from refract.functions import text as TX
from refract.operators import answers as AN
from refract.operators import generate as G
from refract.plans import sqlx as Q
from refract.plans.catalog import register
from refract.session import scratch_path
from refract.sources import files, tables
from refract.functions import rows as R

BUDGET = P.DEFAULT_BUDGET
SHORT_BUDGET = 50
LENGTHS = (50, 100)
FIRST_N = 20
AT_SEQ = 4


def arts(spark, sf):
    return tables.articles(tables.read_table(spark, sf, "documents"))


def dataset(spark, sf):
    return G.with_dataset_columns(arts(spark, sf), BUDGET)


# ------------------------------------------------------------ SQL pieces
ARTS_CTE = (f"arts AS (SELECT doc_id AS article_index, {Q.first_line('text')} AS title, "
            f"source AS link, text AS content FROM documents)")


def units_cte(name: str, src: str, keys: str, text: str) -> str:
    """Sentences of the newline-normalised ``text`` as rows:
    keys, pos (0-based), n, s, w."""
    return (f"{name}_ss AS (SELECT {keys}, {Q.sentences(Q.norm(text))} AS ss FROM {src}),\n"
            f"{name}_u AS (SELECT {keys}, generate_subscripts(ss, 1) - 1 AS pos, len(ss) AS n, "
            f"unnest(ss) AS s FROM {name}_ss),\n"
            f"{name} AS (SELECT *, {Q.wc('s')} AS w FROM {name}_u)")


def budget_cte(name: str, src: str, keys: str, key_expr: str, budget: str) -> str:
    """Rank units by (key, pos), keep while running words <= budget (first
    always kept), re-join kept sentences in position order."""
    return (f"{name}_r AS (SELECT {keys}, pos, s, w, {key_expr} AS k FROM {src}),\n"
            f"{name}_c AS (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY k, pos "
            f"ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY k, pos) AS rn FROM {name}_r),\n"
            f"{name} AS (SELECT {keys}, string_agg(s, ' ' ORDER BY pos) AS txt FROM {name}_c "
            f"WHERE rn = 1 OR cum <= {budget} GROUP BY {keys})")


SEQS_VALUES = "(VALUES " + ", ".join(f"({i})" for i in range(len(P.PERSPECTIVE_TEMPLATES))) + ") AS t(seq)"

PERSPECTIVES_CTE = ",\n".join([
    ARTS_CTE,
    units_cte("au", "arts", "article_index", "content"),
    f"aus AS (SELECT au.*, t.seq FROM au, {SEQS_VALUES})",
    budget_cte("pp", "aus", "article_index, seq",
               Q.perspective_key("seq", "s", "pos", "n", "w"), str(BUDGET)),
    f"persp AS (SELECT a.article_index, t.seq, coalesce(pp.txt, '') AS perspective "
    f"FROM arts a CROSS JOIN {SEQS_VALUES} LEFT JOIN pp ON pp.article_index = a.article_index "
    f"AND pp.seq = t.seq)",
])

SPECS_VALUES = ("(VALUES " + ", ".join(f"({o}, {n})" for o, _c, _s, n in P.QUESTION_SPECS)
                + ") AS sp(spec_ord, cnt)")

_SEG_CASES = []
for _i in range(P.SEGMENT_COUNT):
    _a, _b = Q.segment_bounds("n", P.SEGMENT_COUNT, _i)
    _SEG_CASES.append(f"SELECT article_index, {_i} AS seg, pos, s FROM au "
                      f"WHERE pos + 1 >= {_a} AND pos + 1 <= {_b}")

QUESTIONS_CTE = ",\n".join([
    ARTS_CTE,
    units_cte("au", "arts", "article_index", "content"),
    f"qr AS (SELECT au.article_index, sp.spec_ord, au.s, sp.cnt, row_number() OVER "
    f"(PARTITION BY au.article_index, sp.spec_ord ORDER BY "
    f"{Q.question_key('sp.spec_ord', 'au.s', 'au.pos', 'au.w')}, au.pos) AS line_no "
    f"FROM au, {SPECS_VALUES})",
    f"segs AS ({' UNION ALL '.join(_SEG_CASES)})",
    f"sq AS (SELECT article_index, seg, s, row_number() OVER (PARTITION BY article_index, seg "
    f"ORDER BY pos) AS line_no FROM segs)",
    # category order 0 generic, 1 targeted, 2 segment; sub = spec or segment
    f"ql AS (SELECT article_index, CASE WHEN spec_ord = 0 THEN 0 ELSE 1 END AS cat_ord, "
    f"spec_ord AS sub_ord, line_no, line_no || '. ' || {Q.as_question('s')} AS question "
    f"FROM qr WHERE line_no <= cnt "
    f"UNION ALL SELECT article_index, 2, seg, line_no, line_no || '. ' || {Q.as_question('s')} "
    f"FROM sq WHERE line_no <= {P.SEGMENT_QUESTION_COUNT})",
    f"qlong AS (SELECT *, CASE cat_ord WHEN 0 THEN 'generic' WHEN 1 THEN 'targeted' "
    f"ELSE 'segment' END AS category, row_number() OVER (PARTITION BY article_index "
    f"ORDER BY cat_ord, sub_ord, line_no) - 1 AS q_seq, row_number() OVER (PARTITION BY "
    f"article_index, cat_ord ORDER BY sub_ord, line_no) - 1 AS cat_seq FROM ql)",
])


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _md5_len(col: str, prefix: str):
    return [F.length(col).cast("long").alias(f"{prefix}_len"), F.md5(col).alias(f"{prefix}_md5")]


def _sql_md5_len(expr: str, prefix: str) -> str:
    return f"length({expr})::BIGINT AS {prefix}_len, md5({expr}) AS {prefix}_md5"


def _tpl_values() -> str:
    return ("(VALUES " + ", ".join(f"({i}, {Q.lit(t)})" for i, t in enumerate(P.PERSPECTIVE_TEMPLATES))
            + ") AS tp(seq, template)")


def _sql_persp_prompt(template: str, budget: str, content: str) -> str:
    return (f"(replace({template}, '{P.PLACEHOLDER}', '{P.BUDGET_PREFIX}' || {budget}) "
            f"|| {Q.BLANK} || {content})")


def _sql_format(fmt: str, *args: str) -> str:
    parts = fmt.split("%s")
    assert len(parts) == len(args) + 1
    out = Q.lit(parts[0])
    for a, p in zip(args, parts[1:]):
        out += f" || {a} || {Q.lit(p)}"
    return f"({out})"


# ------------------------------------------------------------- prompts
@register("render_perspective_prompts", _with(ARTS_CTE) + f"""
SELECT a.article_index, tp.seq::BIGINT AS seq,
       {_sql_md5_len(_sql_persp_prompt('tp.template', "'" + str(BUDGET) + "'", 'a.content'), 'prompt')}
FROM arts a, {_tpl_values()}""")
def render_perspective_prompts(spark, sf):
    p = P.perspective_prompts(arts(spark, sf), BUDGET)
    return p.select("article_index", F.col("seq").cast("long").alias("seq"), *_md5_len("prompt", "prompt"))


_SPEC_ROWS = ("(VALUES " + ", ".join(f"({o}, {Q.lit(c)}, {Q.lit(s)}, {n})"
                                      for o, c, s, n in P.QUESTION_SPECS)
              + ") AS sp(spec_ord, category, spec, cnt)")


@register("render_question_prompts", _with(ARTS_CTE) + f"""
SELECT a.article_index, sp.spec_ord::BIGINT AS spec_ord, sp.category,
       {_sql_md5_len(f"CASE WHEN sp.spec_ord = 0 THEN {_sql_format(P.GENERIC_Q_FORMAT, 'sp.cnt::VARCHAR', 'a.content')} ELSE {_sql_format(P.SPEC_Q_FORMAT, 'sp.cnt::VARCHAR', 'sp.spec', 'a.content')} END", 'prompt')}
FROM arts a, {_SPEC_ROWS}""")
def render_question_prompts(spark, sf):
    p = P.question_prompts(arts(spark, sf))
    return p.select("article_index", F.col("spec_ord").cast("long").alias("spec_ord"), "category",
                    *_md5_len("prompt", "prompt"))


@register("segment_prompts", _with(ARTS_CTE, f"s AS (SELECT article_index, {Q.segments(Q.sentences('content'), P.SEGMENT_COUNT)} AS segs FROM arts)",
                                   "u AS (SELECT article_index, generate_subscripts(segs, 1) - 1 AS segment, unnest(segs) AS segment_text FROM s)") + f"""
SELECT article_index, segment::BIGINT AS segment, length(segment_text)::BIGINT AS segment_len,
       {_sql_md5_len(_sql_format(P.GENERIC_Q_FORMAT, "'" + str(P.SEGMENT_QUESTION_COUNT) + "'", 'segment_text'), 'prompt')}
FROM u""")
def segment_prompts(spark, sf):
    p = P.segment_prompts(arts(spark, sf))
    return p.select("article_index", F.col("segment").cast("long").alias("segment"),
                    F.length("segment_text").cast("long").alias("segment_len"),
                    *_md5_len("prompt", "prompt"))


@register("render_summary_prompts", _with(ARTS_CTE) + f"""
SELECT article_index, 'summary' AS kind,
       {_sql_md5_len(_sql_format(P.SUMMARY_FORMAT, "'" + str(BUDGET) + "'", 'content'), 'prompt')}
FROM arts
UNION ALL
SELECT article_index, 'shorten' AS kind,
       {_sql_md5_len(_sql_format(P.SHORTEN_FORMAT, "'" + str(BUDGET) + "'", 'content'), 'prompt')}
FROM arts""")
def render_summary_prompts(spark, sf):
    a = arts(spark, sf)
    kinds = F.array(F.struct(F.lit("summary").alias("kind"), P.summary_prompt(BUDGET, "content").alias("prompt")),
                    F.struct(F.lit("shorten").alias("kind"), P.shorten_prompt(BUDGET, "content").alias("prompt")))
    return (a.select("article_index", F.explode(kinds).alias("k"))
            .select("article_index", "k.kind", *_md5_len("k.prompt", "prompt")))


@register("chat_messages", _with(ARTS_CTE) + f"""
SELECT a.article_index, tp.seq::BIGINT AS seq, 2::BIGINT AS n_messages, 'system,user' AS roles,
       md5({Q.lit(P.SYSTEM_MESSAGE)}) AS system_md5,
       md5({_sql_persp_prompt('tp.template', "'" + str(BUDGET) + "'", 'a.content')}) AS user_md5
FROM arts a, {_tpl_values()}""")
def chat_messages(spark, sf):
    p = P.perspective_prompts(arts(spark, sf), BUDGET)
    m = P.chat_messages("prompt")
    return p.select("article_index", F.col("seq").cast("long").alias("seq"),
                    F.size(m).cast("long").alias("n_messages"),
                    F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"),
                    F.md5(m[0]["content"]).alias("system_md5"),
                    F.md5(m[1]["content"]).alias("user_md5"))


# ------------------------------------------------------------ generation
def _numbered_response(text_col):
    """Fixture response: a header, a blank line, then the conversation
    text's lines, numbered ``k. `` at even positions and ``- `` at odd ones."""
    body = F.transform(TX.lines(text_col), lambda l, i: F.when(
        i % 2 == 0, F.concat((i + 1).cast("string"), F.lit(". "), l)).otherwise(F.concat(F.lit("- "), l)))
    return F.concat(F.lit("Answer:\n\n"), F.array_join(body, "\n"))


_RESP_SQL = ("('Answer:' || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), "
             "lambda l, i: CASE WHEN (i - 1) % 2 = 0 THEN i::VARCHAR || '. ' || l ELSE '- ' || l END), chr(10)))")


@register("parse_questions", f"""
WITH r AS (SELECT conv_id, turn, list_filter(string_split({_RESP_SQL}, chr(10)),
                  lambda x: regexp_matches(x, '^\\p{{Nd}}')) AS qs
           FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, generate_subscripts(qs, 1) - 1 AS q_no, unnest(qs) AS q FROM r)
SELECT conv_id, turn, q_no::BIGINT AS q_no, md5(q) AS question_md5 FROM u""")
def parse_questions(spark, sf):
    c = tables.read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    qs = TX.parse_questions(_numbered_response("text"))
    return (R.posexplode_rows(c, ["conv_id", "turn"], qs, "q_no", "q")
            .select("conv_id", "turn", F.col("q_no").cast("long").alias("q_no"),
                    F.md5("q").alias("question_md5")))


@register("extractive_perspectives", _with(PERSPECTIVES_CTE) + f"""
SELECT article_index, seq::BIGINT AS seq, {Q.wc('perspective')}::BIGINT AS n_words,
       md5(perspective) AS perspective_md5 FROM persp""")
def extractive_perspectives(spark, sf):
    d = dataset(spark, sf)
    return (R.posexplode_rows(d, ["article_index"], F.col("sumarries"), "seq", "p")
            .select("article_index", F.col("seq").cast("long").alias("seq"),
                    TX.word_count("p").cast("long").alias("n_words"),
                    F.md5("p").alias("perspective_md5")))


@register("shorten_perspectives", _with(PERSPECTIVES_CTE, units_cte("pu", "persp", "article_index, seq", "perspective"),
                                        budget_cte("sh", "pu", "article_index, seq", "pos", str(SHORT_BUDGET))) + f"""
SELECT p.article_index, p.seq::BIGINT AS seq, {Q.wc("coalesce(sh.txt, '')")}::BIGINT AS n_words,
       md5(coalesce(sh.txt, '')) AS short_md5
FROM persp p LEFT JOIN sh ON sh.article_index = p.article_index AND sh.seq = p.seq""")
def shorten_perspectives(spark, sf):
    d = dataset(spark, sf)
    return (R.posexplode_rows(d, ["article_index"], F.col("sumarries"), "seq", "p")
            .select("article_index", F.col("seq").cast("long").alias("seq"),
                    G.shorten("p", SHORT_BUDGET).alias("short"))
            .select("article_index", "seq", TX.word_count("short").cast("long").alias("n_words"),
                    F.md5("short").alias("short_md5")))


@register("extractive_questions", _with(QUESTIONS_CTE) + """
SELECT article_index,
       CASE cat_ord WHEN 0 THEN 'generic' WHEN 1 THEN 'spec' || sub_ord ELSE 'segment' || sub_ord END AS request,
       line_no::BIGINT AS line_no, question
FROM ql""")
def extractive_questions(spark, sf):
    a = G.with_sentences(arts(spark, sf))
    s = F.col("_items")
    reqs = [F.struct(F.lit("generic").alias("request"), G.generic_questions(s).alias("qs"))]
    for o, _c, _s, n in P.QUESTION_SPECS:
        if o > 0:
            reqs.append(F.struct(F.lit(f"spec{o}").alias("request"),
                                 G.parsed_questions(s, n, o).alias("qs")))
    for i, seg in enumerate(G.segment_sentences(s, P.SEGMENT_COUNT)):
        reqs.append(F.struct(F.lit(f"segment{i}").alias("request"),
                             G.parsed_questions(seg, P.SEGMENT_QUESTION_COUNT, 0).alias("qs")))
    r = R.explode_rows(a, ["article_index"], F.array(*reqs), "r")
    return (R.posexplode_rows(r, ["article_index", "r.request"], F.col("r.qs"), "line_no", "question")
            .select("article_index", "request", (F.col("line_no") + 1).cast("long").alias("line_no"),
                    "question"))


_ANSWER_CTE = ",\n".join([
    QUESTIONS_CTE,
    "gq AS (SELECT article_index, category, q_seq AS q_no, question FROM qlong)",
    f"gt AS (SELECT article_index, q_no, {Q.tokens('question')} AS qt FROM gq)",
    f"aw AS (SELECT article_index, pos, s, w, {Q.tokens('s')} AS st FROM au)",
    "au2 AS (SELECT gt.article_index, gt.q_no, aw.pos, aw.s, aw.w, len(list_intersect(aw.st, gt.qt)) AS ov "
    "FROM gt JOIN aw ON aw.article_index = gt.article_index)",
    budget_cte("ans", "au2", "article_index, q_no", "-ov", str(BUDGET)),
])


def all_questions(items):
    """Generic, targeted and segment questions of an article, in this order."""
    return F.concat(G.generic_questions(items), G.targeted_questions(items), G.segment_questions(items))


@register("render_answer_prompts", _with(QUESTIONS_CTE) + f"""
SELECT gq.article_index, gq.q_seq::BIGINT AS q_seq,
       {_sql_md5_len(_sql_format(P.ANSWER_FORMAT, 'gq.question', "'" + str(BUDGET) + "'", 'a.content'), 'prompt')}
FROM qlong gq JOIN arts a ON a.article_index = gq.article_index""")
def render_answer_prompts(spark, sf):
    a = G.with_sentences(arts(spark, sf))
    q = R.posexplode_rows(a, ["article_index", "content"], all_questions(F.col("_items")), "q_seq", "question")
    return q.select("article_index", F.col("q_seq").cast("long").alias("q_seq"),
                    *_md5_len(P.answer_prompt("question", BUDGET, "content"), "prompt"))


@register("extractive_answers", _with(_ANSWER_CTE) + f"""
SELECT article_index, q_no::BIGINT AS q_seq,
       {Q.wc(f"array_to_string(list_slice(string_split(txt, ' '), 1, {BUDGET}), ' ')")}::BIGINT AS n_words,
       md5(array_to_string(list_slice(string_split(txt, ' '), 1, {BUDGET}), ' ')) AS answer_md5
FROM ans""")
def extractive_answers(spark, sf):
    a = G.with_sentences(arts(spark, sf))
    a = a.select("article_index", "_items", G.answer_items(F.col("_items")).alias("_aitems"))
    q = R.posexplode_rows(a, ["article_index", "_aitems"], all_questions(F.col("_items")), "q_seq", "question")
    ans = G.extractive_answer(F.col("_aitems"), "question", BUDGET)
    return (q.select("article_index", F.col("q_seq").cast("long").alias("q_seq"), ans.alias("answer"))
            .select("article_index", "q_seq", TX.word_count("answer").cast("long").alias("n_words"),
                    F.md5("answer").alias("answer_md5")))


@register("bm25_answers", _with(",\n".join([
    QUESTIONS_CTE,
    f"st AS (SELECT article_index, pos, s, w, {Q.tokens('s')} AS t FROM au)",
    "tm AS (SELECT article_index, pos, w, len(t) AS n, unnest(t) AS word FROM st)",
    "tf AS (SELECT article_index, pos, w, n, word, count(*) AS tf FROM tm GROUP BY ALL)",
    "df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)",
    "co AS (SELECT count(*) AS sentences, avg(len(t)) AS mean FROM st)",
    f"qw AS (SELECT DISTINCT article_index, q_seq, unnest({Q.tokens('question')}) AS word FROM qlong)",
    f"sc AS (SELECT qw.article_index, q_seq, pos, w, round(sum(ln(1 + (sentences - df + 0.5) / (df + 0.5)) * tf * {AN.K1 + 1} "
    f"/ (tf + {AN.K1} * ({1 - AN.B} + {AN.B} * n / mean))), 6) AS score FROM qw JOIN df USING (word) "
    "JOIN tf ON tf.article_index = qw.article_index AND tf.word = qw.word, co GROUP BY ALL)",
    "rk AS (SELECT *, sum(w) OVER o AS cum, row_number() OVER o AS rn FROM sc "
    "WINDOW o AS (PARTITION BY article_index, q_seq ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING))",
    f"an AS (SELECT rk.article_index, q_seq, string_agg(st.s, ' ' ORDER BY rk.pos) AS answer FROM rk "
    f"JOIN st ON st.article_index = rk.article_index AND st.pos = rk.pos WHERE rn = 1 OR cum <= {BUDGET} GROUP BY ALL)",
])) + """
SELECT q.article_index, q.q_seq::BIGINT AS q_seq, md5(coalesce(answer, '')) AS answer_md5
FROM qlong q LEFT JOIN an ON an.article_index = q.article_index AND an.q_seq = q.q_seq""")
def bm25_answers(spark, sf):
    """Every question of every article, answered by corpus statistics."""
    a = arts(spark, sf)
    q = R.posexplode_rows(G.with_sentences(a), ["article_index"], all_questions(F.col("_items")), "q_seq", "question")
    return AN.answer(a, q, BUDGET).select("article_index", F.col("q_seq").cast("long").alias("q_seq"), F.md5("answer").alias("answer_md5"))


@register("budget_optimal", _with(",\n".join([
    ARTS_CTE,
    units_cte("au", "arts", "article_index", "content"),
    f"va AS (SELECT article_index, pos, w, len(list_distinct({Q.tokens('s')})) AS v FROM au)",
    f"gr AS (SELECT *, sum(w) OVER (PARTITION BY article_index ORDER BY v DESC, pos ROWS UNBOUNDED PRECEDING) AS cum FROM va)",
    f"ga AS (SELECT article_index, coalesce(sum(v) FILTER (cum <= {BUDGET}), 0) AS greedy FROM gr GROUP BY article_index)",
    "it AS (SELECT article_index, list([w, v] ORDER BY pos) AS xs FROM va GROUP BY article_index)",
    # the state is a list of the best values of at most 0, 1, ... words, the items are [words, value]
    f"dp AS (SELECT article_index, list_reduce([list_transform(range({BUDGET + 1}), lambda c: 0::BIGINT)] || xs, lambda best, x: "
    f"list_transform(range({BUDGET + 1}), lambda c: CASE WHEN c >= x[1] THEN greatest(best[c + 1], best[c + 1 - x[1]] + x[2]) "
    f"ELSE best[c + 1] END)) AS best FROM it)",
])) + f"""
SELECT a.article_index, coalesce(greedy, 0)::BIGINT AS greedy_value, coalesce(best[{BUDGET + 1}], 0)::BIGINT AS best_value
FROM arts a LEFT JOIN ga USING (article_index) LEFT JOIN dp USING (article_index)""")
def budget_optimal(spark, sf):
    """Words of information within the budget: taken greedily, and solved."""
    a = G.with_sentences(arts(spark, sf)).select("article_index", G.valued_items(F.col("_items")).alias("v"))
    return a.select("article_index", G.greedy_value(F.col("v"), BUDGET).alias("greedy_value"),
                    G.best_within_budget(F.col("v"), BUDGET)["value"].alias("best_value"))


_LEN_VALUES = "(VALUES " + ", ".join(f"({n})" for n in LENGTHS) + ") AS lv(length)"
_BY_LENGTH_CTE = ",\n".join([
    ARTS_CTE,
    units_cte("au", "arts", "article_index", "content"),
    f"aul AS (SELECT au.*, lv.length FROM au, {_LEN_VALUES})",
    budget_cte("bl", "aul", "article_index, length", "pos", "length"),
])


@register("perspectives_by_length", _with(_BY_LENGTH_CTE) + f"""
SELECT article_index, length::BIGINT AS length, {Q.wc('txt')}::BIGINT AS n_words, md5(txt) AS perspective_md5
FROM bl""")
def perspectives_by_length(spark, sf):
    a = arts(spark, sf)
    # sentences are split once an article, not once a length
    a = G.with_sentences(a).select("article_index", "_items")
    of = F.array(*[F.struct(F.lit(n).cast("long").alias("length"), G.lead_sentences(F.col("_items"), n).alias("p")) for n in LENGTHS])
    return (R.explode_rows(a, ["article_index"], of, "r")
            .select("article_index", F.col("r.length").alias("length"), F.col("r.p").alias("p"))
            .select("article_index", "length", TX.word_count("p").cast("long").alias("n_words"),
                    F.md5("p").alias("perspective_md5")))


@register("count_perspective_words", _with(_BY_LENGTH_CTE) + f"""
SELECT length::BIGINT AS length, sum({Q.wc('txt')})::BIGINT AS total_words FROM bl GROUP BY length""")
def count_perspective_words(spark, sf):
    """Total word count of the length-``n`` perspectives, per length (A1);
    wide columns ``perspectives<n>`` are made by projection, not pivot."""
    a = arts(spark, sf)
    wide = a.select(*[G.extractive_summary("content", n).alias(f"perspectives{n}") for n in LENGTHS])
    sums = wide.agg(*[F.sum(TX.word_count(f"perspectives{n}")).alias(str(n)) for n in LENGTHS])
    stack = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("length"),
                                         F.col(f"`{n}`").cast("long").alias("total_words"))
                                for n in LENGTHS]))
    return sums.select(stack.alias("r")).select("r.length", "r.total_words")


@register("process_first_n", _with(_BY_LENGTH_CTE) + f"""
SELECT a.article_index, a.title, {Q.wc('bl.txt')}::BIGINT AS n_words, md5(bl.txt) AS perspectives_md5
FROM (SELECT * FROM arts ORDER BY article_index LIMIT {FIRST_N}) a
JOIN bl ON bl.article_index = a.article_index AND bl.length = {BUDGET}""")
def process_first_n(spark, sf):
    first = tables.first_n(arts(spark, sf), FIRST_N)
    out = first.withColumn("perspectives", G.extractive_summary("content", BUDGET))
    return out.select("article_index", "title", TX.word_count("perspectives").cast("long").alias("n_words"),
                      F.md5("perspectives").alias("perspectives_md5"))


@register("bulk_file_job", _with(_BY_LENGTH_CTE) + f"""
SELECT a.article_index, a.title, a.link, md5(a.content) AS content_md5, md5(bl.txt) AS perspectives_md5
FROM (SELECT * FROM arts ORDER BY article_index LIMIT {FIRST_N}) a
JOIN bl ON bl.article_index = a.article_index AND bl.length = {BUDGET}""")
def bulk_file_job(spark, sf):
    """T8 from file to file: read JSON arrays, take the first records, add
    their perspectives, write JSON."""
    a = arts(spark, sf)
    source, target = scratch_path(spark, "bulk_in"), scratch_path(spark, "bulk_out")
    files.write_json_arrays(a, source)
    first = tables.first_n(files.read_json(spark, source, a.schema, multi_line=True), FIRST_N)
    out = first.withColumn("perspectives", G.extractive_summary("content", BUDGET))
    files.write_json(out, target)
    return (files.read_json(spark, target, out.schema)
            .select("article_index", "title", "link", F.md5("content").alias("content_md5"),
                    F.md5("perspectives").alias("perspectives_md5")))


@register("generate_callable", _with(ARTS_CTE, f"p AS (SELECT article_index, "
          f"{_sql_format(P.GENERIC_Q_FORMAT, repr(str(P.GENERIC_QUESTION_COUNT)), 'content')} AS prompt FROM arts)") + """
SELECT article_index, length(prompt) || ' ' || right(prompt, 40) AS response, md5(prompt) AS prompt_key FROM p""")
def generate_callable(spark, sf):
    """A user's generator over prompt batches; this one echoes the prompt's
    length and end, so that its responses can be checked."""
    def make():
        return lambda prompts: [f"{len(p)} {p[-40:]}" for p in prompts]

    p = arts(spark, sf).select("article_index", P.generic_question_prompt(P.GENERIC_QUESTION_COUNT, "content").alias("prompt"))
    return G.generate_with(p, "prompt", make).select("article_index", "response", "prompt_key")


# --------------------------------------------------------------- dataset
def _agg_cat(cat: int, name: str) -> str:
    return (f"{name} AS (SELECT article_index, count(*)::BIGINT AS n, "
            f"string_agg(question, chr(10) ORDER BY sub_ord, line_no) AS j FROM ql "
            f"WHERE cat_ord = {cat} GROUP BY article_index)")


@register("build_dataset", _with(PERSPECTIVES_CTE, QUESTIONS_CTE.replace(ARTS_CTE + ",\n", "").replace(
        units_cte("au", "arts", "article_index", "content") + ",\n", ""),
        _agg_cat(0, "g0"), _agg_cat(1, "g1"), _agg_cat(2, "g2"),
        "pa AS (SELECT article_index, count(*)::BIGINT AS n, string_agg(perspective, chr(10) ORDER BY seq) AS j "
        "FROM persp GROUP BY article_index)") + """
SELECT a.article_index, a.title, a.link, md5(a.content) AS content_md5,
       coalesce(g0.n, 0) AS n_generic, coalesce(g1.n, 0) AS n_target, coalesce(g2.n, 0) AS n_segment,
       pa.n AS n_perspectives,
       md5(coalesce(g0.j, '')) AS generic_md5, md5(coalesce(g1.j, '')) AS target_md5,
       md5(coalesce(g2.j, '')) AS segment_md5, md5(pa.j) AS perspectives_md5
FROM arts a LEFT JOIN g0 USING (article_index) LEFT JOIN g1 USING (article_index)
LEFT JOIN g2 USING (article_index) JOIN pa USING (article_index)""")
def build_dataset(spark, sf):
    d = dataset(spark, sf)

    def j(c):
        return F.md5(F.array_join(c, "\n"))

    return d.select("article_index", "title", "link", F.md5("content").alias("content_md5"),
                    F.size("genericQuestions").cast("long").alias("n_generic"),
                    F.size("targetQuestions").cast("long").alias("n_target"),
                    F.size("segmentQuestions").cast("long").alias("n_segment"),
                    F.size("sumarries").cast("long").alias("n_perspectives"),
                    j("genericQuestions").alias("generic_md5"), j("targetQuestions").alias("target_md5"),
                    j("segmentQuestions").alias("segment_md5"), j("sumarries").alias("perspectives_md5"))


@register("explode_perspectives", _with(PERSPECTIVES_CTE) + """
SELECT article_index, seq::BIGINT AS seq, md5(perspective) AS perspective_md5 FROM persp""")
def explode_perspectives(spark, sf):
    d = dataset(spark, sf)
    return (d.select("article_index", F.posexplode_outer("sumarries").alias("seq", "p"))
            .select("article_index", F.col("seq").cast("long").alias("seq"), F.md5("p").alias("perspective_md5")))


@register("perspective_at_seq", _with(PERSPECTIVES_CTE) + f"""
SELECT article_index, md5(perspective) AS perspective_md5 FROM persp WHERE seq = {AT_SEQ}""")
def perspective_at_seq(spark, sf):
    d = dataset(spark, sf)
    return d.select("article_index", F.md5(F.get("sumarries", AT_SEQ)).alias("perspective_md5"))


def question_long(d):
    """One row per question with its running number across
    generic ++ targeted ++ segment, and its number within the category."""
    g, t = F.size("genericQuestions"), F.size("targetQuestions")
    q = R.posexplode_rows(d, ["article_index", g.alias("_g"), t.alias("_t")],
                          F.concat("genericQuestions", "targetQuestions", "segmentQuestions"),
                          "q_seq", "question")
    cat = (F.when(F.col("q_seq") < F.col("_g"), "generic")
           .when(F.col("q_seq") < F.col("_g") + F.col("_t"), "targeted").otherwise("segment"))
    cat_seq = (F.when(F.col("q_seq") < F.col("_g"), F.col("q_seq"))
               .when(F.col("q_seq") < F.col("_g") + F.col("_t"), F.col("q_seq") - F.col("_g"))
               .otherwise(F.col("q_seq") - F.col("_g") - F.col("_t")))
    return q.select("article_index", cat.alias("category"), cat_seq.cast("long").alias("cat_seq"),
                    F.col("q_seq").cast("long").alias("q_seq"), "question")


@register("question_long", _with(QUESTIONS_CTE) + """
SELECT article_index, category, cat_seq::BIGINT AS cat_seq, q_seq::BIGINT AS q_seq, question FROM qlong""")
def question_long_q(spark, sf):
    return question_long(dataset(spark, sf))
