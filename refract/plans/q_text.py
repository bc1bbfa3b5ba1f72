"""Registered queries: text functions and HTML extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from refract.functions import html as H
from refract.functions import text as TX
from refract.operators import sentence_model as SM
from refract.plans import sqlx as Q
from refract.plans.catalog import register
from refract.sources import tables
from refract.functions import rows as R

# Paragraph separator for the driver documents: they contain no blank lines,
# so paragraphs are single lines (FIXTURES).
PARA_SEP = "\n"
CONTEXT_N = 5
HTML_CONTAINER = "article"


def _docs(spark, sf):
    return tables.read_table(spark, sf, "documents")


@register("word_count", f"""
SELECT doc_id, {Q.wc('text')}::BIGINT AS n_words,
       {Q.wc(Q.strip_title('text', Q.first_line('text')))}::BIGINT AS body_words
FROM documents""")
def word_count(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", TX.word_count("text").cast("long").alias("n_words"),
                    TX.word_count(TX.strip_title("text", TX.first_line("text")))
                    .cast("long").alias("body_words"))


@register("strip_title", f"""
SELECT doc_id,
       length({Q.strip_title('text', Q.first_line('text'))})::BIGINT AS body_len,
       md5({Q.strip_title('text', Q.first_line('text'))}) AS body_md5,
       strpos(text, lang) > 0 AS lang_found,
       md5({Q.strip_title('text', 'lang')}) AS lang_strip_md5
FROM documents""")
def strip_title(spark, sf):
    d = _docs(spark, sf)
    body = TX.strip_title("text", TX.first_line("text"))
    return d.select("doc_id", F.length(body).cast("long").alias("body_len"),
                    F.md5(body).alias("body_md5"),
                    TX.title_found("text", "lang").alias("lang_found"),
                    F.md5(TX.strip_title("text", "lang")).alias("lang_strip_md5"))


@register("sentences", f"""
WITH s AS (SELECT doc_id, {Q.sentences('text')} AS ss FROM documents),
u AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sent_pos, unnest(ss) AS s FROM s)
SELECT doc_id, sent_pos::BIGINT AS sent_pos, {Q.wc('s')}::BIGINT AS n_words, md5(s) AS sent_md5
FROM u""")
def sentences(spark, sf):
    d = _docs(spark, sf)
    return (R.posexplode_rows(d, ["doc_id"], TX.sentences("text"), "sent_pos", "s")
            .select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"),
                    TX.word_count("s").cast("long").alias("n_words"),
                    F.md5("s").alias("sent_md5")))


# The trained splitter, learnt and applied in SQL as well.
_OPEN, _CLOSE = (x.replace("'", "''") for x in (SM.OPEN, SM.CLOSE))
_W = lambda t: f"lower(regexp_replace({t}, '^{_OPEN}|{_CLOSE}$', '', 'g'))"
_BARE = lambda w: f"regexp_replace({w}, '\\.$', '')"


def _ll_sql(a: str, b: str, ab: str, n: str) -> str:
    a, b, ab, n = (f"({x})::DOUBLE" for x in (a, b, ab, n))

    def part(k, m, p):
        return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {m} > {k} THEN ({m} - {k}) * ln(1 - {p}) ELSE 0 END)"
    return (f"-2 * ({part(ab, a, f'({b} / {n})')} + {part(f'({b} - {ab})', f'({n} - {a})', f'({b} / {n})')}"
            f" - {part(ab, a, f'({ab} / {a})')} - {part(f'({b} - {ab})', f'({n} - {a})', f'(({b} - {ab}) / ({n} - {a}))')})")


def _model_cte(most: str) -> str:
    return f"""
tk AS (SELECT list_filter(regexp_split_to_array(text, '{SM.BLANK}+'), lambda x: x <> '') AS t FROM documents),
pr AS (SELECT unnest(list_zip(t, t[2:])) AS z FROM tk),
tw AS (SELECT {_W('z[1]')} AS w, {_BARE(_W('z[2]'))} AS b FROM pr),
ct AS (SELECT {_BARE('w')} AS a, w LIKE '%.' AS stop, CASE WHEN w LIKE '%.' THEN b END AS b, count(*) AS n FROM tw WHERE {_BARE('w')} <> '' GROUP BY ALL),
tt AS (SELECT sum(n) AS total, sum(n) FILTER (stop) AS stops FROM ct),
wd AS (SELECT a, sum(n) AS n, coalesce(sum(n) FILTER (stop), 0) AS with_stop FROM ct GROUP BY a),
ws AS (SELECT *, n - with_stop AS without, length(regexp_replace(a, '[^.]', '', 'g')) + 1 AS dots, stops / total AS p FROM wd, tt),
sc AS (SELECT a, -2 * ((with_stop * ln(p) + without * ln(1 - p)) - (with_stop * ln({SM.P_STOP}) + without * ln({1 - SM.P_STOP!r})))
       * exp(-(length(a) - dots + 1)) * dots * pow(length(a) - dots + 1, -without) AS score
       FROM ws WHERE with_stop > 0 AND with_stop < total AND length(a) - dots + 1 > 0 AND regexp_matches(a, '\\p{{L}}')),
ab AS (SELECT a, score FROM sc WHERE score >= {SM.ABBREVIATION} ORDER BY score DESC, a{most}),
ps AS (SELECT *, a IN (SELECT a FROM ab) OR regexp_matches(a, '^(\\p{{L}}|[0-9]+)$') AS odd FROM ct WHERE stop AND b <> ''),
br AS (SELECT sum(n) AS breaks FROM ps WHERE NOT odd),
s1 AS (SELECT b, sum(n) AS ab FROM ps WHERE NOT odd AND regexp_matches(b, '\\p{{L}}') GROUP BY b),
s2 AS (SELECT s1.b AS a, {_ll_sql('breaks', 'wd.n', 'ab', 'total')} AS score FROM s1 JOIN wd ON wd.a = s1.b, tt, br
       WHERE ab <= wd.n AND breaks < total AND ab * total > breaks * wd.n),
st AS (SELECT a, score FROM s2 WHERE score >= {SM.STARTER} ORDER BY score DESC, a{most}),
c1 AS (SELECT a, b, sum(n) AS ab FROM ps WHERE odd GROUP BY a, b HAVING sum(n) > 1),
c2 AS (SELECT c1.a, c1.b, {_ll_sql('wa.n', 'wb.n', 'ab', 'total')} AS score FROM c1 JOIN wd wa ON wa.a = c1.a JOIN wd wb ON wb.a = c1.b, tt
       WHERE ab <= wb.n AND wa.n < total AND ab * total > wa.n * wb.n),
cl AS (SELECT a, b, score FROM c2 WHERE score >= {SM.COLLOCATION} ORDER BY score DESC, a, b{most}),
md AS (SELECT 'abbreviation' AS kind, a, NULL AS b, score FROM ab UNION ALL SELECT 'starter', a, NULL, score FROM st
       UNION ALL SELECT 'collocation', a, b, score FROM cl)"""


@register("sentence_model", f"WITH {_model_cte(f' LIMIT {SM.MOST}')} SELECT kind, a, b, round(score, 4) AS score FROM md")
def sentence_model(spark, sf):
    return SM.train(_docs(spark, sf), most=SM.MOST).select("kind", "a", "b", F.round("score", 4).alias("score"))


_LAST = f"regexp_extract(p, '({SM.TOKEN}){SM.BLANK}+$', 1)"
_FIRST = f"regexp_replace(regexp_extract(coalesce(ps[i + 1], ''), '{SM.TOKEN}'), '^{_OPEN}', '')"


@register("sentences_trained", f"""
WITH {_model_cte("")},
ml AS (SELECT coalesce(list(a) FILTER (kind = 'abbreviation'), []) AS abbr, coalesce(list(a) FILTER (kind = 'starter'), []) AS start,
              coalesce(list(a || ' ' || b) FILTER (kind = 'collocation'), []) AS coll FROM md),
pc AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])({SM.BLANK}+)', '\\1\\2' || chr(1), 'g'), chr(1)) AS ps FROM documents),
bk AS (SELECT doc_id, array_to_string(list_transform(ps, lambda p, i: p || CASE WHEN {_LAST} LIKE '%.' AND (
         ((list_contains(abbr, {_BARE(_W(_LAST))}) OR (regexp_matches({_BARE(_W(_LAST))}, '^\\p{{L}}$') AND regexp_matches({_FIRST}, '^\\p{{Lu}}')))
          AND NOT list_contains(start, {_BARE(_W(_FIRST))}))
         OR list_contains(coll, {_BARE(_W(_LAST))} || ' ' || {_BARE(_W(_FIRST))})) THEN '' ELSE chr(1) END), '') AS m FROM pc, ml),
s AS (SELECT doc_id, list_filter(list_transform(string_split(m, chr(1)), lambda x: regexp_replace(x, '^{SM.BLANK}+|{SM.BLANK}+$', '', 'g')),
                                 lambda x: x <> '') AS ss FROM bk),
u AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sent_pos, unnest(ss) AS s FROM s)
SELECT doc_id, sent_pos::BIGINT AS sent_pos, {Q.wc('s')}::BIGINT AS n_words, md5(s) AS sent_md5 FROM u""")
def sentences_trained(spark, sf):
    d = _docs(spark, sf)
    return (R.posexplode_rows(SM.split(d, ["doc_id"], SM.train(d)), ["doc_id"], F.col("sentences"), "sent_pos", "s")
            .select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"),
                    TX.word_count("s").cast("long").alias("n_words"), F.md5("s").alias("sent_md5")))


def _parts_report(df, arr):
    return (R.posexplode_rows(df, ["doc_id"], arr, "part_no", "part")
            .select("doc_id", F.col("part_no").cast("long").alias("part_no"),
                    F.length("part").cast("long").alias("part_len"),
                    F.md5("part").alias("part_md5")))


def _parts_sql(arr_cte: str) -> str:
    return f"""{arr_cte},
u AS (SELECT doc_id, generate_subscripts(arr, 1) - 1 AS part_no, unnest(arr) AS part FROM r)
SELECT doc_id, part_no::BIGINT AS part_no, length(part)::BIGINT AS part_len, md5(part) AS part_md5
FROM u"""


def _halves_sql(parts: str, overlap: int, join: str) -> str:
    n = f"len({parts})"
    mid = f"({n} // 2)"
    o = f"least({mid}, {overlap})"
    return (f"['[title:] ' || title || array_to_string(list_slice({parts}, 1, {mid} + {o}), {join}), "
            f"'[title:] ' || title || '[content:] ' || "
            f"array_to_string(list_slice({parts}, {mid} - {o} + 1, {n}), {join})]")


_SPLIT_PARA_SQL = _parts_sql(f"""
WITH d AS (SELECT doc_id, text AS content, {Q.first_line('text')} AS title FROM documents),
b AS (SELECT *, {Q.strip_title('content', 'title')} AS body FROM d),
p AS (SELECT *, string_split(body, chr(10)) AS parts, {Q.wc('body')} AS bw FROM b),
r AS (SELECT doc_id, CASE WHEN bw < 1600 OR len(parts) <= 3 THEN [content]
      ELSE {_halves_sql('parts', 2, 'chr(10)')} END AS arr FROM p)""")


@register("split_paragraphs", _SPLIT_PARA_SQL)
def split_paragraphs(spark, sf):
    d = _docs(spark, sf)
    return _parts_report(d, TX.split_paragraphs(TX.first_line("text"), "text", sep=PARA_SEP))


_SPLIT_SENT_SQL = _parts_sql(f"""
WITH d AS (SELECT doc_id, text AS content, {Q.first_line('text')} AS title FROM documents),
b AS (SELECT *, {Q.strip_title('content', 'title')} AS body FROM d),
p AS (SELECT *, {Q.sentences('body')} AS parts, {Q.wc('body')} AS bw FROM b),
r AS (SELECT doc_id, CASE WHEN bw < 1600 OR len(parts) <= 6 THEN [content]
      ELSE {_halves_sql('parts', 3, Q.BLANK)} END AS arr FROM p)""")


@register("split_sentences", _SPLIT_SENT_SQL)
def split_sentences(spark, sf):
    d = _docs(spark, sf)
    return _parts_report(d, TX.split_sentences(TX.first_line("text"), "text"))


def _context_sql(count: int) -> str:
    return _parts_sql(f"""
WITH s AS (SELECT doc_id, {Q.sentences('text')} AS ss FROM documents),
r AS (SELECT doc_id, {Q.segments('ss', count)} AS arr FROM s)""")


@register("split_context_3", _context_sql(3))
def split_context_3(spark, sf):
    d = _docs(spark, sf)
    return _parts_report(d, TX.context_segments(TX.sentences("text"), 3))


@register("split_context_n", _context_sql(CONTEXT_N))
def split_context_n(spark, sf):
    d = _docs(spark, sf)
    return _parts_report(d, TX.context_segments(TX.sentences("text"), CONTEXT_N))


@register("embed_normalize", f"""
SELECT doc_id, length({Q.norm('text')})::BIGINT AS n_chars, md5({Q.norm('text')}) AS norm_md5
FROM documents""")
def embed_normalize(spark, sf):
    d = _docs(spark, sf)
    n = TX.embed_normalize("text")
    return d.select("doc_id", F.length(n).cast("long").alias("n_chars"), F.md5(n).alias("norm_md5"))


def _flat_sql(container: str) -> str:
    pat = Q.lit(H.container_pattern(container))
    split = Q.lit(H.BLOCK_SPLIT)
    piece = "trim(replace(replace(regexp_replace(p, '<[^>]*>', '', 'g'), chr(10), ' '), chr(9), ''))"
    for ent, ch in H._ENTITIES:
        piece = f"replace({piece}, {Q.lit(ent)}, {Q.lit(ch)})"
    flat = (f"array_to_string(list_filter(list_transform(regexp_split_to_array(c, {split}), "
            f"lambda p: {piece}), lambda x: x <> ''), ' ')")
    conts = f"regexp_extract_all(html, {pat}, 1)"
    return f"""
SELECT page_id, url,
       CASE WHEN len({conts}) > 0
            THEN array_to_string(list_transform({conts}, lambda c: {flat}), ' ') END AS main_text
FROM pages"""


@register("extract_main_text_flat", _flat_sql(HTML_CONTAINER))
def extract_main_text_flat(spark, sf):
    p = tables.read_table(spark, sf, "pages")
    return p.select("page_id", "url",
                    H.extract_main_text_flat("html", HTML_CONTAINER).alias("main_text"))


@register("extract_main_text")
def extract_main_text(spark, sf):
    p = tables.read_table(spark, sf, "pages")
    t = H.extract_main_text("html", HTML_CONTAINER, None)
    return p.select("page_id", "url", t.alias("main_text"))
