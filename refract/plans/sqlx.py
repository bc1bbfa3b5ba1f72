"""DuckDB expression builders for the oracle SQL.

These restate the library's column semantics in an independent SQL engine
(RE2 regexes, 1-based inclusive list slices, 1-based lambda indices) so the
registered queries can be checked row for row.  Only used to *generate SQL
text*; nothing here runs Spark.
"""

from __future__ import annotations

from refract.functions.text import PY_SPACE

NL = "chr(10)"
BLANK = "(chr(10) || chr(10))"


def wc(e: str) -> str:
    return f"len(string_split(regexp_replace({e}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g'), ' '))"


def first_line(e: str) -> str:
    return f"split_part({e}, chr(10), 1)"


def strip_title(c: str, t: str) -> str:
    return f"substring({c}, strpos({c}, {t}) - 1 + length({t}) + 1)"


def norm(e: str) -> str:
    return f"replace({e}, chr(10), ' ')"


def sentences(e: str) -> str:
    return (f"list_filter(string_split(regexp_replace({e}, '([.!?])\\s+', '\\1' || chr(1), 'g'), "
            f"chr(1)), lambda x: x <> '')")


def has_digit(e: str) -> str:
    return f"regexp_matches({e}, '\\p{{Nd}}')"


def tokens(e: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({norm(e)}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda x: x <> '')")


def bucket(tok: str, dims: int) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 8))::BIGINT % {dims})"


def buckets_md5(e: str, dims: int) -> str:
    """Digest of a text's bucket ids in order."""
    return f"md5(array_to_string(list_transform({tokens(e)}, lambda t: {bucket('t', dims)}::VARCHAR), ','))"


def vector_md5(e: str) -> str:
    """Digest of a float vector's components in millionths."""
    return f"md5(array_to_string(list_transform({e}, lambda v: floor(v::DOUBLE * 1e6)::BIGINT::VARCHAR), ','))"


def segment_bounds(n: str, count: int, i: int) -> tuple[str, str]:
    """1-based inclusive (start, end) of segment ``i`` over ``n`` sentences."""
    k = f"({n} // {count})"
    o = f"least({k}, 3)"
    if i == 0:
        return "1", f"({k} + {o})"
    if i == count - 1:
        return f"({k} * {i} - {o} + 1)", n
    return f"({k} * {i} - {o} + 1)", f"({k} * {i + 1} + {o})"


def segments(sents: str, count: int) -> str:
    parts = []
    for i in range(count):
        a, b = segment_bounds(f"len({sents})", count, i)
        parts.append(f"array_to_string(list_slice({sents}, {a}, {b}), {BLANK})")
    return "[" + ", ".join(parts) + "]"


def lit(s: str) -> str:
    """SQL string literal (newlines kept verbatim)."""
    return "'" + s.replace("'", "''") + "'"


def perspective_key(seq: str, s: str, pos: str, n: str, w: str) -> str:
    return (f"CASE {seq} WHEN 0 THEN {pos} WHEN 1 THEN -{pos} WHEN 2 THEN -length({s}) "
            f"WHEN 3 THEN length({s}) WHEN 4 THEN (CASE WHEN {has_digit(s)} THEN 0 ELSE 1 END) "
            f"WHEN 5 THEN -{w} WHEN 6 THEN abs(2 * {pos} - ({n} - 1)) END")


def question_key(spec: str, s: str, pos: str, w: str) -> str:
    return (f"CASE {spec} WHEN 0 THEN {pos} WHEN 1 THEN (CASE WHEN {has_digit(s)} THEN 0 ELSE 1 END) "
            f"WHEN 2 THEN -{w} WHEN 3 THEN -{pos} END")


def as_question(s: str) -> str:
    return f"(regexp_replace({s}, '[.!?]+$', '') || '?')"
