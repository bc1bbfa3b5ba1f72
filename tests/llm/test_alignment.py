"""Cross-tokenizer alignment: against whole-text encoding by the two libraries,
the fragment monoid, odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refract.llm import alignment
from refract.llm.alignment import EMPTY, Tokens, compose, finished, fragment

FILES = alignment.paths()
SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, links string, part int, rid string"


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, groups), each text encoded whole."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    def run(text):
        if not text:
            return [], [], []
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            return [], [], []
        ea, eb = ends(ta), ends(tb)
        groups, p, q = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            x, y = ea.index(e, p) + 1, eb.index(e, q) + 1
            groups.append((ia[p:x], ib[q:y]))
            p, q = x, y
        return ia, ib, groups
    return run


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def odd_texts():
    r = random.Random(3)
    signs = ["don't", "we're", "naïve", "漢字", "。", "𝒳𝒴", "é", " ", " ", "　", " ", "\t", "\n", "\r\n", " ", "  ", "\x1c", "\0",
             "<|endoftext|>", "<s>", "</s>", "<0x0A>", "x²", "½", "1234567", "3.14", "'s", "''", "﻿", "ａｂ", "ﬁ", "🙂🙂", "ﷺ", "_", "−", "@#$%", "ABC", "ß"]
    out = [None, "", " ", "\n", "a", " a", "a ", "  a  b  ", "a▁b", "▁", "x" * 3000, "é" * 2000, "漢" * 900, "ab" * 1500 + "." * 40 + "cd" * 700]
    for _ in range(300):
        out.append("".join(r.choice(signs) + r.choice(["", " ", " ", "a", "\n"]) for _ in range(r.randint(1, 40))))
    return out


def check(spark, plain, rows, **how):
    df = spark.createDataFrame([(i, t, "l", 1, "r") for i, t in rows], SCHEMA).repartition(4)
    got = alignment.align(df, **how).collect()
    assert len(got) == len(rows)
    size_b = 32000
    want = Counter()
    for i, t in rows:
        a, b, g = plain(t)
        want[i, len(a), len(b), len(g), written(g), tuple(x[-1] * size_b + y[-1] for x, y in g)] += 1
    assert Counter((r.id, r.n_a, r.n_b, r.n_groups, r.groups, tuple(r.links)) for r in got) == want


def test_like_whole_texts(spark, plain):
    check(spark, plain, [*enumerate(odd_texts()), (None, "a null id"), (5, "again"), (5, "again")])


@pytest.mark.parametrize("part", [5, 40, 333])
def test_long_texts_in_parts_like_whole_texts(spark, plain, part):
    texts = odd_texts()
    texts += [" ".join(t for t in texts[20 * k:20 * k + 20] if t) for k in range(8)]
    check(spark, plain, [*enumerate(texts), (None, "a null id"), (5, "again and again"), (5, "again and again")], long=0 if part > 5 else 30, part=part)


def test_the_query_counts_over_the_corpus(spark, plain):
    rows = {r.doc_id: r for r in alignment.query(spark, SF).collect()}
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = Counter((a[-1], b[-1]) for _, _, g in docs.values() for a, b in g)
    best = {}
    for (_, b), k in n.items():
        best[b] = max(best.get(b, 0), k)
    assert set(rows) == set(docs)
    for i, (a, b, g) in docs.items():
        links = [(x[-1], y[-1]) for x, y in g]
        assert tuple(rows[i]) == (i, len(a), len(b), len(g), len(links), sum(n[p] == best[p[1]] for p in links), sum(n[p] for p in links),
                                  hashlib.sha256(written(g).encode()).hexdigest() if g else "")
    assert len(n) <= alignment.pair_bound(alignment.vocabularies(*FILES)) < 400_000


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    a = alignment.align(df)
    assert a.collect() == [] and alignment.score(a, FILES).collect() == []


@st.composite
def streams(draw):
    """Two token streams over the same bytes, and places where to cut each."""
    n = draw(st.integers(1, 40))
    side = lambda: sorted({*draw(st.lists(st.integers(1, n), max_size=25)), n})
    a, b = side(), side()
    k = draw(st.integers(0, 5))
    places = lambda m: sorted(draw(st.lists(st.integers(0, m), min_size=k, max_size=k)))
    return a, b, places(len(a)), places(len(b)), draw(st.integers(0, 2 ** 30))


def same(x, y):
    flat = lambda f: (f.n_a, f.n_b, f.closed, *[t.tolist() for t in (*f.prefix, *f.suffix)], f.groups.n, f.groups.links.tolist(), f.groups.text)
    return flat(x) == flat(y)


@settings(max_examples=400, deadline=None)
@given(streams())
def test_fragments_compose_associatively_to_the_whole(s):
    a, b, pa_, pb_, seed = s
    t = Tokens(np.arange(len(a)), np.array(a), np.arange(len(b)), np.array(b))
    whole = fragment(t, 1000)
    parts = [fragment(t.cut(i, j, k, m), 1000) for i, j, k, m in zip([0, *pa_], [*pa_, len(a)], [0, *pb_], [*pb_, len(b)])]
    r = random.Random(seed)
    while len(parts) > 1:                                   # any order of composing gives the same
        k = r.randrange(len(parts) - 1)
        parts[k:k + 2] = [compose(parts[k], parts[k + 1], 1000)]
    assert same(parts[0], whole) and same(compose(EMPTY, whole, 1000), whole) and same(compose(whole, EMPTY, 1000), whole)
    groups, p, q = [], 0, 0
    for e in sorted(set(a) & set(b)):
        x, y = a.index(e) + 1, b.index(e) + 1
        groups.append((list(range(p, x)), list(range(q, y))))
        p, q = x, y
    done = finished(parts[0], 1000)
    assert done.text == written(groups) and done.n == len(groups) and done.links.tolist() == [x[-1] * 1000 + y[-1] for x, y in groups]
