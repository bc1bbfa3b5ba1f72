"""Exact dedup, n-gram groups, near vectors, components and repeated passages
against brute force on small fixtures."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refract.llm import common, components, exact_dedup, near_vectors, ngram_join, passages, vec

DOC = "doc_id long, text string, lang string, source string, n_chars long, rid string, id string, cls string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with internal ones."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z") for i, t in zip(ids, texts)], DOC)


def words(t):
    low = (t or "").encode().translate(bytes.maketrans(common.UPPER.encode(), common.LOWER.encode()))
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


def shingle_set(t, k=5):
    w = words(t)
    if len(w) >= k:
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts(seed, families=6, each=8, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ä", "naïve", "the", "of"]
    out = []
    for _ in range(families):
        base = [r.choice(vocab) for _ in range(r.randint(5, n))]
        for _ in range(r.randint(1, each)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocab)
            out.append(r.choice([" ", "\n", "  "]).join(t).upper() if r.random() < 0.2 else " ".join(t))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0béż。", max_size=30)), max_size=8))
def test_words_match_the_pattern(texts):
    row, h = vec.Words().split(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert row.tolist() == [i for i, _ in want]
    names = defaultdict(set)
    for x, (_, w) in zip(h.tolist(), want):
        names[x].add(w)
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({w for _, w in want})


def test_words_over_chunks(monkeypatch):
    monkeypatch.setattr(vec, "CHUNK", 64)
    texts = ["x" * 300 + " yy  z", None, "", "ab " * 200, "end"]
    row, h = vec.Words().split(pa.array(texts))
    assert np.bincount(row, minlength=5).tolist() == [3, 0, 0, 200, 1]
    assert len(set(h[3:203].tolist())) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=30))
def test_forest(edges):
    want = union_find(range(16), edges)
    assert all(want[k] == v for k, v in components.forest(edges).items())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1300)] + [(5, 5), (None, 3), (2000, 2001), (2000, 2001)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components.connected_components(df, "a", "b").collect()}
    want = {**{i: 0 for i in range(1, 301)}, **{x: 1000 for x in range(1001, 1300)}, 2001: 2000}
    assert got == want
    assert components.connected_components(df.where("a < 0"), "a", "b").count() == 0


def test_misra_gries_keeps_what_is_frequent():
    r = random.Random(1)
    rows = ["hot"] * 300 + ["warm"] * 150 + [f"k{i}" for i in range(2000)]
    r.shuffle(rows)
    held: dict = {}
    for i in range(0, len(rows), 97):
        n = defaultdict(int)
        for x in rows[i:i + 97]:
            n[x] += 1
        held = exact_dedup.merge_counts(held, n, 64)
    assert len(held) <= 64
    for k, n in (("hot", 300), ("warm", 150)):
        assert n - len(rows) / 65 <= held[k] <= n


@pytest.mark.parametrize("heavy", [2, 256])
def test_exact_groups(spark, heavy):
    texts = ["Same Text"] * 40 + ["same text", "SAME TEXT", "Ä", "ä", None, "", "", "x" * 200_000, "X" * 200_000, "one", "two"]
    df = frame(spark, texts).repartition(5)
    got = {r.id: r for r in exact_dedup.exact_groups(df, heavy=heavy).collect()}
    group = defaultdict(list)
    for i, t in enumerate(texts):
        group[(t or "").translate(str.maketrans(common.UPPER, common.LOWER))].append(i)
    for t, ids in group.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert bytes(r.digest) == hashlib.sha256(t.encode()).digest()
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {max(v) for v in group.values()}


def test_exact_null_and_repeated_ids(spark):
    df = frame(spark, ["a", "a", "b", "c", "c"], [None, None, 7, 7, 7])
    kept = exact_dedup.drop_copies(df).collect()
    assert sorted((r.text, r.doc_id or -1) for r in kept) == [("a", -1), ("b", 7), ("c", 7)]
    assert exact_dedup.drop_copies(df.where("doc_id < 0")).count() == 0


def test_ngram_groups_against_brute_force(spark):
    texts = near_texts(5, families=25) + ["", None, " \n", "a", "A", "a b c", "a b  C", "a b d"] + ["the of the of the of the"] * 30
    texts += [" ".join(["word"] * 3000), " ".join(f"v{i}" for i in range(8000)), " ".join(f"v{i}" for i in range(8100))]
    df = frame(spark, texts).repartition(6)
    got = {r.id: r for r in ngram_join.jaccard_components(df).collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = []
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 75 * len(a | sets[j]):
                pairs.append((i, j))
    want = union_find(range(len(texts)), pairs)
    assert len(pairs) > 300 and {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_ngram_chain_of_groups_over_the_second_step(spark):
    """Links that no pivot has are found: a chain where each text is like the
    next one only."""
    base = [f"t{i}" for i in range(400)]
    texts = [" ".join(base[18 * s:18 * s + 140]) for s in range(12)]
    got = ngram_join.jaccard_components(frame(spark, texts)).collect()
    assert {r.component_id for r in got} == {0}


def test_ngram_null_ids_and_empty(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", "q"], [None, 4, None])
    got = {(r.id, r.component_id, r.kept) for r in ngram_join.jaccard_components(df).collect()}
    assert got == {(None, None, True), (None, 4, False), (4, 4, True)}
    assert ngram_join.jaccard_components(df.where("doc_id < 0")).count() == 0


def vectors(seed=0, labels=3, each=60, dim=16):
    g = np.random.default_rng(seed)
    rows = []
    for lab in range(labels):
        centres = g.standard_normal((each // 6, dim))
        for _ in range(each):
            rows.append((len(rows), (centres[g.integers(len(centres))] + 0.22 * g.standard_normal(dim)).astype(np.float32).tolist(), lab))
    hot = g.standard_normal(dim)
    for _ in range(1300):
        rows.append((len(rows), (hot + 0.05 * g.standard_normal(dim)).astype(np.float32).tolist(), 1))
    rows += [(len(rows) + i, v, lab) for i, (v, lab) in enumerate([
        (None, 1), ([], 1), ([0.0] * dim, 1), ([float("nan")] * dim, 1), ([None] + [1.0] * (dim - 1), 1),
        (rows[0][1], None), (rows[0][1][:8], 0), (rows[0][1], 0)])]
    return rows


def test_near_vectors_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(df).collect()}
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    pairs = []
    for lab in {r[2] for r in ok}:
        for size in {len(r[1]) for r in ok}:
            ids = np.array([r[0] for r in ok if r[2] == lab and len(r[1]) == size])
            if not len(ids):
                continue
            x = np.array([r[1] for r in ok if r[2] == lab and len(r[1]) == size], np.float32).astype(np.float64)
            n = np.sqrt((x * x).sum(axis=1))
            i, j = np.nonzero(np.triu((x @ x.T) / np.outer(n, n) >= near_vectors.THRESHOLD, 1))
            pairs += list(zip(ids[i].tolist(), ids[j].tolist()))
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and found <= 2 * len(pairs) and found >= 0.995 * 2 * len(pairs)
    assert all(r.n_links <= links[i] for i, r in got.items())
    want = union_find([r[0] for r in rows], pairs)
    assert sum(got[i].component_id != want[i] for i in want) <= 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_vectors_empty_and_repeated(spark):
    schema = "vec_id string, embedding array<double>, label string"
    assert near_vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_vectors.near_duplicates(spark.createDataFrame([("a", [1.0, 2.0], "x")] * 2 + [("b", [2.0, 4.0], "x"), ("c", [1.0, 2.0], "y")], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [("a", 2, "a"), ("a", 2, "a"), ("b", 2, "a"), ("c", 0, "c")]


def test_near_vectors_of_many_equal_ones(spark, monkeypatch):
    """Copies are compared once; their links are all counted."""
    g = np.random.default_rng(8)
    one, far = g.standard_normal(16), g.standard_normal(16)
    near = [one + 0.05 * g.standard_normal(16) for _ in range(3)]
    rows = [one] * 3000 + near + [near[0]] * 2 + [far] * 50 + [np.full(16, np.nan)] * 2
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(7)
    seen = []
    real = near_vectors.plan
    monkeypatch.setattr(near_vectors, "plan", lambda n, *a: seen.append(n) or real(n, *a))
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(df).collect()}
    assert seen == [6]                                       # one, three near ones, far, and the one that can't link
    assert {got[i] for i in range(3005)} == {(3004, 0)} and {got[i] for i in range(3005, 3055)} == {(49, 3005)}
    assert [got[i] for i in (3055, 3056)] == [(0, 3055), (0, 3056)]


def test_plan_follows_the_rows():
    small, large = near_vectors.plan(1000, 0.93), near_vectors.plan(10 ** 9, 0.93)
    assert small[0] < large[0] and small[1] < large[1]


def plain_runs(text, least):
    """(start, end, what is compared) by the docstring's rules, with loops."""
    out = set()
    at = 0
    for line in (text or "").split("\n"):
        ends, i = [], 0
        while i < len(line):
            if line[i] in ".!?":
                while i < len(line) and line[i] in ".!?":
                    i += 1
                if i == len(line) or not (line[i].isalnum() or line[i] == "_"):
                    ends.append(i)
            elif line[i].isspace() and i and not line[i - 1].isspace() and line[i - 1] not in ".!?":
                while i < len(line) and line[i].isspace():
                    i += 1
                if i < len(line) and line[i] in "ABCDEFGHIJKLMNOPQRSTUVWXYZÉ":
                    ends.append(i)
            else:
                i += 1
        units = [(s, e) for s, e in zip([0, *ends], [*ends, len(line)]) if line[s:e].split()]
        low = lambda s, e: " ".join(line[s:e].lower().split())
        n = lambda i, j: sum(len(line[s:e].split()) for s, e in units[i:j])

        def add(i, j, kind):
            s, e = units[i][0], units[j - 1][1]
            body = line[s:e]
            out.add((at + s + len(body) - len(body.lstrip()), at + s + len(body.rstrip()), kind + low(s, e)))
        if units and n(0, len(units)) < least:
            add(0, len(units), "line ")
        for i in range(len(units)):
            for j in range(i + 1, len(units) + 1):
                if n(i, j) >= least and (n(i, j - 1) < least or n(i + 1, j) < least):
                    add(i, j, "run ")
        at += len(line) + 1
    return sorted(out)


def odd_pages(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "bb", "Cc", "É", "d.", "e!", "f?!", "3.14", "g.&&", "it", "x_y", "...", "U.S."])
    parts = [" ".join(word() for _ in range(r.randint(1, 14))) for _ in range(12)]
    return ["".join(r.choice([r.choice(parts), word()]) + r.choice([" ", " ", "\n", "  ", ""]) for _ in range(r.randint(0, 12))) for _ in range(40)]


@pytest.mark.parametrize("least", [1, 3, 8])
def test_passages_against_brute_force(spark, least):
    long = " ".join(f"p{i}" for i in range(60)) + "."
    texts = [f"Intro one of mine here. {long} tail words", None, "", f"Other start is this. And more, {long}\n{long.upper()} End.", "A b.\nA b.\n",
             f"x\n\n {long}  \ny", "one two three four five six", "ONE two  three four five six", "x. x. x. x. x. x. x. x. x. x. x. x.", *odd_pages(1), *odd_pages(2)]
    first, want = {}, defaultdict(set)
    for i, t in enumerate(texts):
        for start, end, said in plain_runs(t, least):
            if said in first:
                keep, at, e = first[said]
                want[i].add((max(start, e) if keep == i else start, end, keep, at))
            else:
                first[said] = (i, start, end)
    want = {i: sorted(x for x in v if x[0] < x[1]) for i, v in want.items()}
    want = {i: v for i, v in want.items() if v}
    df = frame(spark, texts).repartition(3)
    got = defaultdict(set)
    for r in passages.repeated_runs(df, least=least).collect():
        got[r.id].add((r.start, r.end, r.keep_id, r.keep_start))
    assert {i: sorted(v) for i, v in got.items()} == want
    out = passages.remove_repeats(df, least=least)
    assert out.columns == [*df.columns, "removed"]
    for r in out.collect():
        t = texts[r.doc_id]
        gone = {k for s, e, *_ in want.get(r.doc_id, []) for k in range(s, e)}
        assert r.text == (t if t is None else "".join(c for k, c in enumerate(t) if k not in gone))
        assert sorted({k for s in r.removed or [] for k in range(s.start, s.end)}) == sorted(gone)
    assert passages.repeated_runs(df.where("doc_id < 0")).count() == 0


def test_passages_leave_lone_short_sentences_and_settle_frequent_ones(spark):
    r = random.Random(4)
    texts = [" ".join(f"{r.choice('abcdefghij')}{r.randint(0, 10 ** 6)}" for _ in range(12)) + f" {i}. The end. So it is! More {i} here." for i in range(300)]
    hot = "This very line of more than eight words stands in each of them."
    texts = [t + "\n" + hot for t in texts]
    stored = passages.stored_units(frame(spark, texts), "doc_id", "text")
    for heavy in (4, 4096):
        got = {(r.id, texts[r.id][r.start:r.end], r.keep_id) for r in passages.repeats(stored, heavy).collect()}
        assert got == {(i, hot, 0) for i in range(1, 300)}


def test_passages_pasted_into_a_sentence(spark):
    passage = "That one was seen by nobody at all here. It then went away. So they say."
    texts = [f"begin {passage} and so on", f"Another one begins, and then {passage} Then it ends", f"quite else.&&& {passage}"]
    out = {r.doc_id: r.text for r in passages.remove_repeats(frame(spark, texts)).collect()}
    assert out == {i: t if i == 0 else t.replace(passage, "") for i, t in enumerate(texts)}


def test_passages_of_short_lines(spark):
    """Repeated lines of one to four words go, alone and as a passage."""
    poem = "Red sky\nat night\nStop.\nsailors all glad"
    texts = ["All rights reserved.\nmine " + "a b c d e f.\n" + poem, "Another text altogether here.\nall  RIGHTS reserved.\n", "Begin here\n" + poem + "\nthe end"]
    got = {r.doc_id: r.text.split() for r in passages.remove_repeats(frame(spark, texts)).collect()}
    assert got == {0: texts[0].split(), 1: "Another text altogether here.".split(), 2: "Begin here the end".split()}


def test_passages_one_row_a_document(spark):
    """Null and repeated ids: each row of the table has its own row."""
    line = "one line that stands here"
    rows = passages.removed(frame(spark, [line, line + "\nmore", line, "else", None], [1, 1, None, None, 2])).collect()
    spans = sorted((r.id or 0, r.n_removed, r.chars_removed, [(x.start, x.end, x.keep_id) for x in r.removed or []]) for r in rows)
    assert spans == [(0, 0, 0, []), (0, 1, len(line), [(0, len(line), 1)]), (1, 0, 0, []), (1, 1, len(line), [(0, len(line), 1)]), (2, 0, 0, [])]
