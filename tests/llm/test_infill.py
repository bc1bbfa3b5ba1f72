"""Fill-in-middle: against plain Python, exact round trips, chunks, odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refract.llm import infill

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def plain(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    u = LINES.findall(text)
    hexed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexed[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def ends(data):
    h = infill.rolling(np.frombuffer(data, np.uint8))
    return infill.chunk_ends(np.flatnonzero(h >> np.uint64(64 - infill.BITS) == 0), 0, len(data))


def long_texts():
    r = random.Random(5)
    words = ["été", "<", "P>", "<S", ">", "naïve", "漢字", "the", "of", "<M", "a", "𝒳"]
    out = []
    for n in (1, 50, 700, 6000, 60000):
        out.append("".join(r.choice(words) + r.choice([" ", " ", "\n", "", "\n\n"]) for _ in range(n)))
        out.append("".join(r.choice(words[5:9]) + r.choice([" ", " ", "\n", "\n\n"]) for _ in range(n)))
    return [*out, "x" * 300_000, "\n" * 20_000, "y" * 100_000 + "\n" + "z", "é" * 50_001, "a<P" * 9000, "n\n" * 2100 + "<M>" + "n\n" * 50]


ODD = [None, "", "\n", "a", "a\n", "\na", "\n\n", "<P>", "a<S>b", "<M", "<\nP>", "a\r\nb", "﻿x y\n", "\0\n\0"]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 100), (0, 50)])
def test_like_plain_python_and_restored(spark, rate, spm):
    texts = ODD + long_texts()
    rows = [(i, t, "x", 1, None) for i, t in enumerate(texts)] + [(None, "u\nv\nw", "x", 1, None), (3, "a", None, None, None), (3, "a", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n long, output string").repartition(3)
    out = infill.fill_in_middle(df, rate=rate, spm=spm)
    got = out.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert Counter((r.id, r.back) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    assert Counter((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((r[0], *plain(r[0], r[1], rate=rate, spm=spm)) for r in rows)
    assert infill.fill_in_middle(df.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="a\né<PSM>漢", max_size=400), st.integers(0, 30), st.integers(0, 10 ** 6))
def test_chunks_hold_the_text_and_lead_to_its_lines(text, step, salt):
    data = (text * (1 + step)).encode()
    t = infill.Text(data, ends(data), infill.Chunks(1000))
    u = LINES.findall(data.decode())
    assert t.ends[-1] == len(data) and sorted(set(t.ends)) == t.ends and t.lines == len(u)
    assert t.marked == any(m in data.decode() for m in ("<P>", "<S>", "<M>"))
    k = salt % (len(u) + 1)
    head = "".join(u[:k])
    assert t.end_of(k) == (len(head.encode()), len(head))


def test_markers_across_chunks():
    for cut in range(1, 8):
        for small in (1, 2, 3):
            data = b"ab<S>cd" * 2
            cuts = sorted({*range(cut, len(data), small), len(data)})
            assert infill.Text(data, cuts, infill.Chunks()).marked
            assert not infill.Text(data.replace(b"S", b"s"), cuts, infill.Chunks()).marked


def test_shared_passages_share_chunks_wherever_they_stand():
    r = random.Random(1)
    line = lambda: " ".join(r.choice(["aa", "bcd", "efg", "hi", "jklm"]) for _ in range(12)) + "\n"
    passage = "".join(line() for _ in range(400)).encode()
    cache = infill.Chunks()
    for _ in range(4):
        data = "".join(line() for _ in range(r.randint(3, 30))).encode() + passage
        infill.Text(data, ends(data), cache)
    assert cache.hits > 2 * len(ends(passage))
    sizes = np.diff([0, *ends(passage)])
    assert sizes.max() <= infill.MOST and sizes[:-1].min() >= infill.LEAST


def test_the_cache_stays_within_its_bytes():
    cache = infill.Chunks(10_000)
    for i in range(3000):
        cache.summary(f"{i:08d}".encode() * 20)
    assert cache.size <= 10_000 and sum(map(len, cache.held)) == cache.size
    assert cache.summary(b"x" * 20_000)[1] == 20_000 and cache.size <= 10_000
