"""The word budget solved: equal to brute force, never worse than greedy."""

import itertools
import random

from pyspark.sql import functions as F

from refract.operators import generate as G


def test_best_within_budget_against_all_subsets(spark):
    r = random.Random(4)
    rows = [(i, [(p, w, f"s{p}", r.randint(0, 9)) for p, w in enumerate(r.choices(range(1, 9), k=r.randint(0, 9)))]) for i in range(60)]
    rows.append((60, [(0, 12, "long", 100), (1, 6, "a", 5), (2, 5, "b", 4), (3, 5, "c", 4)]))       # greedy takes a, and no more than that
    df = spark.createDataFrame(rows, "i int, v array<struct<pos:int,w:int,s:string,v:long>>")
    got = {x.i: x for x in df.select("i", G.best_within_budget(F.col("v"), 10).alias("b"), G.greedy_value(F.col("v"), 10).alias("g")).collect()}
    better = 0
    for i, items in rows:
        fits = [c for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(x[1] for x in c) <= 10]
        best = max(sum(x[3] for x in c) for c in fits)
        b = got[i].b
        chosen = [items[k.pos] for k in b.kept]
        assert b.value == best == sum(x[3] for x in chosen) and b.words == sum(x[1] for x in chosen) <= 10
        assert [k.pos for k in b.kept] == sorted(k.pos for k in b.kept) and [k.s for k in b.kept] == [x[2] for x in chosen]
        assert got[i].g <= best
        better += got[i].g < best
    assert better > 10 and got[60].b.value == 8 and got[60].g == 0


def test_values_are_different_words(spark):
    df = spark.createDataFrame([("One two two. Three, three! \n Four",), ("",), (None,)], "content string")
    got = [r[0] for r in df.select(G.valued_items(G.sentence_items(G.article_sentences("content")))).collect()]
    assert [[(x.pos, x.w, x.v) for x in g] if g is not None else None for g in got] == [[(0, 3, 2), (1, 2, 1), (2, 1, 1)], [], None]


def test_places_read_back_from_bits():
    r = random.Random(6)
    for _ in range(200):
        w, v = r.choices(range(1, 14), k=r.randint(0, 9)), r.choices(range(9), k=9)
        at = G.fill_budget(w, v[:len(w)], 11)
        best = max(sum(v[i] for i in c) for n in range(len(w) + 1) for c in itertools.combinations(range(len(w)), n) if sum(w[i] for i in c) <= 11)
        assert sum(v[i] for i in at) == best and sum(w[i] for i in at) <= 11 and at == sorted(at)
