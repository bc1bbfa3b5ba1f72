"""BM25 answers against plain Python; odd articles and questions."""

import math
import re
from collections import Counter

from refract.operators import answers as AN

TEXTS = {1: "The river runs north. A boat was on the river. Nobody saw the boat at night! Rain fell.", 2: "Rain and wind came. The wind broke a mast. It was a long night of rain, rain and rain.",
         3: "", 4: None, 5: "One sentence only, about nothing else"}
ASKED = [(1, 0, "1. What about the boat?"), (1, 1, "Where does the river run"), (2, 0, "rain"), (2, 1, "mast wind"), (3, 0, "rain?"), (4, 0, "rain"), (5, 0, "zebra"), (5, 1, "")]


def tokens(s):
    return re.findall(r"[^\W_]+", s.lower())


def plain(budget, k1=1.2, b=0.75):
    sents = {a: [s for s in re.split(r"(?<=[.!?])\s+", t or "") if s] for a, t in TEXTS.items()}
    all_ = [tokens(s) for ss in sents.values() for s in ss]
    df, mean = Counter(w for t in all_ for w in set(t)), sum(map(len, all_)) / len(all_)
    out = {}
    for a, q, question in ASKED:
        scored = []
        for pos, s in enumerate(sents[a]):
            t = Counter(tokens(s))
            common = set(tokens(question)) & set(t)
            if common:
                n = sum(t.values())
                score = sum(math.log(1 + (len(all_) - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * (k1 + 1) / (t[w] + k1 * (1 - b + b * n / mean)) for w in common)
                scored.append((-round(score, 6), pos, s))
        words, kept = 0, []
        for rank, (_, pos, s) in enumerate(sorted(scored)):
            words += len(s.split(" "))
            if rank == 0 or words <= budget:
                kept.append((pos, s))
        out[a, q] = " ".join(s for _, s in sorted(kept))
    return out


def test_answers_like_plain_python(spark):
    arts = spark.createDataFrame(list(TEXTS.items()), "article_index long, content string")
    asked = spark.createDataFrame(ASKED, "article_index long, q_seq int, question string")
    for budget in (1, 9, 100):
        got = {(r.article_index, r.q_seq): r.answer for r in AN.answer(arts, asked, budget).collect()}
        assert got == plain(budget)
    assert plain(9)[2, 1] == "Rain and wind came. The wind broke a mast." and plain(100)[5, 0] == ""
    assert AN.answer(arts.limit(0), asked, 9).where("answer <> ''").count() == 0


def test_words_are_shuffled_by_article_alone(spark):
    arts = spark.createDataFrame(list(TEXTS.items()), "article_index long, content string")
    asked = spark.createDataFrame(ASKED, "article_index long, q_seq int, question string")
    plan = AN.answer(arts, asked, 9)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\(article_index#\d+L?, [a-z]", plan)


def test_numbers_that_repeat_or_are_null(spark):
    arts = spark.createDataFrame([(1, "Rain fell. Wind blew."), (1, "Rain fell. Wind blew."), (None, "Rain fell.")], "article_index long, content string")
    asked = spark.createDataFrame([(1, 0, "rain"), (1, 1, "zebra"), (1, 1, "zebra"), (None, 0, "rain"), (7, 0, "rain")], "article_index long, q_seq int, question string")
    got = sorted(((r.article_index or 0, r.q_seq, r.answer) for r in AN.answer(arts, asked, 9).collect()))
    assert got == [(0, 0, ""), (1, 0, "Rain fell. Rain fell."), (1, 1, ""), (1, 1, ""), (7, 0, "")]


def test_scores_like_the_answers_and_no_row_for_each_pair(spark):
    """Texts and questions are shuffled once, each in one row."""
    arts = spark.createDataFrame(list(TEXTS.items()), "article_index long, content string")
    asked = spark.createDataFrame(ASKED + [(1, 7, None)], "article_index long, q_seq int, question string")
    got = {(r.article_index, r.q_seq, r.pos): (r.w, r.score) for r in AN.bm25(arts, asked).collect()}
    assert set(got) == {(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0), (1, 1, 1), (1, 1, 2), (2, 0, 0), (2, 0, 2), (2, 1, 0), (2, 1, 1)}
    assert got[2, 0, 2][0] == 10 and got[2, 0, 2][1] > got[2, 0, 0][1]
    plan = AN.answer(arts, asked, 9)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(article_index", plan)) == 1 and "Aggregate" not in plan and "Window" not in plan
    assert {(r.article_index, r.q_seq): r.answer for r in AN.answer(arts, asked, 9).collect()} == {**plain(9), (1, 7): ""}


def test_frequent_words_are_known_to_every_task(spark, monkeypatch):
    """The same answers whether all, some or none of the words are shuffled."""
    arts = spark.createDataFrame(list(TEXTS.items()), "article_index long, content string")
    asked = spark.createDataFrame(ASKED, "article_index long, q_seq int, question string")
    df = AN.word_sentences(arts)
    assert AN.frequent(df, 0) == {} and AN.frequent(df, 1) == {"the": 4} and len(AN.frequent(df)) == df.count() - 1
    for most in (0, 3, 8):
        monkeypatch.setattr(AN.frequent, "__defaults__", (most,))
        assert {(r.article_index, r.q_seq): r.answer for r in AN.answer(arts, asked, 9).collect()} == plain(9)
