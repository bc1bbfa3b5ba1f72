"""Answers by corpus statistics (T5): the sentences of an article that match a
question best by BM25, within a word budget.

How much a word says follows from the number of sentences of the whole corpus
that hold it.  Those frequencies are a table with a row a word, which grows
with the corpus, so it is stored and joined, not broadcast by hand; only the most
frequent words, a bounded number, are known to every task (:func:`frequent`),
which spares most of the rows of that join and its hot words.

Everything else concerns one article alone, so one shuffle by article brings
together its text, its questions and the frequencies of the other words that
they ask for, each word once an article (or a batch of questions).  Texts travel
once and as texts: sentences and words are made where they meet, and scores,
ranks and answers where they lie, one article at a time, so no row is ever a
pair of a sentence and a question.  Scores are compared to six places, ties by
position.

Defined results: a question without a word in common with its article, or of
an article without sentences, has an empty answer; the best sentence is taken
even when it is longer than the budget.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from refract.functions import prompts as P
from refract.functions import rows as R
from refract.functions import text as T
from refract.operators import generate as G
from refract.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75
# Parts by article, for each core: small enough to be sorted in memory.
PARTS_PER_CORE = 16
# Words, at most, whose frequencies every task knows.
FREQUENT = 1 << 16
# Rows given back at once.
ROWS_BACK = 1024


def word_sentences(articles: DataFrame) -> DataFrame:
    """``word, df, tokens``: the number of sentences that hold a word; the null
    word has the number of all sentences and of their tokens.  Stored."""
    t = R.explode_rows(articles, [], G.article_sentences("content"), "s").select(T.tokens("s").alias("t"))
    t = t.select(F.size("t").alias("n"), F.array_append(F.array_distinct("t"), F.lit(None).cast("string")).alias("words"))
    return materialize(R.explode_rows(t, ["n"], F.col("words"), "word").groupBy("word").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("tokens")), "word_sentences")


def frequent(df: DataFrame, most: int = FREQUENT) -> dict:
    """Words held by the most sentences, at most ``most``, with their number: all
    that reach a step (a quarter of a power of two) which few enough reach."""
    steps = df.where("word is not null").withColumn("step", F.floor(4 * F.log2(F.col("df").cast("double"))))
    n, least = 0, None
    for r in sorted(steps.groupBy("step").count().collect(), key=lambda r: -r["step"]):          # four rows for each power of two
        n += r["count"]
        if n > most:
            break
        least = r["step"]
    return {} if least is None else {r["word"]: r["df"] for r in steps.where(F.col("step") >= least).select("word", "df").collect()}


def _pairs(often: dict) -> Callable:
    """Each word that isn't ``often`` met with its article, once a batch."""
    words = list(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in batches:
            t = batch.column("t")
            t = pa.table({"article_index": batch.column("article_index").take(pc.list_parent_indices(t)), "word": pc.list_flatten(t)})
            t = t.filter(pc.invert(pc.is_in(t["word"], value_set=known)))
            yield from t.group_by(["article_index", "word"]).aggregate([]).combine_chunks().to_batches()

    return run


def _beside(articles: DataFrame, asked: DataFrame, df: DataFrame, often: dict) -> DataFrame:
    """The rows of each article one after the other, parted by article: its
    sentences (``s``) with their words (``w``: how many, ``t``), the asked words
    that aren't ``often`` met (``word``, ``df``), and questions (``q_seq``, ``q``: their words)."""
    known = F.col("article_index").isNotNull()
    index = asked.schema["article_index"].dataType
    toks = asked.where(known).select("article_index", F.coalesce(T.tokens("question"), F.array().cast("array<string>")).alias("t"))
    pairs = toks.mapInArrow(_pairs(often), S.StructType([S.StructField("article_index", index), S.StructField("word", S.StringType())]))
    parts = [articles.where(known).select("article_index", F.lit(0).alias("kind"), F.col("content").alias("text")),
             pairs.join(df.where("word is not null").select("word", "df"), "word").select("article_index", F.lit(1).alias("kind"), F.col("word").alias("text"), "df"),
             asked.where(known).select("article_index", F.lit(2).alias("kind"), F.col("question").alias("text"), "q_seq")]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    spark = articles.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_CORE * spark.sparkContext.defaultParallelism)
    rows = both.repartition(n, "article_index").sortWithinPartitions("article_index", "kind")
    rows = rows.withColumn("s", F.when(F.col("kind") == 0, G.article_sentences("text")))
    return rows.select("article_index", "kind", "s", F.transform("s", T.word_count).alias("w"), F.transform("s", T.tokens).alias("t"),
                       F.when(F.col("kind") == 1, F.col("text")).alias("word"), "df", "q_seq",
                       F.when(F.col("kind") == 2, F.array_distinct(T.tokens("text"))).alias("q"))


def _scored(sents: list, idf: dict, asked: dict, mean: float, k1: float, b: float) -> Iterator[tuple]:
    """(``q_seq``, how many questions have it, ((``pos``, ``w``), score) best
    first) of one article."""
    held = defaultdict(list)                                   # the sentences with a word, and its gain there
    places: dict = {}                                          # number of each (pos, w): short keys for the sums
    for pos, _, w, words in sents:
        place = places.setdefault((pos, w), len(places))
        tf: dict = {}
        for word in words:
            if word in idf:
                tf[word] = tf.get(word, 0) + 1
        for word, f in tf.items():
            held[word].append((place, f * (k1 + 1) / (f + k1 * (1 - b + b * len(words) / mean))))
    at = list(places)
    for q_seq, questions in asked.items():
        score: dict = {}
        for words in questions:
            for word in words:
                if word in held:
                    much = idf[word]
                    for place, gain in held[word]:
                        score[place] = score.get(place, 0.0) + much * gain
        best = sorted((-round(x, 6), at[place]) for place, x in score.items())
        yield q_seq, len(questions), [(of, -x) for x, of in best]


def _articles(batches: Iterator[pa.RecordBatch], often: dict) -> Iterator[tuple]:
    """Each article's (number, sentences as (``pos``, text, words, tokens), sentences
    of the corpus with each asked word, words of its questions by ``q_seq``)."""
    def whole() -> tuple:
        words = {word for questions in asked.values() for q in questions for word in q}
        return at, sents, rare | {word: often[word] for word in words if word in often}, asked

    at, sents, rare, asked = None, [], {}, {}
    for batch in batches:
        for article, kind, s, w, t, word, df, q_seq, q in zip(*(batch.column(c).to_pylist() for c in ("article_index", "kind", "s", "w", "t", "word", "df", "q_seq", "q"))):
            if article != at:
                if asked:
                    yield whole()
                at, sents, rare, asked = article, [], {}, {}
            if kind == 0:
                sents += zip(range(len(s or ())), s or (), w or (), t or ())
            elif kind == 1:
                rare[word] = df
            else:
                asked.setdefault(q_seq, []).append(q or [])
    if asked:
        yield whole()


def _said(sents: list) -> dict:
    """The sentences of each place: several where articles share a number."""
    of: dict = {}
    for pos, s, _, _ in sents:
        of.setdefault(pos, []).append(s)
    return of


def _answers(said: dict, found: list, budget: int) -> str:
    """Best sentences while their words stay within the budget, in document order."""
    words, chosen = 0, []
    for rank, ((pos, w), _) in enumerate(found):
        words += w
        if rank and words > budget:
            break
        chosen.append(pos)
    return " ".join(s for _, s in sorted((pos, s) for pos in chosen for s in said[pos]))


def _each(articles: DataFrame, questions: DataFrame, k1: float, b: float, made: Callable, cols: list) -> tuple[DataFrame, DataFrame]:
    """The rows that ``made`` gives for an article's sentences by place and each
    ``q_seq``, and the stored questions."""
    # read twice: for their words and for themselves
    asked = materialize(questions.select("article_index", "q_seq", "question"), "asked_questions")
    df = word_sentences(articles)
    corpus = df.where("word is null").first()
    sentences, mean = (corpus["df"], corpus["tokens"] / corpus["df"]) if corpus else (0, 0.0)
    often = frequent(df)
    schema = S.StructType([asked.schema["article_index"], asked.schema["q_seq"], *cols])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []

        def back() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        for article, sents, df, asked in _articles(batches, often):
            idf = {word: math.log(1 + (sentences - n + 0.5) / (n + 0.5)) for word, n in df.items()}
            said = _said(sents)
            for q_seq, times, found in _scored(sents, idf, asked, mean, k1, b):
                out += [(article, q_seq, *row) for row in made(said, found, times)]
                if len(out) >= ROWS_BACK:
                    yield back()
                    out.clear()
        if out:
            yield back()

    return _beside(articles, asked, df, often).mapInArrow(run, schema), asked


def bm25(articles: DataFrame, questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``article_index, q_seq, pos, w, score`` of each sentence that shares a
    word with a question (``article_index, q_seq, question``) of its article."""
    cols = [S.StructField("pos", S.IntegerType()), S.StructField("w", S.IntegerType()), S.StructField("score", S.DoubleType())]
    return _each(articles, questions, k1, b, lambda said, found, times: [(*at, x) for at, x in found], cols)[0]


def answer(articles: DataFrame, questions: DataFrame, budget: int = P.DEFAULT_BUDGET) -> DataFrame:
    """``article_index, q_seq, answer``: best sentences while their words stay
    within the budget, in document order."""
    found, asked = _each(articles, questions, K1, B, lambda said, found, times: [(_answers(said, found, budget),)] * times,
                         [S.StructField("answer", S.StringType())])
    none = asked.where(F.col("article_index").isNull()).select("article_index", "q_seq", F.lit("").alias("answer"))
    return found.unionByName(none)
