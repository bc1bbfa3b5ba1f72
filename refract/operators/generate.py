"""Batch generation (the G-op): prompts in, responses out.

Two backends:

* ``extractive`` (default) -- deterministic, pure Spark expressions.  It
  works on an article's own sentences, so a whole article's questions and
  perspectives are computed inside its row with higher-order functions: no
  shuffle, no Python worker, linear in the corpus.  It is a stand-in that
  exercises the same data flow as a language model; its accuracy says
  nothing about a model's.
* ``callable`` -- any user function ``list[str] -> list[str]`` applied to
  prompt batches in ``mapInPandas`` (one function instance per task, Arrow
  batches), for plugging in a real model.  Responses must be materialised
  before evaluation because a sampled model is not reproducible.

Responses are turned into question lists by the reference's line rule
(split on newlines, keep lines whose first character is a digit).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from refract.functions import prompts as P
from refract.functions import text as T

# Ship this module's code with the UDFs (workers need not have the package).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KeyFn = Callable[..., Column]  # (item, n, ctx) -> ascending sort key


def _neg(c: Column) -> Column:
    return F.lit(0) - c


# Sentence ranking rule per perspective template (ascending sort key; ties
# broken by position).  Stand-ins for the seven prompt styles.  ``x`` is a
# sentence item (pos, w = words, len = characters, dig = has a digit, s).
PERSPECTIVE_RULES: dict[int, KeyFn] = {
    0: lambda x, n, c: x["pos"],                                 # lead
    1: lambda x, n, c: _neg(x["pos"]),                           # tail
    2: lambda x, n, c: _neg(x["len"]),                           # longest first
    3: lambda x, n, c: x["len"],                                 # shortest first
    4: lambda x, n, c: F.when(x["dig"], 0).otherwise(1),         # figures first
    5: lambda x, n, c: _neg(x["w"]),                             # most words first
    6: lambda x, n, c: F.abs(x["pos"] * 2 - (n - 1)),            # middle out
}
NEEDS_N = {6}

# Sentence ranking per question spec (0 generic = document order).
QUESTION_RULES: dict[int, KeyFn] = {
    0: lambda x, n, c: x["pos"],
    1: lambda x, n, c: F.when(x["dig"], 0).otherwise(1),
    2: lambda x, n, c: _neg(x["w"]),
    3: lambda x, n, c: _neg(x["pos"]),
}

RESPONSE_HEADER = "Here are %s questions:"


def article_sentences(content: Column | str) -> Column:
    """Sentences of the newline-normalised text."""
    return T.sentences(T.embed_normalize(content))


def sentence_items(sents: Column) -> Column:
    """Per-sentence features computed once: ``array<struct<pos, w, len, dig, s>>``."""
    return F.transform(sents, lambda s, i: F.struct(
        i.alias("pos"), T.word_count(s).alias("w"), F.length(s).alias("len"),
        T.has_digit(s).alias("dig"), s.alias("s")))


def with_sentences(df: DataFrame, text_col: str = "content", out_col: str = "_items") -> DataFrame:
    """Split once per row and featurise; later rules only read the fields."""
    return df.select("*", sentence_items(article_sentences(text_col)).alias(out_col))


def _ranked(items: Column, key_fn: KeyFn, ctx: Column | None = None, needs_n: bool = False) -> Column:
    """``array<struct<k, pos, w, s>>`` sorted by (key, pos).

    ``sort_array`` compares natively, ``array_sort`` by a lambda; no element is
    null, so both give the same order.

    Per-row values a rule needs inside the lambda (sentence count, question
    tokens) are zipped into the elements rather than referenced from the
    lambda body, where Spark would re-evaluate them for every element.
    """
    if ctx is None and not needs_n:
        keyed = F.transform(items, lambda x: F.struct(
            key_fn(x, None, None).alias("k"), x["pos"].alias("pos"), x["w"].alias("w"), x["s"].alias("s")))
        return F.sort_array(keyed)
    n = F.size(items)
    c = ctx if ctx is not None else F.lit(None).cast("int")
    keyed = F.zip_with(items, F.array_repeat(F.struct(n.alias("n"), c.alias("c")), n),
                       lambda x, e: F.struct(key_fn(x, e["n"], e["c"]).alias("k"), x["pos"].alias("pos"),
                                             x["w"].alias("w"), x["s"].alias("s")))
    return F.sort_array(keyed)


def select_by_budget(items: Column, key_fn: KeyFn, budget: int | Column,
                     ctx: Column | None = None, needs_n: bool = False) -> Column:
    """Keep ranked sentences while the running word total stays within the
    budget (the first is always kept), then restore document order and join
    with a space."""
    b = budget if isinstance(budget, Column) else F.lit(budget)
    init = F.struct(F.lit(0).alias("tot"),
                    F.array().cast("array<struct<pos:int,s:string>>").alias("kept"))
    return F.aggregate(
        _ranked(items, key_fn, ctx, needs_n), init,
        lambda acc, x: F.struct(
            (acc["tot"] + x["w"]).alias("tot"),
            F.when((acc["tot"] == 0) | (acc["tot"] + x["w"] <= b),
                   F.array_append(acc["kept"], F.struct(x["pos"].alias("pos"), x["s"].alias("s"))))
             .otherwise(acc["kept"]).alias("kept")),
        lambda acc: F.array_join(F.transform(F.sort_array(acc["kept"]), lambda x: x["s"]), " "))


def valued_items(items: Column) -> Column:
    """Sentence items with a value: how many different words they hold."""
    return F.transform(items, lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w"), x["s"].alias("s"),
                                                 F.size(F.array_distinct(T.tokens(x["s"]))).cast("long").alias("v")))


def best_within_budget(items: Column, budget: int = P.DEFAULT_BUDGET) -> Column:
    """struct<value, words, kept array<struct<pos, s>>>: the sentences with the
    greatest total value whose words stay within the budget (W6 solved, where
    :func:`select_by_budget` is greedy), in document order.

    A dynamic programme over word counts, folded over the items of
    :func:`valued_items` inside the row: place ``c`` of the state is the best
    choice of at most ``c`` words, so a row of n sentences takes n times
    ``budget`` steps whatever their length.  The state is one NumPy array of
    values; which items were taken is read back from one bit a step.  Of equal
    values the choice made first stays.  A sentence longer than the budget is
    never chosen.
    """
    @F.pandas_udf("array<int>")
    def solve(w: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else fill_budget(a, b, budget) for a, b in zip(w, v)], dtype=object)

    at = solve(F.transform(items, lambda x: x["w"]), F.transform(items, lambda x: x["v"].cast("long")))
    taken = F.transform(at, lambda i: F.get(items, i))
    none = F.lit(0).cast("long")
    return F.when(at.isNotNull(), F.struct(
        F.aggregate(taken, none, lambda a, x: a + x["v"]).alias("value"),
        F.aggregate(taken, F.lit(0), lambda a, x: a + x["w"]).alias("words"),
        F.transform(taken, lambda x: F.struct(x["pos"].alias("pos"), x["s"].alias("s"))).alias("kept")))


def fill_budget(words, values, budget: int) -> list[int]:
    """Places of the items with the greatest total value within the budget."""
    w, v = np.asarray(words, np.int64), np.asarray(values, np.int64)
    fits = np.flatnonzero(w <= budget)
    best, took = np.zeros(budget + 1, np.int64), []
    for i in fits.tolist():
        now, found = best[w[i]:], best[:budget + 1 - w[i]] + v[i]
        better = found > now
        took.append(np.packbits(better))
        np.copyto(now, found, where=better)
    out, c = [], budget
    for i, bits in zip(fits[::-1].tolist(), reversed(took)):
        at = c - int(w[i])
        if at >= 0 and bits[at >> 3] >> (7 - (at & 7)) & 1:
            out.append(i)
            c = at
    return out[::-1]


def greedy_value(items: Column, budget: int = P.DEFAULT_BUDGET) -> Column:
    """The value that taking the best sentences in turn reaches, while their
    running words stay within the budget."""
    ranked = F.sort_array(F.transform(items, lambda x: F.struct((-x["v"]).alias("k"), x["pos"].alias("pos"), x["w"].alias("w"))))
    init = F.struct(F.lit(0).alias("tot"), F.lit(0).cast("long").alias("value"))
    return F.aggregate(ranked, init, lambda a, x: F.struct(
        (a["tot"] + x["w"]).alias("tot"), (a["value"] + F.when(a["tot"] + x["w"] <= budget, -x["k"]).otherwise(F.lit(0).cast("long"))).alias("value")),
        lambda a: a["value"])


# ------------------------------------------------------------ perspectives
def perspective(items: Column, seq: int, budget: int | Column = P.DEFAULT_BUDGET) -> Column:
    return select_by_budget(items, PERSPECTIVE_RULES[seq], budget, needs_n=seq in NEEDS_N)


def extractive_perspectives(items: Column, budget: int = P.DEFAULT_BUDGET,
                            seqs=tuple(range(len(P.PERSPECTIVE_TEMPLATES)))) -> Column:
    """``array<string>`` in template order (``sumarries`` of the dataset)."""
    return F.array(*[perspective(items, s, budget) for s in seqs])


def extractive_summary(content: Column | str, budget: int | Column = P.DEFAULT_BUDGET) -> Column:
    """Single-prompt summary: lead sentences within the budget."""
    return lead_sentences(sentence_items(article_sentences(content)), budget)


def lead_sentences(items: Column, budget: int | Column = P.DEFAULT_BUDGET) -> Column:
    """The same from sentence items, for several budgets of one text."""
    return select_by_budget(items, PERSPECTIVE_RULES[0], budget)


def shorten(text: Column | str, budget: int | Column) -> Column:
    """Second-pass shortening of a summary to a word budget."""
    return select_by_budget(sentence_items(article_sentences(text)), PERSPECTIVE_RULES[0], budget)


# --------------------------------------------------------------- questions
def _as_question(s: Column) -> Column:
    return F.concat(F.regexp_replace(s, "[.!?]+$", ""), F.lit("?"))


def question_response(items: Column, count: int, rule: int = 0) -> Column:
    """A numbered list answer: a header, a blank line, then ``k. <q>`` lines."""
    chosen = F.transform(F.slice(_ranked(items, QUESTION_RULES[rule]), F.lit(1), F.lit(count)),
                         lambda x: x["s"])
    numbered = F.transform(chosen, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "),
                                                        _as_question(s)))
    return F.concat(F.lit(RESPONSE_HEADER % count), F.lit("\n\n"), F.array_join(numbered, "\n"))


def parsed_questions(items: Column, count: int, rule: int = 0) -> Column:
    return T.parse_questions(question_response(items, count, rule))


def generic_questions(items: Column, count: int = P.GENERIC_QUESTION_COUNT) -> Column:
    return parsed_questions(items, count, 0)


def targeted_questions(items: Column) -> Column:
    """The three spec'd requests, concatenated in spec order."""
    return F.concat(*[parsed_questions(items, n, o) for o, _c, _s, n in P.QUESTION_SPECS if o > 0])


def segment_sentences(items: Column, count: int = P.SEGMENT_COUNT) -> list[Column]:
    """Item slices of the overlapping segments (see ``context_segments``)."""
    n = F.size(items)
    k = (n / F.lit(count)).cast("int")
    o = F.least(k, F.lit(3))
    out = []
    for i in range(count):
        if i == 0:
            out.append(F.slice(items, F.lit(1), k + o))
        elif i == count - 1:
            out.append(F.slice(items, k * i - o + 1, n))
        else:
            out.append(F.slice(items, k * i - o + 1, k + 2 * o))
    return out


def segment_questions(items: Column, count: int = P.SEGMENT_COUNT,
                      per_segment: int = P.SEGMENT_QUESTION_COUNT) -> Column:
    """Questions from each overlapping segment; empty segments ask nothing."""
    return F.concat(*[parsed_questions(seg, per_segment, 0) for seg in segment_sentences(items, count)])


# ----------------------------------------------------------------- answers
def answer_items(items: Column) -> Column:
    """Sentence items plus each sentence's distinct tokens (``t``), computed
    once per article rather than once per question."""
    return F.transform(items, lambda x: x.withField("t", F.array_distinct(T.tokens(x["s"]))))


def _overlap_key(x, n, qtok):
    # distinct sentence tokens that also occur in the question
    return _neg(F.size(F.array_intersect(x["t"], qtok)))


def extractive_answer(items: Column, question: Column | str, budget: int = P.DEFAULT_BUDGET) -> Column:
    """Sentences sharing the most distinct tokens with the question, within
    the word budget, then capped at ``budget`` words (the token cap).
    ``items`` come from :func:`answer_items`."""
    text = select_by_budget(items, _overlap_key, budget, ctx=T.tokens(question))
    return F.array_join(F.slice(F.split(text, " ", -1), F.lit(1), F.lit(budget)), " ")


# ----------------------------------------------------------------- dataset
def with_dataset_columns(arts: DataFrame, budget: int = P.DEFAULT_BUDGET) -> DataFrame:
    """Add the three question lists and the seven perspectives to each
    article row (narrow: no shuffle; sentences split once per row).

    Perspectives are separate columns ``perspective_<seq>`` so a consumer
    that reads only some of them lets Catalyst prune the others;
    ``sumarries`` (the nested list of the reference dataset) is assembled
    from them in the final projection.
    """
    s = F.col("_items")
    n = len(P.PERSPECTIVE_TEMPLATES)
    wide = with_sentences(arts).select(
        *arts.columns,
        generic_questions(s).alias("genericQuestions"),
        targeted_questions(s).alias("targetQuestions"),
        segment_questions(s).alias("segmentQuestions"),
        *[perspective(s, i, budget).alias(f"perspective_{i}") for i in range(n)],
    )
    return wide.withColumn("sumarries", F.array(*[F.col(f"perspective_{i}") for i in range(n)]))


# ---------------------------------------------------------- callable path
def generate_with(df: DataFrame, prompt_col: str, make_fn: Callable[[], Callable[[list[str]], list[str]]],
                  out_col: str = "response") -> DataFrame:
    """Apply a user generator to prompt batches in Python workers.

    ``make_fn`` is called once per task (load clients/models there); the
    returned function maps a batch of prompts to the same number of
    responses.  Output keeps every input column plus ``out_col`` and
    ``prompt_key`` (md5 of the prompt) for idempotent retries and caching.
    """
    schema = StructType([*df.schema.fields, StructField(out_col, StringType()), StructField("prompt_key", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        fn = make_fn()
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").tolist()
            out = fn(prompts)
            if len(out) != len(prompts):
                raise ValueError("generator returned %d responses for %d prompts"
                                 % (len(out), len(prompts)))
            pdf = pdf.copy()
            pdf[out_col] = out
            pdf["prompt_key"] = [hashlib.md5(p.encode("utf-8")).hexdigest() for p in prompts]
            yield pdf

    return df.mapInPandas(run, schema)
