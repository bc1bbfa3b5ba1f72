"""Prompt templates and rendering (F10, F11, F19; J1, J3, J4).

Article x template / article x question-spec products are expressed as an
``explode`` over a literal array of the (small, fixed) template list: a
Generate node inside the scan's stage -- no join, no broadcast, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refract.functions import text as T
from refract.functions import rows as R

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.  Template wording is kept
# verbatim, including the spelling and the case of the ``wordCount`` /
# ``wordcount`` placeholder, because only the camel-case spelling is
# substituted, and the indentation of continuation lines.
# ---------------------------------------------------------------------------
SYSTEM_MESSAGE = ("You are a helpful and trustworthy assistant. "
                  "You will generate an answer using the provided contexts.")

PLACEHOLDER = "wordCount"
BUDGET_PREFIX = "strict"
DEFAULT_BUDGET = 100
PERSPECTIVE_LENGTHS = (100,)

PERSPECTIVE_TEMPLATES = (
    "Summarize the following content in  wordcount completion_tokens or fewer, emphasizing the main technical \n"
    "                      achievements, lessons learned, and actionable insights that are beneficial to others in the field. Focus on\n"
    "                       how the work impacts the industry, its technical contributions, and practical applications. The summary \n"
    "                      should be professional, concise (1-5 sentences), and geared toward an audience interested in knowledge transfer, \n"
    "                      similar methodologies, or potential research directions.",

    "Act as an academic expert, synthesize the following content into a concise, \n"
    "                      clear summary that encapsulates the main findings, methodologies, results, \n"
    "                      and implications. Retain essential terms and nuances. The summary sould be \n"
    "                      in wordcount completion_tokens or fewer",

    "Create a professional summary of the following content in wordcount completion_tokens or less, \n"
    "                        capturing the essential insights and guidance for technical audience. Include core technical terms\n"
    "                        (e.g., “backpropagation,” “non-linear regression”) and clarify any uncommon terms specific to this field, \n"
    "                        ensuring the author’s message is accurately conveyed.",

    "Acting as an academic expert, propose a focused research topic derived from the content \n"
    "                      provided. The topic should address a gap or opportunity in current knowledge, with relevance \n"
    "                      to ongoing discussions or societal needs. Consider key variables, methods, and outcomes.\n"
    "                      The summary sould be in wordcount completion_tokens or fewer",

    "Generate a technical summary of the content in wordCount completion_tokens or fewer.\n"
    "                       Emphasize essential statistics that offer context, such as sample sizes, key metrics, \n"
    "                      or error rates, as well as any significant equations or mathematical models used in the analysis.",

    "Produce a technical summary of the following content in wordCount completion_tokens \n"
    "                      or fewer, focusing on actionable insights and implementation strategies. \n"
    "                      Where applicable, include practical applications of the findings and discuss \n"
    "                      how they can be utilized in real-world scenarios",

    "Locate and list one or two tangential or unrelated viewpoints within the article, \n"
    "                      noting their placement (e.g., beginning, middle or end). Identify sections that do not directly support the main arguments, \n"
    "                      such as off-topic comments, unusual anecdotes, or loosely related statements. It sould be in wordcount completion_tokens or fewer ",
)

# The two-template list is templates 4 and 5 of the full list, the ones the
# evaluation indexes.
EVAL_SEQS = (4, 5)

GENERIC_QUESTION_COUNT = 5
SEGMENT_COUNT = 3
SEGMENT_QUESTION_COUNT = 2
# (spec_ord, category, spec text, count); spec 0 is the generic request.
QUESTION_SPECS = (
    (0, "generic", "technical questions", 5),
    (1, "targeted", "statistics and number related questions", 3),
    (2, "targeted", "method and/or results related questions", 3),
    (3, "targeted", "insights and/or opinions related questions", 3),
)

GENERIC_Q_FORMAT = " create and list %s technical questions from the content below: \n\n%s"
SPEC_Q_FORMAT = " create and list %s %s from the content below: \n\n%s"

SUMMARY_FORMAT = (
    " Convert the following content into a technical summary of using %s completion_tokens or less that highlights the key achievements,   \n"
    "      lessons learned, and actionable insights that can benefit others in the field.  Focus on the technical \n"
    "      aspects of the work, the impact of the work on the field, and how others can apply these insights. \n"
    "      Ensure that the summary is professional and geared towards an audience looking to gain knowledge or \n"
    "       apply similar approaches in their own work or looking for future research topics. \n"
    "       Make the summary a 1-5 sentence self-explanatory paragraph.  \n\n%s")

ANSWER_FORMAT = (
    " answer this %s according to the content given content: using %s. \n"
    "      please go direct to answer the questions. Do not include any thing like this article, this blog, etc. Straight forward to the answer.\n"
    "      please use original text and writing style as much as possible and focus on  key achievements,   \n"
    "      lessons learned, and actionable insights that can benefit others in the field.  Focus on the technical \n"
    "      aspects of the work, the impact of the work on the field, and how others can apply these insights. \n"
    "      Ensure that the answer is professional and geared towards an audience looking to gain knowledge or \n"
    "      apply similar approaches in their own work or looking for future research topics. Please remember to maintain personality\n"
    "       \n\n%s")

SHORTEN_FORMAT = (
    " shorten the following summary into a maxinum %s words paragraph and keep the key achievements,   \n"
    "      lessons learned, and actionable insights that can benefit others in the field.  Focus on the technical \n"
    "      aspects of the work, the impact of the work on the field, and how others can apply these insights. \n"
    "      Ensure that the summary is professional and geared towards an audience looking to gain knowledge or \n"
    "       apply similar approaches in their own work or looking for future research topics. \n\n%s")
# ---------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def template_array(normalize_placeholder: bool = False) -> Column:
    """Literal ``array<struct<seq:int, template:string>>`` of the 7 templates.

    ``normalize_placeholder`` repairs the lower-case spelling so every
    template receives the budget (off by default: parity).
    """
    items = []
    for seq, tpl in enumerate(PERSPECTIVE_TEMPLATES):
        if normalize_placeholder:
            tpl = tpl.replace("wordcount", PLACEHOLDER)
        items.append(F.struct(F.lit(seq).alias("seq"), F.lit(tpl).alias("template")))
    return F.array(*items)


def substitute_budget(template: Column | str, budget: Column | int) -> Column:
    """The template with each camel-case placeholder replaced by the budget."""
    b = budget if isinstance(budget, Column) else F.lit(budget)
    return F.replace(_c(template), F.lit(PLACEHOLDER), F.concat(F.lit(BUDGET_PREFIX), b.cast("string")))


def perspective_prompt(template: Column | str, budget: Column | int, content: Column | str) -> Column:
    return F.concat(substitute_budget(template, budget), F.lit("\n\n"), _c(content))


def generic_question_prompt(count: Column | int, content: Column | str) -> Column:
    n = count if isinstance(count, Column) else F.lit(count)
    return F.format_string(GENERIC_Q_FORMAT, n.cast("string"), _c(content))


def spec_question_prompt(count: Column | int, spec: Column | str, content: Column | str) -> Column:
    n = count if isinstance(count, Column) else F.lit(count)
    return F.format_string(SPEC_Q_FORMAT, n.cast("string"), _c(spec), _c(content))


def question_prompt(spec_ord: Column, count: Column, spec: Column, content: Column) -> Column:
    return F.when(spec_ord == 0, generic_question_prompt(count, content)).otherwise(
        spec_question_prompt(count, spec, content))


def summary_prompt(budget: Column | int, content: Column | str) -> Column:
    b = budget if isinstance(budget, Column) else F.lit(budget)
    return F.format_string(SUMMARY_FORMAT, b.cast("string"), _c(content))


def answer_prompt(question: Column | str, budget: Column | int, content: Column | str) -> Column:
    b = budget if isinstance(budget, Column) else F.lit(budget)
    return F.format_string(ANSWER_FORMAT, _c(question), b.cast("string"), _c(content))


def shorten_prompt(budget: Column | int, content: Column | str) -> Column:
    b = budget if isinstance(budget, Column) else F.lit(budget)
    return F.format_string(SHORTEN_FORMAT, b.cast("string"), _c(content))


def chat_messages(prompt: Column | str) -> Column:
    """``[{"role": "system", ...}, {"role": "user", "content": prompt}]``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
        F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")))


# ------------------------------------------------------------ row products
def perspective_prompts(arts: DataFrame, budget: int = DEFAULT_BUDGET,
                        normalize_placeholder: bool = False) -> DataFrame:
    """One prompt per (article, template)."""
    return (arts.select("article_index", "content",
                        F.explode(template_array(normalize_placeholder)).alias("t"))
            .select("article_index", F.col("t.seq").alias("seq"),
                    perspective_prompt("t.template", budget, "content").alias("prompt")))


def spec_array() -> Column:
    return F.array(*[F.struct(F.lit(o).alias("spec_ord"), F.lit(cat).alias("category"),
                              F.lit(spec).alias("spec"), F.lit(n).alias("count"))
                     for o, cat, spec, n in QUESTION_SPECS])


def question_prompts(arts: DataFrame) -> DataFrame:
    """Generic + three targeted question requests per article."""
    return (arts.select("article_index", "content", F.explode(spec_array()).alias("q"))
            .select("article_index", "q.spec_ord", "q.category", "q.count",
                    question_prompt(F.col("q.spec_ord"), F.col("q.count"), F.col("q.spec"),
                                    F.col("content")).alias("prompt")))


def segment_prompts(arts: DataFrame, count: int = SEGMENT_COUNT,
                    per_segment: int = SEGMENT_QUESTION_COUNT) -> DataFrame:
    """One question request per overlapping segment of the article."""
    segs = T.context_segments(T.sentences("content"), count)
    return (R.posexplode_rows(arts, ["article_index"], segs, "segment", "segment_text")
            .select("article_index", "segment", "segment_text",
                    generic_question_prompt(per_segment, "segment_text").alias("prompt")))
