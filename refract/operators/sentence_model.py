"""Sentence splitting with a model learnt from the corpus.

The rule of :func:`refract.functions.text.sentences` ends a sentence at every
full stop before white space, also behind "Dr.".  This is the other choice,
after Kiss and Strunk (2006), "Unsupervised Multilingual Sentence Boundary
Detection": three lists are learnt from unlabelled text by log-likelihood
ratios of counts,

* ``abbreviation``: words that nearly always have a full stop and are short;
* ``starter``: words that follow a sentence's end more often than chance;
* ``collocation``: pairs around a full stop behind an abbreviation, a number or
  a single letter, that stand together more often than chance,

and a full stop ends no sentence behind an abbreviation (or a single letter
before a capital), unless a starter follows, nor inside a collocation.

Training is three aggregations of tokens with partial counts; every entry that
reaches its threshold is kept, so the lists grow with the corpus.  While they are
short (``LITERALS`` entries) the splitter is a column expression with literal
sets (:func:`sentences`); longer ones are joined to the ends of sentences
(:func:`split`), with the same result.  Neither needs Python.

Defined results: a null text has no sentences (null), an empty one an empty
list; a corpus without full stops gives empty lists, and the splitter is the
rule with ends trimmed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refract.functions import rows as R
from refract.session import materialize

#: Entries of each list of the query ``sentence_model``, at most.
MOST = 2000
#: Entries of a model, at most, that stand as literals in an expression.
LITERALS = 6000
#: Fixed values of the published method.
ABBREVIATION, STARTER, COLLOCATION, P_STOP = 0.3, 30.0, 7.88, 0.99
BLANK = "[ \\t\\n\\r\\f]"
TOKEN = "[^ \\t\\n\\r\\f]+"
#: What may stand around a word.
OPEN, CLOSE = "[(\"'\\[]+", "[)\"'\\],;:]+"
#: The same characters one by one, as trim takes them.
BLANKS, OPENS, CLOSES = " \t\n\r\f", "(\"'[", ")\"'],;:"
_END = "\u0001"


def word(token: Column) -> Column:
    """A token in small letters without quotes, brackets and commas."""
    return F.lower(F.rtrim(F.ltrim(token, F.lit(OPENS)), F.lit(CLOSES)))


def bare(w: Column) -> Column:
    """A word without its last full stop."""
    return F.when(w.endswith("."), F.left(w, F.length(w) - 1)).otherwise(w)


def dunning(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of ``ab`` common occurrences of two events with
    ``a`` and ``b`` occurrences in ``n``."""
    def part(k: Column, m: Column, p: Column) -> Column:
        # k ln p + (m - k) ln(1 - p), where 0 ln 0 is 0
        return (F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(m > k, (m - k) * F.log(1 - p)).otherwise(0.0))

    a, b, ab, n = (x.cast("double") for x in (a, b, ab, n))
    return -2 * (part(ab, a, b / n) + part(b - ab, n - a, b / n) - part(ab, a, ab / a) - part(b - ab, n - a, (b - ab) / (n - a)))


def train(docs: DataFrame, text_col: str = "text", most: int | None = None) -> DataFrame:
    """``kind``, ``a``, ``b`` (null but for collocations), ``score``, stored.
    ``most``: the best entries of each list alone, that many (none: all)."""
    toks = F.filter(F.split(F.col(text_col), BLANK + "+"), lambda x: x != "")
    # each token becomes a word once, whether it is met as a word or as the next one
    d = docs.select(F.transform(toks, word).alias("t"))
    pairs = F.arrays_zip(F.col("t").alias("w"), F.slice("t", 2, F.greatest(F.size("t"), F.lit(0))).alias("y"))
    t = (R.explode_rows(d, [], pairs, "p").select("p.w", bare(F.col("p.w")).alias("a"), bare(F.col("p.y")).alias("b")).where("a <> ''"))
    stop = F.col("w").endswith(".")
    # one table of narrow counts for everything that follows: (word, stop, next word)
    counts = materialize(t.groupBy("a", stop.alias("stop"), F.when(stop, F.col("b")).alias("b")).agg(F.count(F.lit(1)).alias("n")), "sentence_counts")
    total = F.broadcast(counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("stop"), F.col("n"))).alias("stops")))        # one row
    words = materialize(counts.groupBy("a").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("with_stop")), "sentence_words")

    dots = F.length(F.regexp_replace("a", "[^.]", "")) + 1
    signs = F.length("a") - dots + 1
    p = F.col("stops") / F.col("total")
    without = F.col("n") - F.col("with_stop")
    ratio = -2 * ((F.col("with_stop") * F.log(p) + without * F.log(1 - p)) - (F.col("with_stop") * F.log(F.lit(P_STOP)) + without * F.log(F.lit(1 - P_STOP))))
    score = ratio * F.exp(-signs.cast("double")) * dots * F.pow(signs.cast("double"), -without.cast("double"))

    def best(df: DataFrame, low: float) -> DataFrame:
        kept = df.where(F.col("score") >= low)
        return kept if most is None else kept.orderBy(F.col("score").desc(), "a", "b").limit(most)

    none = F.lit(None).cast("string")
    abbreviations = materialize(best(
        words.join(total, how="cross").where((F.col("with_stop") > 0) & (F.col("with_stop") < F.col("total")) & (signs > 0) & F.col("a").rlike("\\p{L}") & (p < 1))
        .select(F.lit("abbreviation").alias("kind"), "a", none.alias("b"), score.alias("score")), ABBREVIATION), "abbreviations")

    pairs = counts.where("stop and b is not null and b <> ''").join(
        abbreviations.select("a", F.lit(True).alias("abbr")), "a", "left").withColumn("abbr", F.coalesce("abbr", F.lit(False)))
    odd = F.col("abbr") | F.col("a").rlike("^(\\p{L}|[0-9]+)$")
    known = words.select(F.col("a").alias("b"), F.col("n").alias("n_b"))
    ends = pairs.where(~odd)
    breaks = F.broadcast(ends.agg(F.sum("n").alias("breaks")))                       # one row
    often = lambda a, ab: ab * F.col("total") > a * F.col("n_b")
    starters = (ends.where(F.col("b").rlike("\\p{L}")).groupBy("b").agg(F.sum("n").alias("ab")).join(known, "b")
                .join(total, how="cross").join(breaks, how="cross").where("ab <= n_b and breaks < total").where(often(F.col("breaks"), F.col("ab")))
                .select(F.lit("starter").alias("kind"), F.col("b").alias("a"), none.alias("b"),
                        dunning(F.col("breaks"), F.col("n_b"), F.col("ab"), F.col("total")).alias("score")))
    collocations = (pairs.where(odd).groupBy("a", "b").agg(F.sum("n").alias("ab")).where("ab > 1")
                    .join(words.select("a", F.col("n").alias("n_a")), "a").join(known, "b").join(total, how="cross")
                    .where("ab <= n_b and n_a < total").where(often(F.col("n_a"), F.col("ab")))
                    .select(F.lit("collocation").alias("kind"), "a", "b", dunning(F.col("n_a"), F.col("n_b"), F.col("ab"), F.col("total")).alias("score")))
    return materialize(abbreviations.unionByName(best(starters, STARTER)).unionByName(best(collocations, COLLOCATION)), "sentence_model")


@dataclass(frozen=True)
class Model:
    abbreviations: tuple[str, ...]
    starters: tuple[str, ...]
    collocations: tuple[str, ...]


def load(model: DataFrame) -> Model:
    """The lists of :func:`train`, all in the driver: for a model of few entries."""
    rows = model.select("kind", "a", "b").collect()
    of = lambda kind: tuple(sorted(r.a if r.b is None else f"{r.a} {r.b}" for r in rows if r.kind == kind))
    return Model(of("abbreviation"), of("starter"), of("collocation"))


def _in(x: Column, words: tuple[str, ...]) -> Column:
    return x.isin(list(words)) if words else F.lit(False)


def _pieces(c: Column | str) -> Column:
    """The text cut behind each white space that follows an end mark."""
    c = F.col(c) if isinstance(c, str) else c
    return F.split(F.regexp_replace(c, f"([.!?])({BLANK}+)", "$1$2" + _END), _END, -1)


def _found(pieces: Column) -> Column:
    """Each piece with its first and last word (``f``, ``l``) and their small
    forms (``b``, ``a``)."""
    # a piece's last and first word and what follows from them are found once
    # each: a lambda evaluates an expression as often as it is named
    def ends(piece: Column) -> Column:
        return F.struct(piece.alias("p"), F.regexp_extract(piece, TOKEN, 0).alias("f"), F.when(
            F.translate(F.right(piece, F.lit(1)), BLANKS, " " * len(BLANKS)) == " ", F.translate(piece, BLANKS, " " * len(BLANKS))).alias("l"))

    def words(x: Column) -> Column:
        return F.struct(x["p"].alias("p"), F.ltrim(x["f"], F.lit(OPENS)).alias("f"),
                        F.coalesce(F.substring_index(F.rtrim(x["l"]), " ", -1), F.lit("")).alias("l"))

    def bares(x: Column) -> Column:
        return x.withField("a", word(x["l"])).withField("b", word(x["f"]))

    return F.transform(F.transform(F.transform(pieces, ends), words), bares)


def _after(found: Column) -> Column:
    """The next piece of each; behind the last one an empty piece."""
    end = F.struct(*[F.lit("").alias(x) for x in ("p", "f", "l", "a", "b")])
    return F.concat(F.slice(found, 2, F.size(found)), F.array(end))


def _lone(a: Column, first: Column) -> Column:
    """A single letter before a capital."""
    return a.rlike("^\\p{L}$") & first.rlike("^\\p{Lu}")


def _parts(marked: Column) -> Column:
    trimmed = F.transform(F.split(marked, _END, -1), lambda s: F.btrim(s, F.lit(BLANKS)))
    return F.filter(trimmed, lambda s: s != "")


def sentences(c: Column | str, model: Model) -> Column:
    """``array<string>``: the sentences, without white space at their ends."""
    def mark(piece: Column, after: Column) -> Column:
        last, first, a, b = piece["l"], after["f"], bare(piece["a"]), bare(after["b"])
        short = _in(a, model.abbreviations) | _lone(a, first)
        inside = last.endswith(".") & ((short & ~_in(b, model.starters)) | _in(F.concat(a, F.lit(" "), b), model.collocations))
        return F.concat(piece["p"], F.when(inside, "").otherwise(_END))

    return _parts(F.transform(F.array(_found(_pieces(c))), lambda p: F.array_join(F.zip_with(p, _after(p), mark), ""))[0])


def split(docs: DataFrame, keep: Sequence[str], model: DataFrame, text_col: str = "text", literals: int = LITERALS) -> DataFrame:
    """``keep..., sentences`` of each row of ``docs`` with a stored model of any
    size: where it has more than ``literals`` entries, the full stops that may
    end a sentence meet its lists in joins, and their places meet the texts."""
    if model.limit(literals + 1).count() <= literals:
        return docs.select(*keep, sentences(text_col, load(model)).alias("sentences"))
    # rows are told apart by a number that is stored: keys may repeat or be null
    d = materialize(docs.select(*keep, F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row")), "sentence_texts")

    def stop(x: Column, y: Column) -> Column:
        a = bare(x["a"])
        return F.struct(x["l"].endswith(".").alias("stop"), a.alias("a"), bare(y["b"]).alias("b"), _lone(a, y["f"]).alias("lone"))

    stops = F.transform(F.array(_found(_pieces("_text"))), lambda p: F.zip_with(p, _after(p), stop))[0]
    yes = F.lit(True)
    of = {kind: model.where(F.col("kind") == kind) for kind in ("abbreviation", "starter", "collocation")}
    inside = (R.posexplode_rows(d, ["_row"], stops, "_at", "s").where("s.stop").select("_row", "_at", "s.a", "s.b", "s.lone")
              .join(of["abbreviation"].select("a", yes.alias("abbr")), "a", "left")
              .join(of["starter"].select(F.col("a").alias("b"), yes.alias("start")), "b", "left")
              .join(of["collocation"].select("a", "b", yes.alias("coll")), ["a", "b"], "left")
              .where("((lone or abbr is not null) and start is null) or coll is not null"))
    places = inside.groupBy("_row").agg(F.sort_array(F.collect_list("_at")).alias("_at"))            # of one text
    # a mark for each piece up to the last place, made in one pass
    gap = lambda at, before: F.concat(F.array_repeat(F.lit(False), at - before - 1), F.array(yes))
    marks = F.flatten(F.zip_with("_at", F.concat(F.array(F.lit(-1)), F.slice("_at", 1, F.size("_at") - 1)), gap))
    marks = F.coalesce(marks, F.array().cast("array<boolean>"))
    marked = F.array_join(F.zip_with(_pieces("_text"), marks, lambda p, m: F.concat(p, F.when(m, "").otherwise(_END))), "")
    return d.join(places, "_row", "left").select(*keep, _parts(marked).alias("sentences"))
