"""The trained sentence splitter: abbreviations of a corpus, odd texts."""

import random

from refract.functions import text as TX
from refract.operators import sentence_model as SM


def corpus():
    r = random.Random(5)
    names, nouns, verbs = ["Smith", "Jones", "Miller", "Brown"], ["house", "river", "garden", "engine", "paper", "answer"], ["saw", "liked", "found", "sold"]
    starts = ["The", "However", "Then", "Later"]
    out = []
    ends = ["noon", "town", "it", "corner", *nouns]         # words that also stand inside sentences
    for _ in range(500):
        k = r.randrange(5)
        noun, verb, a, b = r.choice(nouns), r.choice(verbs), r.choice(ends), r.choice(ends)
        out.append([f"{r.choice(starts)} {noun} by {a} was {verb} by Dr. {r.choice(names)} at the {b}.", f"{r.choice(starts)} J. {r.choice(names)} {verb} {a} and {b}.",
                    f"{r.choice(starts)} {a} cost 5 dollars approx. in the {b}.", f"Was the {a} {verb} near {b}?", f"{r.choice(starts)} they {verb} a {a} on the {noun} of {b}."][k])
    return [" ".join(out[i:i + 10]) for i in range(0, len(out), 10)]


def split(spark, model, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.s for r in df.select("i", SM.sentences("text", model).alias("s")).orderBy("i").collect()]


def test_abbreviations_are_learnt_and_no_sentence_ends(spark):
    df = spark.createDataFrame([(t,) for t in corpus()] + [(None,), ("",)], "text string")
    model = SM.load(SM.train(df))
    assert "dr" in model.abbreviations and "noon" not in model.abbreviations and "corner" not in model.abbreviations
    assert {"however", "then", "later"} <= set(model.starters)
    got = split(spark, model, ["The river was seen by Dr. Smith at noon. Then J. Brown sold the paper.  \n He said \"no.\" It rained!", None, "", "  ", "no end", "Dr. Smith", "a. b."])
    assert got == [["The river was seen by Dr. Smith at noon.", "Then J. Brown sold the paper.", "He said \"no.\" It rained!"], None, [], [], ["no end"], ["Dr. Smith"], ["a.", "b."]]
    whole = split(spark, model, corpus())
    assert all(s[0].isupper() and s[-1] in ".?" for x in whole for s in x) and sum(map(len, whole)) == 500


def test_without_a_model_it_is_the_rule(spark):
    texts = ["One. Two!  Three?\nfour", "a.b c. d", "\tx. ", "...  ..", "Dr. No. \r\n Yes"]
    none = SM.Model((), (), ())
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rule = [[s.strip() for s in r.s if s.strip()] for r in df.select(TX.sentences("text").alias("s")).collect()]
    assert split(spark, none, texts) == rule


def test_little_to_learn_from(spark):
    for texts in ([], [None], ["no stop at all"], ["All. Stops. Here."]):
        model = SM.train(spark.createDataFrame([(t,) for t in texts], "text string"))
        assert set(SM.load(model).collocations) == set()
    many = spark.createDataFrame([(" ".join(f"w{i}x. and" for i in range(50)),)] * 3, "text string")
    assert SM.train(many, most=7).groupBy("kind").count().where("count > 7").count() == 0


def test_words_and_ends_without_a_regex_a_token(spark):
    from pyspark.sql import functions as F
    toks = ["(\"Dr.\"),", "'", "[x]", "a..", ".", "(,)", "ß.;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(toks)], "i int, t string")
    rows = df.select("i", SM.word(F.col("t")), SM.bare(SM.word(F.col("t")))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [("dr.", "dr"), ("", ""), ("x", "x"), ("a..", "a."), (".", ""), ("", ""), ("ß.", "ß")]
    assert "regexp" not in str(SM.bare(SM.word(F.col("t")))).lower()


def test_every_entry_is_kept_and_a_large_model_is_joined(spark):
    # 2,100 abbreviations, each with its name: more than the 2,000 that were kept
    names = [f"{a}{b}{c}" for a in "bcdfghjklmnp" for b in "aeiou" for c in "bcdfghjklmnpqrstvwxyzàéëïöüçñøåæœßþð"][:2100]
    texts = [" ".join(f"so it was by {w}. Smith in a town" for w in names[i:i + 20]) + " and then it was." for i in range(0, 2100, 20)] * 6
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = SM.train(df)
    kept = {r.a for r in model.where("kind = 'abbreviation'").collect()}
    assert len(kept & set(names)) == 2100
    rows = [(None, texts[0]), (1, "By bab. Smith. He saw J. Brown. \n No"), (1, "By bab. Smith. He saw J. Brown. \n No"), (2, None), (3, ""), (4, " . "), (5, "a. b. \u0001 c. D"), (6, texts[-1])]
    docs = spark.createDataFrame(rows, "k int, text string")
    few, many = (sorted(SM.split(docs, ["k"], model, literals=n).collect(), key=str) for n in (10 ** 6, 0))
    assert few == many and len(few) == len(rows)
    assert [r.sentences for r in many if r.k == 1] == [["By bab. Smith.", "He saw J. Brown.", "No"]] * 2
    assert len(next(r for r in many if r.k == 6).sentences) == 1


def test_a_joined_model_is_the_model_as_literals(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "k int, text string")
    model = SM.train(df)
    few, many = (SM.split(df, ["k"], model, literals=n).orderBy("k").collect() for n in (10 ** 6, 0))
    assert few == many and sum(len(r.sentences) for r in many) == 500
