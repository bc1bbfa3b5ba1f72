"""Upsert vs append, evaluation properties."""

from pyspark.sql import functions as F

from refract.operators import embed as E
from refract.operators import evaluate as V
from refract.operators import generate as G
from refract.operators import index as X


def _batch(spark, rows, batch):
    df = spark.createDataFrame(rows, "vid long, v array<float>")
    return X.records(df, index_name="i", namespace="n", id_col=F.col("vid"), vec_col="v",
                     metadata=F.struct(F.col("vid").alias("index")), batch_ord=batch)


def test_upsert_replaces_append_keeps(spark):
    b0 = _batch(spark, [(1, [1.0]), (2, [2.0])], 0)
    b1 = _batch(spark, [(2, [9.0]), (3, [3.0])], 1)
    up = {r.id: r.embedding[0] for r in X.upsert(X.upsert(None, b0), b1).collect()}
    assert up == {"1": 1.0, "2": 9.0, "3": 3.0}
    again = {r.id: r.embedding[0] for r in X.upsert(X.upsert(X.upsert(None, b0), b1), b1).collect()}
    assert again == up   # idempotent
    k0 = b0.withColumn("_k", F.col("id").cast("long"))
    k1 = b1.withColumn("_k", F.col("id").cast("long"))
    ap = sorted((r.pos, r.id) for r in X.append(X.append(None, k0, ["_k"]), k1, ["_k"]).collect())
    assert ap == [(0, "1"), (1, "2"), (2, "2"), (3, "3")]


def test_dim_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    assert X.dim_check(df, "v", 2).count() == 1


def _res(spark, rows):
    return spark.createDataFrame(rows, "run_seq int, raw_index long, raw_q_seq long, category string, "
                                       "matched_index long, matched_seq int, predicted_index long, "
                                       "predicted_seq int, score double, hit boolean")


def test_accuracy_empty_is_null(spark):
    acc = V.accuracy(_res(spark, [])).collect()[0]
    assert acc.total == 0 and acc.accuracy is None


def test_miss_has_null_matches_and_breakdown_is_weighted(spark):
    qv = spark.createDataFrame([(0, 0, "generic", [1, 2]), (0, 1, "segment", [3]), (1, 0, "generic", [1])],
                               "raw_index long, raw_q_seq long, category string, qv array<int>")
    x = spark.createDataFrame([(0, 4, [1, 2], 4), (1, 4, [3, 1], 4), (0, 5, [2], 5), (1, 5, [1], 5)],
                              "x_index long, x_seq int, xv array<int>, run_seq int")
    m = V.retrieve(qv, x, (4, 5), k=2, dims=8)
    res = V.results(qv, m, (4, 5))
    rows = res.collect()
    for r in rows:
        if not r.hit:
            assert r.matched_index is None and r.matched_seq is None
        else:
            assert r.matched_index == r.raw_index
    b = {(r.category, r.run_seq): r for r in V.accuracy_breakdown(res).collect()}
    overall = b[(None, None)]
    cats = [v for (c, s), v in b.items() if c is not None and s is None]
    assert sum(v.n for v in cats) == overall.n
    assert abs(sum(v.accuracy * v.n for v in cats) / overall.n - overall.accuracy) < 1e-12
    h = sorted((r.run_seq, r.k, r.rate) for r in V.hit_at_k(qv, m, 2, (4, 5)).collect())
    for run in (4, 5):
        rates = [rate for s, _k, rate in h if s == run]
        assert rates == sorted(rates)   # hit@k non-decreasing in k


def test_cumulative_equals_isolated_on_union(spark):
    qv = spark.createDataFrame([(0, 0, "generic", [1, 2]), (1, 0, "generic", [3])],
                               "raw_index long, raw_q_seq long, category string, qv array<int>")
    pv = spark.createDataFrame([(0, 4, [1]), (1, 4, [3, 3]), (0, 5, [3]), (1, 5, [1, 2])],
                               "x_index long, x_seq int, xv array<int>")
    cum = V.retrieve(qv, V.run_index(pv, (4, 5), "cumulative"), (4, 5), 1, 8)
    union = pv.withColumn("run_seq", F.lit(5))
    iso = V.retrieve(qv, union, (5,), 1, 8)
    a = {(r.raw_index, r.predicted_index, r.predicted_seq) for r in V.results(qv, cum, (4, 5)).where("run_seq = 5").collect()}
    b = {(r.raw_index, r.predicted_index, r.predicted_seq) for r in V.results(qv, iso, (5,)).collect()}
    assert a == b == {(0, 1, 5), (1, 0, 5)}


def test_questions_without_tokens_miss(spark):
    qv = spark.createDataFrame([(0, 0, "generic", [1]), (0, 1, "generic", []), (1, 0, "segment", []), (1, 1, "segment", None)],
                               "raw_index long, raw_q_seq long, category string, qv array<int>")
    x = spark.createDataFrame([(0, 4, [1, 1], 4), (1, 4, [], 4)], "x_index long, x_seq int, xv array<int>, run_seq int")
    m = V.retrieve(qv, x, (4,), 2, 8)
    got = {(r.raw_index, r.raw_q_seq): (r.predicted_index, r.hit) for r in V.results(qv, m, (4,)).collect()}
    assert got == {(0, 0): (0, True), (0, 1): (None, False), (1, 0): (None, False), (1, 1): (None, False)}
    assert {(r.k, r.hits, r.total) for r in V.hit_at_k(qv, m, 2, (4,)).collect()} == {(1, 1, 4), (2, 1, 4)}


def test_open_or_create(spark, tmp_path):
    """No folder, an empty one or an unfinished version: created; otherwise
    the newest finished version is opened, whatever its number."""
    base = str(tmp_path / "idx")
    d = spark.createDataFrame([(1, [1.0])], "i long, v array<double>")
    rec = X.records(d, index_name="a", namespace="b", id_col=F.col("i"), vec_col="v", metadata=F.struct("i"))
    idx, version = X.open_or_create(spark, base, rec.schema)
    assert (idx.count(), version) == (0, 0)
    X.write_version(X.upsert(idx, rec), base, 9)
    X.write_version(X.upsert(None, rec.withColumn("id", F.lit("2"))).unionByName(rec), base, 10)
    (tmp_path / "idx" / "v000011").mkdir()
    idx, version = X.open_or_create(spark, base, rec.schema)
    assert version == 10 and sorted(r.id for r in idx.collect()) == ["1", "2"]


def test_mean_pool_cuts_a_long_group(spark):
    """Of 600 rows the first 512 count; a group at the cut keeps all."""
    rows = [(g, i, [float(i), 1.0]) for g, n in ((0, 600), (1, 512)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>").repartition(7)
    got = {(r.g, r.dim): r.value for r in E.mean_pool(df, "g", "i", "v").collect()}
    assert got == {(g, 0): 255.5 for g in (0, 1)} | {(g, 1): 1.0 for g in (0, 1)}


def test_callables_leave_the_input_frame_alone(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string")
    out = G.generate_with(df, "t", lambda: lambda ps: [p.upper() for p in ps])
    assert df.columns == ["i", "t"] and out.columns == ["i", "t", "response", "prompt_key"]
    assert {(r.i, r.response) for r in out.collect()} == {(1, "A B"), (2, "")}
    vecs = E.embed_with(df, "t", lambda: lambda ts: [[float(len(t))] for t in ts]).collect()
    assert {(r.i, r.embedding[0]) for r in vecs} == {(1, 3.0), (2, 0.0)}


def _odd_questions(spark):
    """Questions that share vectors, have no tokens, or repeat or lack keys."""
    rows = [(0, 0, "generic", [1, 2]), (0, 0, "generic", [1, 2]), (None, 0, "segment", [3]), (None, 0, "segment", [1]),
            (1, 0, "generic", []), (1, 1, "generic", None), (2, 0, "targeted", [1, 2]), (2, 1, "targeted", [6, 6]), (None, None, None, [3])]
    qv = spark.createDataFrame(rows, "raw_index long, raw_q_seq long, category string, qv array<smallint>").repartition(3)
    pv = spark.createDataFrame([(0, 4, [1]), (1, 4, [3, 3]), (2, 4, [2, 1]), (0, 5, [3]), (2, 5, [1, 2]), (1, 5, []), (None, 5, [3])],
                               "x_index long, x_seq int, xv array<smallint>")
    return qv, pv


def test_numbered_questions_give_the_rows_of_vectors(spark):
    qv, pv = _odd_questions(spark)
    runs, rows = (4, 5), lambda d: sorted(map(repr, d.collect()))
    questions, asked = V.numbered(qv)
    ids = {tuple(r.qv): r.qid for r in asked.collect()}
    assert set(ids) == {(1, 2), (3,), (1,), (6, 6)} and len(set(ids.values())) == 4 and min(ids.values()) >= 0
    assert questions.columns == ["raw_index", "raw_q_seq", "category", "qid"] and questions.count() == 9
    assert len({r.qid for r in questions.where("qid < 0").collect()}) == 2
    for k in (1, 3):
        a = V.cumulative(V.retrieve(qv, V.run_index(pv, runs), runs, k, 8), runs, k)
        b = V.cumulative(V.retrieve(asked, V.run_index(pv, runs), runs, k, 8), runs, k)
        assert "qv" not in b.columns
        want = rows(V.results(qv, a, runs))
        assert rows(V.results(questions, b, runs)) == want and len(want) == 18
        assert rows(V.hit_at_k(questions, b, k, runs)) == rows(V.hit_at_k(qv, a, k, runs))


def test_vectors_are_not_shuffled_for_each_run(spark):
    """After scoring no vector is shuffled, and no row of a question for each run:
    what one run more adds are its matches."""
    qv, pv = _odd_questions(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        questions, asked = V.numbered(qv)
        found = V.cumulative(V.retrieve(asked, V.run_index(pv, (4, 5)), (4, 5), 1, 8), (4, 5))
        plan = V.results(questions, found, (4, 5))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [line for line in plan.splitlines() if "Exchange " in line]
    # the blocks of questions, their matches, the questions
    assert len(shuffled) == 3, plan
    assert sum("hashpartitioning(qid" in line for line in shuffled) == 2 and not any("hashpartitioning(qv" in line or "run_seq" in line for line in shuffled)


def _numbering_shuffles(spark, qv, monkeypatch, **how):
    """The shuffles of each table that numbering stores, with the tables."""
    stored, keep = {}, V.materialize

    def seen(df, name, *a):
        plan = df._jdf.queryExecution().executedPlan().toString()
        stored[name] = [line for line in plan.splitlines() if "Exchange " in line and "RoundRobin" not in line]
        return keep(df, name, *a)

    monkeypatch.setattr(V, "materialize", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return stored, V.numbered(qv, **how)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_question_is_shuffled_to_be_numbered(spark, monkeypatch):
    """Distinct vectors alone travel: a question works its number out in its place."""
    qv, _ = _odd_questions(spark)
    stored, (questions, asked) = _numbering_shuffles(spark, qv, monkeypatch)
    assert (len(stored["asked"]), len(stored["questions"])) == (1, 0), stored
    of = {tuple(r.qv): r.qid for r in asked.collect()}
    got = sorted(map(repr, questions.collect()))
    want = qv.collect()
    assert got == sorted(repr(q) for q in spark.createDataFrame(
        [(r.raw_index, r.raw_q_seq, r.category, of[tuple(r.qv)]) for r in want if r.qv], questions.schema)
        .unionByName(questions.where("qid < 0")).collect()) and questions.where("qid < 0").count() == 2


def test_vectors_that_share_a_number_are_told_apart(spark, monkeypatch):
    """Where the numbers of different vectors clash, here (1, 2) with (3,), they are
    counted, and every result is that of the vectors."""
    qv, pv = _odd_questions(spark)
    clash = F.aggregate("qv", F.lit(0).cast("long"), lambda a, b: a + b)
    _, (questions, asked) = _numbering_shuffles(spark, qv, monkeypatch, number=clash)
    assert asked.count() == 4 == asked.select("qid").distinct().count() and asked.where("qid < 0").isEmpty()
    assert questions.count() == 9 and questions.where("qid < 0").count() == 2
    runs, rows = (4, 5), lambda d: sorted(map(repr, d.collect()))
    a, b = (V.retrieve(v, V.run_index(pv, runs), runs, 2, 8) for v in (qv, asked))
    assert rows(V.results(questions, b, runs)) == rows(V.results(qv, a, runs))
    assert rows(V.hit_at_k(questions, b, 2, runs)) == rows(V.hit_at_k(qv, a, 2, runs))


def test_the_evaluation_stores_vectors_and_no_texts(spark, tmp_path):
    from refract.plans import q_eval, q_generate
    docs = [(i, f"Title {i}\nThe cat sat on mat {i}. It slept. Then dogs came by and barked!", "en", "s", 60) for i in range(3)] + [(None, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    ds = q_eval.dataset_checkpointed(spark, str(tmp_path))
    assert "string" not in ds.schema.simpleString() and "smallint" in ds.schema.simpleString()
    texts = q_generate.dataset(spark, str(tmp_path))
    want = q_generate.question_long(texts).select("article_index", "q_seq", F.array_sort(E.hash_buckets("question")).alias("v"))
    got = q_generate.question_long(ds).select("article_index", "q_seq", F.col("question").alias("v"))
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect())) and want.count() > 3
    for s in V.RUNS:
        want = texts.select("article_index", E.hash_buckets(f"perspective_{s}").alias("v"))
        got = ds.select("article_index", F.col(f"perspective_{s}").alias("v"))
        assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))
