"""Inverted lists: recall against exact search, cost, odd input; runs over a
growing index."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from refract.operators import evaluate as V
from refract.operators import ivf as IVF
from refract.operators import knn as K

from sample_dirs import SF_CHECK


def vectors(spark, m, name, start=0):
    return spark.createDataFrame([(i + start, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, {name}v array<float>")


def recall(ix, q, x, k):
    found = {(r.q, r.x) for r in IVF.search(ix, q, k=k, q_id=["q"], q_vec="qv").collect()}
    true = {(r.q, r.x) for r in K.knn(q, x, k=k, q_id=["q"], x_id=["x"], q_vec="qv", x_vec="xv").collect()}
    return len(found & true) / len(true)


def test_clustered_vectors_reach_the_recall_with_few_pairs(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((60, 32))
    x = np.repeat(centres, 50, axis=0) + 0.25 * r.standard_normal((3000, 32))
    q = centres[r.integers(0, 60, 400)] + 0.25 * r.standard_normal((400, 32))
    qf, xf = vectors(spark, q, "q"), vectors(spark, x, "x")
    ix = IVF.tune(IVF.build(xf, ["x"], "xv"), qf, ["q"], "qv", k=3)
    assert recall(ix, qf, xf, 3) >= 0.95
    assert IVF.scored_share(ix, qf, ["q"], "qv") < 0.10 and ix.probes < len(ix.centroids)


def test_vectors_without_clusters_reach_it_too(spark):
    """The given vectors: near random, so many lists must be probed."""
    e = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    q, x = e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("x"), F.col("embedding").alias("xv"))
    not_self = [("q", "x")]
    ix = IVF.tune(IVF.build(x, ["x"], "xv"), q, ["q"], "qv", exclude=not_self)
    found = {r.q: r for r in IVF.search(ix, q, k=1, q_id=["q"], q_vec="qv", exclude=not_self).collect()}
    true = {r.q: r for r in K.knn(q, x, k=1, q_id=["q"], x_id=["x"], q_vec="qv", x_vec="xv", exclude=not_self).collect()}
    assert sum(found[i].x == true[i].x for i in true) >= 0.95 * len(true)
    assert all(found[i].score <= true[i].score + 1e-12 for i in found)


def test_all_lists_are_the_exact_search(spark):
    r = np.random.default_rng(4)
    qf, xf = vectors(spark, r.standard_normal((40, 8)), "q"), vectors(spark, np.vstack([r.standard_normal((90, 8)), np.zeros((2, 8))]), "x")
    ix = IVF.build(xf, ["x"], "xv", lists=7)
    assert ix.probes == len(ix.centroids) == 7 and recall(ix, qf, xf, 5) == 1.0
    assert IVF.scored_share(ix, qf, ["q"], "qv") == 1.0


def test_odd_rows(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "x long, xv array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "q long, qv array<float>")
    ix = IVF.tune(IVF.build(x, ["x"], "xv"), q, ["q"], "qv")
    assert {(r.q, r.x) for r in IVF.search(ix, q, k=1, q_id=["q"], q_vec="qv").collect()} == {(7, 1)}
    none = IVF.tune(IVF.build(x.where("x > 9"), ["x"], "xv"), q, ["q"], "qv")
    assert IVF.search(none, q, k=1, q_id=["q"], q_vec="qv").collect() == []


@pytest.mark.parametrize("k", [1, 3])
def test_runs_over_a_growing_index(spark, k):
    """Each template scored once and merged gives what each run over all its
    templates gives; so does a run that starts from the stored one before."""
    r = np.random.default_rng(k)
    bag = lambda n: [int(b) for b in r.integers(0, 6, n)]
    qv = spark.createDataFrame([(i, 0, "generic", sorted(bag(r.integers(0, 4)))) for i in range(60)],
                               "raw_index long, raw_q_seq long, category string, qv array<int>")
    pv = spark.createDataFrame([(i, s, bag(r.integers(0, 5))) for i in range(25) for s in (4, 5, 2)], "x_index long, x_seq int, xv array<int>")
    runs = (4, 5, 2)
    key = lambda df: sorted((x.run_seq, x.qv, x["rank"], x.x_index, x.x_seq, x.score) for x in df.collect())
    want = key(V.retrieve(qv, V.run_index(pv, runs, "cumulative"), runs, k, 8))
    found = V.retrieve(qv, V.run_index(pv, runs), runs, k, 8)
    assert key(V.cumulative(found, runs, k)) == want
    state = found.where("run_seq = 4")
    for run in (5, 2):
        state = V.advance(state, found.where(F.col("run_seq") == run), run, k)
        assert key(state) == [w for w in want if w[0] == run]


def test_l2_search_by_balls_is_exact_and_skips(spark):
    r = np.random.default_rng(9)
    centres = 10 * r.standard_normal((30, 6))
    x = np.vstack([np.repeat(centres, 40, axis=0) + r.standard_normal((1200, 6)), np.repeat(centres[:1], 3, axis=0)])
    q = np.vstack([centres[r.integers(0, 30, 200)] + r.standard_normal((200, 6)), 30 * r.standard_normal((20, 6)), centres[:1]])
    qf, xf = vectors(spark, q, "q"), vectors(spark, x, "x")
    key = lambda df: sorted((a.q, a["rank"], a.x, round(a.score, 6)) for a in df.collect())
    ix = IVF.build_balls(xf, ["x"], "xv")
    found, visited = IVF.l2_search(ix, qf, k=3, q_id=["q"], q_vec="qv")
    assert key(found) == key(K.knn(qf, xf, k=3, q_id=["q"], x_id=["x"], q_vec="qv", x_vec="xv", metric="l2"))
    assert IVF.skipped_share(ix, visited, 221) > 0.8
    far = IVF.build_balls(xf.limit(2), ["x"], "xv")                       # fewer rows than asked for
    found, _ = IVF.l2_search(far, qf.unionByName(spark.createDataFrame([(999, None)], qf.schema)), k=3, q_id=["q"], q_vec="qv")
    assert found.count() == 2 * 221
    none, _ = IVF.l2_search(IVF.build_balls(xf.limit(0), ["x"], "xv"), qf, k=3, q_id=["q"], q_vec="qv")
    assert none.count() == 0


def test_a_question_is_stored_once_not_once_a_ball(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F
    from refract.operators import ivf as IVF
    stored = {}

    def noted(df, name, kept=IVF.materialize):
        out = kept(df, name)
        stored[name] = out.count()
        return out
    monkeypatch.setattr(IVF, "materialize", noted)
    m = np.random.default_rng(2).standard_normal((60, 8))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "x int, xv array<double>")
    ix = IVF.build_balls(e, ["x"], "xv", balls=6)
    r, _ = IVF.l2_search(ix, e.select(F.col("x").alias("q"), F.col("xv").alias("qv")), k=3, q_id=["q"], q_vec="qv", exclude=[("q", "x")])
    assert r.count() == 180 and stored["first_balls"] == stored["other_balls"] == 60


def test_search_copies_no_question_and_scores_the_probed_lists(spark, monkeypatch):
    """As by brute force over each question's nearest lists, with lists in many
    blocks or many lists in one; a question isn't copied for each list."""
    rng = np.random.default_rng(5)
    m = rng.standard_normal((300, 6))
    m[7] = m[3]                                                       # a tie
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "x long, xv array<double>")
    q = x.select(F.col("x").alias("q"), F.col("xv").alias("qv")).unionByName(spark.createDataFrame([(999, None)], "q long, qv array<double>"))
    ix = replace(IVF.build(x, ["x"], "xv", lists=12), probes=4)
    at = {r.x: r["_list"] for r in ix.rows.collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.argsort(-(u @ ix.centroids.T), axis=1, kind="stable")[:, :4]
    cos = (u @ u.T).round(9)
    want = {i: sorted((j for j in range(300) if j != i and at[j] in near[i]), key=lambda j: (-cos[i, j], j))[:3] for i in range(300)}
    whole = IVF.K.knn

    def small(*args, **kw):
        return whole(*args, q_block=70, x_block=11, partitions=3, **kw)

    for knn in (whole, small):
        monkeypatch.setattr(IVF.K, "knn", knn)
        r = IVF.search(ix, q, k=3, q_id=["q"], q_vec="qv", exclude=[("q", "x")])
        plan = r._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "FlatMapCoGroups" not in plan
        got = {}
        for w in r.orderBy("q", "rank").collect():
            got.setdefault(w.q, []).append(w.x)
        assert got == want


def test_ball_search_copies_no_question_in_blocks_of_any_size(spark, monkeypatch):
    """Whole numbers, so many distances are equal; null and repeated keys; balls
    in many blocks or many balls in one.  Nothing is copied to a ball's blocks."""
    def copied(*_a, **_k):
        raise AssertionError("rows are copied for the blocks they meet")
    monkeypatch.setattr(K, "_cogrouped", copied)
    r = np.random.default_rng(12)
    x = np.vstack([r.integers(-2, 3, (400, 3)), np.repeat([[1, 1, 1]], 90, axis=0)]).astype(float)
    q = np.vstack([r.integers(-3, 4, (150, 3)), np.repeat([[1, 1, 1]], 80, axis=0)]).astype(float)
    xf = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(r.permutation(490), x)], "x int, xv array<double>")
    qf = spark.createDataFrame([(None if i == 3 else i // 2 if i < 20 else i, v.tolist()) for i, v in enumerate(q)], "q int, qv array<double>")
    rows = lambda df: sorted(((a.q, a.x, a["rank"], round(a.score, 9)) for a in df.collect()), key=str)
    plain, args = K.knn, dict(k=4, q_id=["q"], q_vec="qv", exclude=[("q", "x")])
    want = rows(plain(qf, xf, x_id=["x"], x_vec="xv", metric="l2", **args))
    ix = IVF.build_balls(xf, ["x"], "xv", balls=15)
    for sizes in (dict(), dict(q_block=16, x_block=32), dict(q_block=7, x_block=400, partitions=3)):
        monkeypatch.setattr(K, "knn", lambda *a, sizes=sizes, **k: plain(*a, **k, **sizes))
        found, _ = IVF.l2_search(ix, qf, **args)
        assert rows(found) == want


def test_small_groups_share_a_block_and_large_ones_are_cut():
    at, n = K._packed({2: 5, 0: 3, 7: 25, 8: 1, 9: 10}, 10)
    assert at == [(0, 0, 1), (2, 0, 1), (7, 1, 3), (8, 4, 1), (9, 5, 1)] and n == 6
    assert K._packed({}, 10) == ([], 0)
