"""Blocked k-NN against brute force; independence of block counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from refract.operators import knn as K


def _brute(qv, xv, k, exclude_self=False, l2=False):
    Q, X = np.array(qv, float), np.array(xv, float)
    if l2:
        S = -((Q[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    else:
        S = (Q @ X.T) / (np.linalg.norm(Q, axis=1)[:, None] * np.linalg.norm(X, axis=1)[None, :])
    if exclude_self:
        np.fill_diagonal(S, -np.inf)
    out = {}
    for i in range(len(Q)):
        order = sorted(range(len(X)), key=lambda j: (-S[i, j], j))[:k]
        out[i] = order
    return out


def _frames(spark, n=60, d=8, seed=0, dup=True):
    rng = np.random.default_rng(seed)
    V = rng.standard_normal((n, d)).round(3)
    if dup:
        V[5] = V[4]   # exact tie
    rows = [(i, [float(x) for x in V[i]], i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v array<double>, ns int")
    return V, df


def test_top1_and_topk_match_brute_force_for_any_blocks(spark):
    V, df = _frames(spark)
    q = df.select("id", F.col("v").alias("qv"))
    x = df.select(F.col("id").alias("nid"), F.col("v").alias("xv"))
    want1 = _brute(V, V, 1, exclude_self=True)
    want3 = _brute(V, V, 3, exclude_self=True)
    for qb, xb in [(1000, 1000), (7, 11), (3, 5)]:
        r = K.knn(q, x, k=3, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv",
                  exclude=[("id", "nid")], q_block=qb, x_block=xb).collect()
        got = {}
        for row in r:
            got.setdefault(row.id, []).append((row["rank"], row.nid))
        got = {i: [n for _, n in sorted(v)] for i, v in got.items()}
        assert got == want3, (qb, xb)
        assert {i: v[:1] for i, v in got.items()} == want1


def test_tie_breaks_to_lowest_key(spark):
    V, df = _frames(spark)
    q = df.where("id = 4").select("id", F.col("v").alias("qv"))
    x = df.select(F.col("id").alias("nid"), F.col("v").alias("xv"))
    r = K.knn(q, x, k=2, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv", x_block=2).collect()
    assert sorted((row["rank"], row.nid) for row in r) == [(1, 4), (2, 5)]


def test_namespace_and_l2(spark):
    V, df = _frames(spark, dup=False)
    q = df.select("id", "ns", F.col("v").alias("qv"))
    x = df.select(F.col("id").alias("nid"), "ns", F.col("v").alias("xv"))
    r = K.knn(q, x, k=1, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv", ns="ns",
              metric="l2", exclude=[("id", "nid")], q_block=9, x_block=7).collect()
    for row in r:
        same = [j for j in range(len(V)) if j % 3 == row.id % 3 and j != row.id]
        d = {j: ((V[row.id] - V[j]) ** 2).sum() for j in same}
        best = min(same, key=lambda j: (d[j], j))
        assert row.nid == best
        assert abs(row.score - d[best]) < 1e-9


def test_bucket_kernel_matches_dense(spark):
    rng = np.random.default_rng(3)
    qs = [(i, [int(b) for b in rng.integers(0, 16, rng.integers(1, 6))]) for i in range(40)]
    xs = [(j, [int(b) for b in rng.integers(0, 16, rng.integers(1, 20))]) for j in range(30)]
    q = spark.createDataFrame(qs, "qid long, qv array<int>")
    x = spark.createDataFrame(xs, "xid long, xv array<int>")
    r = K.knn(q, x, k=1, q_id=["qid"], x_id=["xid"], q_vec="qv", x_vec="xv", kind="buckets",
              dims=16, min_score=0.0, q_block=7, x_block=8).collect()
    Q = np.array([np.bincount(b, minlength=16) for _, b in qs], float)
    X = np.array([np.bincount(b, minlength=16) for _, b in xs], float)
    S = (Q @ X.T) / (np.sqrt((Q * Q).sum(1))[:, None] * np.sqrt((X * X).sum(1))[None, :])
    want = {}
    for i in range(len(qs)):
        if S[i].max() > 0:
            want[i] = min(range(len(xs)), key=lambda j: (-S[i, j], j))
    assert {row.qid: row.xid for row in r} == want


def test_lsh_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.select("vec_id", F.col("embedding").alias("qv"))
    x = e.select(F.col("vec_id").alias("nn"), F.col("embedding").alias("xv"))
    exact = K.knn(q, x, k=1, q_id=["vec_id"], x_id=["nn"], q_vec="qv", x_vec="xv",
                  exclude=[("vec_id", "nn")]).select("vec_id", F.col("nn").alias("e"))
    approx = K.lsh_knn(q, x, k=1, q_id=["vec_id"], x_id=["nn"], q_vec="qv", x_vec="xv", dims=64,
                       exclude=[("vec_id", "nn")]).select("vec_id", F.col("nn").alias("a"), "score")
    j = exact.join(approx, "vec_id", "left").toPandas()
    recall = (j.e == j.a).mean()
    assert 0.3 <= recall <= 1.0
    # every approximate answer scores no better than the exact best
    ex = K.knn(q, x, k=1, q_id=["vec_id"], x_id=["nn"], q_vec="qv", x_vec="xv",
               exclude=[("vec_id", "nn")]).select("vec_id", F.col("score").alias("best"))
    m = approx.join(ex, "vec_id").toPandas()
    assert (m.score <= m.best + 1e-12).all()


def _zipf_bags(rng, n, dims, lo, hi):
    p = 1.0 / np.arange(1, dims + 1)
    p /= p.sum()
    return [rng.choice(dims, size=rng.integers(lo, hi), p=p) for _ in range(n)]


@pytest.mark.parametrize("score_rows", [2048, 64])
def test_block_kernel_hot_and_cold_buckets_match_brute_force(monkeypatch, score_rows):
    """The NumPy block kernel alone: Zipf-distributed buckets give both
    densely scored (hot) and expanded (cold) buckets; top-3 with ties must
    equal a float64 brute force, including rows with empty bags."""
    monkeypatch.setattr(K, "SCORE_ROWS", score_rows)
    rng = np.random.default_rng(11)
    dims = 256
    qs = _zipf_bags(rng, 700, dims, 0, 25)
    xs = _zipf_bags(rng, 900, dims, 1, 120)
    xs[7] = xs[3].copy()                      # an exact tie
    qpdf = pd.DataFrame({"qid": np.arange(len(qs)), "_qv": qs})
    xpdf = pd.DataFrame({"xid": np.arange(len(xs))[::-1].copy(), "_xv": xs})  # unsorted keys
    got = K._block_topk(qpdf, xpdf, k=3, q_id=["qid"], x_id=["xid"], kind="buckets", dims=dims,
                        metric="cosine", min_score=0.0, exclude=[])
    Q = np.array([np.bincount(b, minlength=dims) for b in qs], float)
    X = np.array([np.bincount(b, minlength=dims) for b in xs], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        S = (Q @ X.T) / (np.sqrt((Q * Q).sum(1))[:, None] * np.sqrt((X * X).sum(1))[None, :])
    keys = xpdf["xid"].to_numpy()
    want = {}
    for i in range(len(qs)):
        ok = [j for j in range(len(xs)) if np.isfinite(S[i, j]) and S[i, j] > 0]
        best = sorted(ok, key=lambda j: (-S[i, j], keys[j]))[:3]
        if best:
            want[i] = [(int(keys[j]), round(S[i, j], 12)) for j in best]
    have = {}
    for r in got.sort_values(["qid", "_r"]).itertuples():
        have.setdefault(int(r.qid), []).append((int(r.xid), round(r.score, 12)))
    assert have == want
    # both paths of the kernel ran
    Qt = K._triplets(qpdf["_qv"], dims)
    Xt = K._triplets(xpdf["_xv"], dims)
    qdf = np.bincount(Qt[1], minlength=dims).astype(float)
    xdf = np.bincount(Xt[1], minlength=dims)
    hot = qdf * xdf > K.HOT_PAIR_FRACTION * len(qs) * len(xs)
    assert hot.any() and (~hot & (qdf > 0) & (xdf > 0)).any()


def test_bounded_and_sized_namespace_counts_agree(spark):
    """Block counts broadcast under a namespace bound, or written and sized
    by a job: the same matches either way."""
    V, df = _frames(spark, dup=False)
    q = df.select("id", "ns", F.col("v").alias("qv"))
    x = df.select(F.col("id").alias("nid"), "ns", F.col("v").alias("xv"))
    kw = dict(k=2, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv", ns="ns",
              exclude=[("id", "nid")], q_block=9, x_block=7)
    a = sorted(tuple(r) for r in K.knn(q, x, **kw).collect())
    b = sorted(tuple(r) for r in K.knn(q, x, ns_bound=3, **kw).collect())
    assert a == b and len(a) == 2 * len(V)


def test_kernel_is_exact_above_float32_integers():
    """Counts whose products pass 2 ** 24: the larger dot product wins by one."""
    n = 4097
    q = pd.DataFrame({"qid": [1], "_qv": [np.zeros(n, np.int64)]})
    x = pd.DataFrame({"xid": [1, 2], "_xv": [np.zeros(n, np.int64), np.concatenate([np.zeros(n, np.int64), [1]])]})
    dots = K._sparse_dots(K._triplets(q["_qv"], 4), K._triplets(x["_xv"], 4), 1, 2, 4, np.float64)
    assert dots.tolist() == [[n * n, n * n]]
    got = K._block_topk(q, x, k=2, q_id=["qid"], x_id=["xid"], kind="buckets", dims=4, metric="cosine", min_score=0.0, exclude=[])
    assert got.xid.tolist() == [1, 2] and got.score[0] == 1.0 and abs(got.score[1] - n / (n * n + 1) ** 0.5) < 1e-15


def test_a_wrong_namespace_bound_is_an_error(spark):
    V, df = _frames(spark, dup=False)
    q = df.select("id", "ns", F.col("v").alias("qv"))
    x = df.select(F.col("id").alias("nid"), "ns", F.col("v").alias("xv"))
    with pytest.raises(Exception, match="more than 1 namespaces"):
        K.knn(q, x, k=1, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv", ns="ns", ns_bound=1).collect()


def test_bound_of_the_kth_best():
    import numpy as np
    from refract.operators import knn as K
    for n, k in ((5, 3), (300, 3), (1000, 1), (1000, 5)):
        a = np.random.default_rng(n + k).standard_normal((20, n))
        true, low = np.sort(a, axis=1)[:, -k], K._kth_bound(a, k)
        assert (low <= true).all() and ((a >= low[:, None]).sum(axis=1) >= k).all()


def _copies(df):
    """Nodes of a plan that multiply rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Generate explode") + plan.count("FlatMapCoGroups")


def test_streamed_blocks_copy_no_rows(spark):
    """The rows a query shuffles don't grow with the number of blocks they
    meet, and many blocks in few tasks give the brute force's rows; with a
    namespace too."""
    V, df = _frames(spark)
    q = df.select("id", "ns", F.col("v").alias("qv"))
    x = df.select(F.col("id").alias("nid"), "ns", F.col("v").alias("xv"))
    for partitions in (1, 3, 40):
        kw = dict(k=3, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv", exclude=[("id", "nid")], q_block=7, x_block=5, partitions=partitions)
        r = K.knn(q, x, **kw)
        assert _copies(r) == 0
        got = {}
        for row in r.orderBy("id", "rank").collect():
            got.setdefault(row.id, []).append(row.nid)
        assert got == _brute(V, V, 3, exclude_self=True)
        few = K.knn(q, x, ns="ns", ns_bound=3, **kw)
        assert _copies(few) == 0
        many = K.knn(q, x, ns="ns", **kw)                    # the cogroup
        key = lambda rows: sorted((w.id, w["rank"], w.nid, round(w.score, 12)) for w in rows)
        assert key(few.collect()) == key(many.collect())


def test_streamed_blocks_with_null_and_repeated_keys(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0]), (2**60 + 1, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    x = df.select(F.col("id").alias("nid"), F.col("v").alias("xv"))
    q = df.where("id > 1").select("id", F.col("v").alias("qv"))
    for x_block in (1, 2, 100):
        r = K.knn(q, x, k=5, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv", x_block=x_block).collect()
        got = {i: [w.nid for w in sorted(r, key=lambda w: w["rank"]) if w.id == i] for i in (2, 2**60 + 1)}
        assert got == {2: [2, 2**60 + 1, None, 1, 1], 2**60 + 1: [2**60 + 1, 2, None, 1, 1]}, x_block


def test_empty_sides_give_no_rows(spark):
    V, df = _frames(spark)
    q = df.select("id", F.col("v").alias("qv"))
    x = df.select(F.col("id").alias("nid"), F.col("v").alias("xv"))
    kw = dict(k=2, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv")
    assert K.knn(q, x.limit(0), **kw).count() == K.knn(q.limit(0), x, **kw).count() == 0


def test_cold_buckets_laid_out_or_expanded_are_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    q, x = (K._triplets(pd.Series(_zipf_bags(rng, n, 300, 0, 30)), 300) for n in (90, 700))
    want = np.zeros((90, 700))
    Q, X = np.zeros((90, 300)), np.zeros((700, 300))
    Q[q[0], q[1]], X[x[0], x[1]] = q[2], x[2]
    want = Q @ X.T
    for cells, least in ((1 << 21, 256), (300 * 64, 8), (1 << 10, 256)):     # at once, in ranges, pair by pair
        monkeypatch.setattr(K, "COLD_CELLS", cells)
        monkeypatch.setattr(K, "COLD_COLUMNS", least)
        assert (K._sparse_dots(q, x, 90, 700, 300) == want).all()


def test_queries_asked_in_every_namespace(spark):
    """One row a query, whatever the number of namespaces: the rows of a query
    copied to each of them, and no node of the plan that copies."""
    V, df = _frames(spark)
    x = df.select(F.col("id").alias("nid"), F.when(F.col("id") != 7, F.col("ns")).alias("ns"), F.col("v").alias("xv"))
    q = df.where("id % 2 = 0").unionByName(df.where("id = 4")).select("id", F.col("v").alias("qv"))
    copied = q.crossJoin(spark.createDataFrame([(0,), (1,), (2,)], "ns int"))
    key = lambda d: sorted((w.ns, w.id, w["rank"], w.nid, w.score) for w in d.collect())
    for partitions, x_block in ((1, 100), (3, 5), (40, 4)):
        kw = dict(k=3, q_id=["id"], x_id=["nid"], q_vec="qv", x_vec="xv", ns="ns", ns_bound=3, exclude=[("id", "nid")],
                  q_block=7, x_block=x_block, partitions=partitions)
        once = K.knn(q, x, **kw)
        assert _copies(once) == 0
        assert once.columns == ["ns", "id", "nid", "score", "rank"]
        assert key(once) == key(K.knn(copied, x, **kw))
    kw.pop("ns_bound")
    with pytest.raises(ValueError, match="bound of 16 namespaces"):
        K.knn(q, x, **kw)
    none = K.knn(q, x.limit(0), ns_bound=3, **kw)
    assert none.count() == K.knn(q.limit(0), x, ns_bound=3, **kw).count() == 0
