"""Registered queries: vector similarity and nearest-neighbour joins over
the ``embeddings`` table (F14-F16, J5-J8, L1).  Every vector queries the
whole table (itself excluded); the namespace variant restricts matches to
the vector's own label."""

from __future__ import annotations

from pyspark.sql import functions as F

from refract.operators import embed as E
from refract.operators import ivf as IVF
from refract.operators import knn as K
from refract.plans.catalog import register
from refract.sources import tables

TOPK = 5
L2_TOPK = 3


def _emb(spark, sf):
    return tables.read_table(spark, sf, "embeddings")


def _self_knn(spark, sf, k, metric="cosine", ns=None):
    e = _emb(spark, sf)
    q = e.select("vec_id", "label", F.col("embedding").alias("qv"))
    x = e.select(F.col("vec_id").alias("nn_vec_id"), "label", F.col("embedding").alias("xv"))
    return K.knn(q, x, k=k, q_id=["vec_id"], x_id=["nn_vec_id"], q_vec="qv", x_vec="xv",
                 kind="dense", metric=metric, ns=ns, exclude=[("vec_id", "nn_vec_id")])


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _knn_sql(k: int, score: str, order: str, on: str = "a.vec_id <> b.vec_id",
             extra: str = "") -> str:
    return f"""
SELECT vec_id, {extra}rank, nn_vec_id, round(score, 6) AS score FROM (
  SELECT a.vec_id, {extra.replace('label', 'a.label')}b.vec_id AS nn_vec_id, {score} AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} {order}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON {on}) t
WHERE rank <= {k}"""


@register("cosine_pairs", """
WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS v FROM embeddings),
c AS (SELECT label, list(avg(v::DOUBLE) ORDER BY dim) AS centroid FROM u GROUP BY label, dim),
c2 AS (SELECT label, list(m ORDER BY dim) AS centroid FROM
       (SELECT label, dim, avg(v::DOUBLE) AS m FROM u GROUP BY label, dim) GROUP BY label)
SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c2.centroid), 6) AS cos_to_centroid
FROM embeddings e JOIN c2 USING (label)""")
def cosine_pairs(spark, sf):
    e = _emb(spark, sf)
    cent = E.pooled_vectors(
        e.select("label", F.posexplode("embedding").alias("dim", "v"))
         .groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("value")), "label")
    return (e.join(cent.withColumnRenamed("embedding", "centroid"), "label")
            .select("vec_id", "label",
                    F.round(K.cosine("embedding", "centroid"), 6).alias("cos_to_centroid")))


@register("knn_cosine_top1", f"""
SELECT vec_id, nn_vec_id, score FROM ({_knn_sql(1, _COS, 'DESC')})""")
def knn_cosine_top1(spark, sf):
    r = _self_knn(spark, sf, 1)
    return r.select("vec_id", "nn_vec_id", F.round("score", 6).alias("score"))


@register("knn_cosine_topk", _knn_sql(TOPK, _COS, "DESC"))
def knn_cosine_topk(spark, sf):
    r = _self_knn(spark, sf, TOPK)
    return r.select("vec_id", F.col("rank").cast("long").alias("rank"), "nn_vec_id",
                    F.round("score", 6).alias("score"))


@register("knn_l2_topk", _knn_sql(L2_TOPK, "pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)", "ASC"))
def knn_l2_topk(spark, sf):
    r = _self_knn(spark, sf, L2_TOPK, metric="l2")
    return r.select("vec_id", F.col("rank").cast("long").alias("rank"), "nn_vec_id",
                    F.round("score", 6).alias("score"))


@register("knn_l2_pruned", _knn_sql(L2_TOPK, "pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)", "ASC"))
def knn_l2_pruned(spark, sf):
    """The same by balls that are skipped where none of their rows can be near enough."""
    e = _emb(spark, sf)
    q = e.select("vec_id", F.col("embedding").alias("qv"))
    ix = IVF.build_balls(e.select(F.col("vec_id").alias("nn_vec_id"), F.col("embedding").alias("xv")), ["nn_vec_id"], "xv")
    r, _ = IVF.l2_search(ix, q, k=L2_TOPK, q_id=["vec_id"], q_vec="qv", exclude=[("vec_id", "nn_vec_id")])
    return r.select("vec_id", F.col("rank").cast("long").alias("rank"), "nn_vec_id", F.round("score", 6).alias("score"))


@register("knn_namespace", _knn_sql(1, _COS, "DESC", on="a.vec_id <> b.vec_id AND a.label = b.label",
                                    extra="label, "))
def knn_namespace(spark, sf):
    r = _self_knn(spark, sf, 1, ns="label")
    return r.select("vec_id", "label", F.col("rank").cast("long").alias("rank"), "nn_vec_id",
                    F.round("score", 6).alias("score"))


@register("knn_lsh_recall")
def knn_lsh_recall(spark, sf):
    """Approximate top-1 against exact top-1 for every vector (rows-only
    check; recall is asserted in the tests)."""
    e = _emb(spark, sf)
    q = e.select("vec_id", F.col("embedding").alias("qv"))
    x = e.select(F.col("vec_id").alias("nn_vec_id"), F.col("embedding").alias("xv"))
    dims = 64
    approx = K.lsh_knn(q, x, k=1, q_id=["vec_id"], x_id=["nn_vec_id"], q_vec="qv", x_vec="xv",
                       dims=dims, exclude=[("vec_id", "nn_vec_id")])
    exact = _self_knn(spark, sf, 1)
    return (exact.select("vec_id", F.col("nn_vec_id").alias("exact_nn"))
            .join(approx.select("vec_id", F.col("nn_vec_id").alias("lsh_nn")), "vec_id", "left")
            .select("vec_id", "exact_nn", "lsh_nn",
                    F.coalesce(F.col("exact_nn") == F.col("lsh_nn"), F.lit(False)).alias("hit")))


@register("knn_ivf_recall", "SELECT count(*)::BIGINT AS n_questions, TRUE AS recall_reached FROM embeddings")
def knn_ivf_recall(spark, sf):
    """Inverted lists tuned to a recall of 0.95: every vector's top-1 against
    the exact one."""
    e = _emb(spark, sf)
    q = e.select("vec_id", F.col("embedding").alias("qv"))
    x = e.select(F.col("vec_id").alias("nn_vec_id"), F.col("embedding").alias("xv"))
    not_self = [("vec_id", "nn_vec_id")]
    ix = IVF.tune(IVF.build(x, ["nn_vec_id"], "xv"), q, ["vec_id"], "qv", exclude=not_self)
    found = IVF.search(ix, q, k=1, q_id=["vec_id"], q_vec="qv", exclude=not_self)
    exact = _self_knn(spark, sf, 1).select("vec_id", F.col("nn_vec_id").alias("exact_nn"))
    hit = F.coalesce(F.col("exact_nn") == F.col("nn_vec_id"), F.lit(False))
    return (exact.join(found.select("vec_id", "nn_vec_id"), "vec_id", "left")
            .agg(F.count(F.lit(1)).alias("n_questions"), (F.count_if(hit) >= IVF.RECALL * F.count(F.lit(1))).alias("recall_reached")))
