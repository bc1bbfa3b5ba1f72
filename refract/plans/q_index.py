"""Registered queries: embeddings and the vector index (T9-T14, K4-K6, P7,
F12, F16, W3, A6, A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from refract.functions import prompts as P
from refract.operators import bucketed_index as B
from refract.operators import embed as E
from refract.operators import generate as G
from refract.operators import index as X
from refract.plans import q_generate as QG
from refract.plans import sqlx as Q
from refract.plans.catalog import register
from refract.session import materialize, scratch_path
from refract.sources import tables
from refract.functions import rows as R

DIMS = E.DEFAULT_DIMS
EMB_DIMS = 64
REEMBED_LABEL_BELOW = 5   # second batch: vectors of these labels re-embedded
SHORT_DIM_LABEL = 0       # rows of this label arrive truncated (dimension check)
ONE_SEQ = 4


def _buckets_md5(c):
    return F.md5(F.array_join(F.transform(c, lambda b: b.cast("string")), ","))


def _vector_md5(c):
    return F.md5(F.array_join(F.transform(c, lambda v: F.floor(v.cast("double") * 1e6).cast("string")), ","))


def _emb(spark, sf):
    return tables.read_table(spark, sf, "embeddings")


@register("hash_embedding", f"""
WITH t AS (SELECT doc_id, unnest({Q.tokens('text')}) AS tok FROM documents)
SELECT doc_id, {Q.bucket('tok', DIMS)}::INTEGER AS bucket, count(*)::BIGINT AS cnt FROM t GROUP BY ALL""")
def hash_embedding(spark, sf):
    d = tables.read_table(spark, sf, "documents").select("doc_id", E.hash_buckets("text", DIMS).alias("b"))
    return E.bucket_counts(d, ["doc_id"], "b")


@register("mean_pool_embedding", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS tok_pos FROM embeddings),
u AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v FROM r
      WHERE tok_pos < {E.MAX_TOKENS})
SELECT label, dim::INTEGER AS dim, round(avg(v::DOUBLE), 6) AS value FROM u GROUP BY label, dim""")
def mean_pool_embedding(spark, sf):
    """Token vectors = the rows of one label in vec_id order, truncated at
    512, mean-pooled per dimension."""
    m = E.mean_pool(_emb(spark, sf), "label", "vec_id", "embedding", E.MAX_TOKENS)
    return m.select("label", "dim", F.round("value", 6).alias("value"))


def _persp_long(spark, sf):
    d = QG.dataset(spark, sf)
    return R.posexplode_rows(d, ["article_index"], F.col("sumarries"), "seq", "perspective")


@register("index_records", "WITH " + QG.PERSPECTIVES_CTE + f"""
SELECT article_index::VARCHAR || seq::VARCHAR AS id,
       row_number() OVER (ORDER BY article_index, seq) - 1 AS rec_ord,
       article_index AS meta_index, seq::INTEGER AS meta_sequence,
       len({Q.tokens('perspective')})::BIGINT AS n_tokens, {Q.buckets_md5('perspective', DIMS)} AS vec_md5
FROM persp""")
def index_records(spark, sf):
    p = _persp_long(spark, sf).withColumn("xv", E.hash_buckets("perspective", DIMS))
    r = X.records(p, index_name="hfperspectives", namespace="perspectives",
                  id_col=X.legacy_id("article_index", "seq"), vec_col="xv",
                  metadata=F.struct(F.col("article_index").alias("index"), F.col("seq").alias("sequence")))
    # stored first: the sort reads its input twice, for its bounds and for its rows
    r = tables.index_rows(materialize(r, "records"), ["metadata.index", "metadata.sequence"], "rec_ord")
    return r.select("id", "rec_ord", F.col("metadata.index").alias("meta_index"),
                    F.col("metadata.sequence").alias("meta_sequence"),
                    F.size("embedding").cast("long").alias("n_tokens"),
                    _buckets_md5("embedding").alias("vec_md5"))


def _batches(spark, sf):
    e = _emb(spark, sf)
    b0 = X.records(e, index_name="embeddings", namespace="all", id_col=F.col("vec_id"),
                   vec_col="embedding", metadata=F.struct(F.col("label").alias("label")), batch_ord=0)
    b1 = X.records(e.where(F.col("label") < REEMBED_LABEL_BELOW).withColumn("embedding", F.reverse("embedding")),
                   index_name="embeddings", namespace="all", id_col=F.col("vec_id"), vec_col="embedding",
                   metadata=F.struct(F.col("label").alias("label")), batch_ord=1)
    return b0, b1


_BATCH_SQL = f"""
WITH b AS (SELECT vec_id, embedding, 0 AS batch_ord FROM embeddings
           UNION ALL SELECT vec_id, list_reverse(embedding), 1 FROM embeddings WHERE label < {REEMBED_LABEL_BELOW})"""


_LATEST_SQL = _BATCH_SQL + f"""
SELECT vec_id::VARCHAR AS id, max(batch_ord) AS batch_ord,
       {Q.vector_md5('arg_max(embedding, batch_ord)')} AS vec_md5"""


@register("index_upsert", _LATEST_SQL + """
FROM b GROUP BY vec_id""")
def index_upsert(spark, sf):
    b0, b1 = _batches(spark, sf)
    idx = X.upsert(X.upsert(None, b0), b1)
    return idx.select("id", "batch_ord", _vector_md5("embedding").alias("vec_md5"))


@register("index_open_or_create", _LATEST_SQL + """, 2::BIGINT AS version
FROM b GROUP BY vec_id""")
def index_open_or_create(spark, sf):
    """Each batch opens the stored index (absent at first), upserts and
    stores the next version."""
    base = scratch_path(spark, "index")
    batches = _batches(spark, sf)
    schema = batches[0].schema
    for b in batches:
        idx, version = X.open_or_create(spark, base, schema)
        X.write_version(X.upsert(idx, b), base, version + 1)
    idx, version = X.open_or_create(spark, base, schema)
    return idx.select("id", "batch_ord", _vector_md5("embedding").alias("vec_md5"),
                      F.lit(version).cast("long").alias("version"))


@register("index_bucketed_upsert", _LATEST_SQL + """, 3::BIGINT AS version
FROM b GROUP BY vec_id""")
def index_bucketed_upsert(spark, sf):
    """Both batches into a bucketed index, then a compaction of what grew."""
    base = scratch_path(spark, "bucketed")
    batches = _batches(spark, sf)
    ix = B.open_index(spark, base, batches[0].schema)
    for b in batches:
        ix = B.upsert(ix, b)
    B.compact(ix)
    ix = B.open_index(spark, base, batches[0].schema)
    return B.read(ix).select("id", "batch_ord", _vector_md5("embedding").alias("vec_md5"),
                             F.lit(ix.version).cast("long").alias("version"))


@register("index_user_records", f"""
SELECT 'perspectives' AS namespace, conv_id || '-' || turn AS id, conv_id::VARCHAR AS user_id, role AS user_name,
       turn % 2 = 0 AS is_published, {Q.buckets_md5('text', DIMS)} AS vec_md5
FROM conversations""")
def index_user_records(spark, sf):
    """Records with their user's metadata; a conversation stands for a user
    and each of its turns for a perspective."""
    c = tables.read_table(spark, sf, "conversations").withColumn("xv", E.hash_buckets("text", DIMS))
    r = X.records(c, index_name="user_perspectives", namespace="perspectives",
                  id_col=F.concat_ws("-", "conv_id", "turn"), vec_col="xv",
                  metadata=X.user_metadata(F.col("conv_id"), F.col("role"), F.col("turn") % 2 == 0))
    return X.upsert(None, r).select("namespace", "id", "metadata.user_id", "metadata.user_name",
                                    "metadata.is_published", _buckets_md5("embedding").alias("vec_md5"))


@register("l2_index_append", _BATCH_SQL + f"""
SELECT row_number() OVER (ORDER BY batch_ord, vec_id) - 1 AS pos, vec_id::VARCHAR AS id, batch_ord,
       {Q.vector_md5('embedding')} AS vec_md5 FROM b""")
def l2_index_append(spark, sf):
    b0, b1 = _batches(spark, sf)
    k0 = b0.withColumn("_k", F.col("id").cast("long")).withColumn("embedding", F.col("embedding").cast("array<float>"))
    k1 = b1.withColumn("_k", F.col("id").cast("long")).withColumn("embedding", F.col("embedding").cast("array<float>"))
    idx = X.append(X.append(None, k0, ["_k"]), k1, ["_k"])
    return idx.select("pos", "id", "batch_ord", _vector_md5("embedding").alias("vec_md5"))


@register("index_dim_check", f"""
WITH b AS (SELECT embedding FROM embeddings
           UNION ALL SELECT embedding[1:{EMB_DIMS - 1}] FROM embeddings WHERE label = {SHORT_DIM_LABEL})
SELECT count(*)::BIGINT AS n_total, count_if(len(embedding) = {EMB_DIMS})::BIGINT AS n_ok,
       count_if(len(embedding) <> {EMB_DIMS})::BIGINT AS n_bad FROM b""")
def index_dim_check(spark, sf):
    e = _emb(spark, sf)
    b = e.select("embedding").unionByName(
        e.where(F.col("label") == SHORT_DIM_LABEL).select(F.slice("embedding", 1, EMB_DIMS - 1).alias("embedding")))
    return b.agg(F.count(F.lit(1)).alias("n_total"),
                 F.count_if(X.dim_ok("embedding", EMB_DIMS)).alias("n_ok")) \
        .select("n_total", "n_ok", (F.col("n_total") - F.col("n_ok")).alias("n_bad"))


def _index_sql(seqs: str, index_name: str) -> str:
    return "WITH " + QG.PERSPECTIVES_CTE + f"""
SELECT '{index_name}' AS index_name, 'perspectives' AS namespace,
       article_index::VARCHAR || seq::VARCHAR AS id, article_index AS meta_index,
       seq::INTEGER AS meta_sequence, len({Q.tokens('perspective')})::BIGINT AS n_tokens,
       {Q.buckets_md5('perspective', DIMS)} AS vec_md5
FROM persp WHERE seq IN ({seqs})"""


def _index_out(idx):
    return idx.select("index_name", "namespace", "id", F.col("metadata.index").alias("meta_index"),
                      F.col("metadata.sequence").alias("meta_sequence"),
                      F.size("embedding").cast("long").alias("n_tokens"),
                      _buckets_md5("embedding").alias("vec_md5"))


@register("index_one_sequence", _index_sql(str(ONE_SEQ), "hfperspectives_all"))
def index_one_sequence(spark, sf):
    d = QG.dataset(spark, sf)
    p = d.select("article_index", F.lit(ONE_SEQ).alias("seq"),
                 E.hash_buckets(F.get("sumarries", ONE_SEQ), DIMS).alias("xv"))
    r = X.records(p, index_name="hfperspectives_all", namespace="perspectives",
                  id_col=X.legacy_id("article_index", "seq"), vec_col="xv",
                  metadata=F.struct(F.col("article_index").alias("index"), F.col("seq").alias("sequence")))
    return _index_out(X.upsert(None, r))


@register("index_all_sequences", _index_sql(", ".join(str(i) for i in range(len(P.PERSPECTIVE_TEMPLATES))),
                                            "hfperspectives"))
def index_all_sequences(spark, sf):
    p = _persp_long(spark, sf).withColumn("xv", E.hash_buckets("perspective", DIMS))
    r = X.records(p, index_name="hfperspectives", namespace="perspectives",
                  id_col=X.legacy_id("article_index", "seq"), vec_col="xv",
                  metadata=F.struct(F.col("article_index").alias("index"), F.col("seq").alias("sequence")))
    return _index_out(X.upsert(None, r))


@register("index_by_length", "WITH " + ",\n".join([
    QG.ARTS_CTE, QG.units_cte("au", "arts", "article_index", "content"),
    QG.budget_cte("ps", "au", "article_index", "pos", str(P.DEFAULT_BUDGET))]) + f"""
SELECT 'perspective{P.DEFAULT_BUDGET}' AS index_name, 'perspectives' AS namespace,
       (row_number() OVER (ORDER BY article_index) - 1)::VARCHAR AS id, article_index AS meta_index,
       len({Q.tokens('txt')})::BIGINT AS n_tokens, {Q.buckets_md5('txt', DIMS)} AS vec_md5 FROM ps""")
def index_by_length(spark, sf):
    """One index per perspective length; id = record ordinal, metadata =
    the record's own article index."""
    a = QG.arts(spark, sf)
    n = P.DEFAULT_BUDGET
    p = a.select("article_index", E.hash_buckets(G.extractive_summary("content", n), DIMS).alias("xv"))
    p = tables.index_rows(materialize(p, "by_length"), ["article_index"], "rec_ord")
    r = X.records(p, index_name=f"perspective{n}", namespace="perspectives", id_col=F.col("rec_ord"),
                  vec_col="xv", metadata=F.struct(F.col("article_index").alias("index")))
    idx = X.upsert(None, r)
    return idx.select("index_name", "namespace", "id", F.col("metadata.index").alias("meta_index"),
                      F.size("embedding").cast("long").alias("n_tokens"),
                      _buckets_md5("embedding").alias("vec_md5"))


@register("embed_callable", f"""
SELECT doc_id, length(t)::BIGINT AS n_chars, (length(t) - length(replace(t, ' ', '')))::BIGINT AS n_spaces
FROM (SELECT doc_id, {Q.norm('text')} AS t FROM documents)""")
def embed_callable(spark, sf):
    """A user's embedder over text batches; this one counts characters and
    spaces, so that its vectors can be checked."""
    def make():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]

    d = tables.read_table(spark, sf, "documents").select("doc_id", "text")
    v = F.col("embedding")
    return E.embed_with(d, "text", make).select("doc_id", v[0].cast("long").alias("n_chars"), v[1].cast("long").alias("n_spaces"))
