from pyspark.sql import functions as F

from refract.operators import index as X
from refract.session import scratch_path
from refract.streaming import index_stream as S


def test_stream_upsert_matches_batch_upsert(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    b0 = X.records(e, index_name="emb", namespace="all", id_col=F.col("vec_id"), vec_col="embedding",
                   metadata=F.struct(F.col("label").alias("label")), batch_ord=0)
    b1 = X.records(e.where("label < 5").withColumn("embedding", F.reverse("embedding")),
                   index_name="emb", namespace="all", id_col=F.col("vec_id"), vec_col="embedding",
                   metadata=F.struct(F.col("label").alias("label")), batch_ord=1)
    src = scratch_path(spark, "stream-src")
    b0.coalesce(1).write.parquet(src + "/b0")
    b1.coalesce(1).write.parquet(src + "/b1")
    stream = (spark.readStream.schema(b0.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    base = scratch_path(spark, "stream-index")
    q = S.start_index_upsert(stream, base, scratch_path(spark, "stream-ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(S.latest_version(base, q))
    want = X.upsert(X.upsert(None, b0), b1)
    def key(df):
        return sorted((r.id, r.batch_ord, round(float(r.embedding[0]), 6)) for r in df.collect())
    assert key(out.select("id", "batch_ord", "embedding")) == key(want.select("id", "batch_ord", "embedding"))


def test_empty_version_reads_as_no_rows(spark):
    """An empty micro-batch writes an empty version; the next epoch reads it
    back as an empty index (no schema inference on an empty folder)."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    b = X.records(e, index_name="emb", namespace="all", id_col=F.col("vec_id"), vec_col="embedding",
                  metadata=F.struct(F.col("label").alias("label")), batch_ord=0)
    base = scratch_path(spark, "stream-empty")
    S.upsert_batch(b.limit(0), 0, base)
    S.upsert_batch(b, 1, base)
    out = spark.read.parquet(S.version_path(base, 2))
    assert out.count() == b.count()


def test_missing_previous_version_fails_the_epoch(spark):
    """A version that cannot be read fails the epoch (to be replayed); the
    index is never rebuilt from the micro-batch alone."""
    import pytest
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    b = X.records(e, index_name="emb", namespace="all", id_col=F.col("vec_id"), vec_col="embedding",
                  metadata=F.struct(F.col("label").alias("label")), batch_ord=3)
    base = scratch_path(spark, "stream-missing")
    with pytest.raises(Exception):
        S.upsert_batch(b, 3, base)
