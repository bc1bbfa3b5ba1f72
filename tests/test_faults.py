"""Faults found by review, each with the case that showed it."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refract.operators import index as X
from refract.session import scratch_path
from refract.sources import files, tables


@pytest.mark.parametrize("n,parts,width", [(300_000, 16, 96), (400_000, 64, 0)])
def test_positions_lose_nothing(spark, n, parts, width):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), F.lit(width) if width else (F.col("id") % 200).cast("int")).alias("v"))
        out = tables.index_rows(df, ["k"], "pos").select("pos", "k")
        got = out.agg(F.count(F.lit(1)), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
        assert tuple(got) == (n, n, 0, n - 1)
        a, b = out.alias("a"), out.alias("b")
        assert a.join(b, F.col("a.pos") + 1 == F.col("b.pos")).where("a.k > b.k").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_csv_keeps_text(spark):
    texts = ["  lead", "trail \n", "", None, 'quo"te', "back\\slash", "a\r\nb", "\ttab\t", "plain", " ", ","]
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.StringType()), T.StructField("l", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(i, t, [t, "x "]) for i, t in enumerate(texts)], schema)
    path = scratch_path(spark, "csv")
    files.write_csv(df, path)
    got = {r.i: (r.t, r.l) for r in files.read_csv(spark, path, schema).collect()}
    assert got == {i: (t, [t, "x "]) for i, t in enumerate(texts)}


def test_a_later_upsert_wins(spark):
    rec = lambda v, o, b: X.records(spark.createDataFrame([(1, v, o)], "i long, v string, o int"), index_name="n", namespace="s",
                                    id_col=F.col("i"), vec_col="v", metadata=F.struct(F.col("i").alias("index")), batch_ord=b)
    out = X.upsert(X.upsert(None, rec("old", 0, 1)), rec("new", 0, 0)).collect()
    assert [(r.embedding, r.batch_ord) for r in out] == [("new", 0)]
    both = rec("a", 2, 0).withColumn("o", F.lit(2)).unionByName(rec("b", 1, 0).withColumn("o", F.lit(1)))
    assert [r.embedding for r in X.upsert(None, both, "o").collect()] == ["a"]
