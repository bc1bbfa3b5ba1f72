from pyspark.sql import functions as F

from refract.sources import files, tables
from refract.session import scratch_path


def test_index_rows_consecutive(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 3).alias("k")).repartition(9)
    out = tables.index_rows(df, ["k"], "pos").orderBy("k").collect()
    assert [r.pos for r in out] == list(range(len(out)))


def test_concat_sources_positions(spark):
    a = spark.createDataFrame([(2, "x"), (1, "y")], "key long, text string")
    b = spark.createDataFrame([(0, "z")], "key long, text string")
    out = sorted((r.article_index, r.source_ord, r.key) for r in tables.concat_sources([a, b], "key").collect())
    assert out == [(0, 0, 1), (1, 0, 2), (2, 1, 0)]


def test_csv_roundtrip_keeps_arrays_and_nulls(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.StringType()),
                           T.StructField("a", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(1, 'he said "hi"\nbye', ["x", "y,z"]), (2, None, [])], schema)
    p = scratch_path(spark, "t")
    files.write_csv(df, p)
    back = sorted(files.read_csv(spark, p, schema).collect())
    assert back == sorted(df.collect())
