"""Vector index as a table.

An index is a DataFrame ``(index_name, namespace, id, embedding, metadata,
batch_ord)``; metadata is a struct because its field types differ.

* :func:`upsert` -- insert or replace by ``(index_name, namespace, id)``: the
  later call wins.  One sort aggregation with ``max_by`` (partial
  aggregation map-side); a key has at most one row per batch, so groups are
  tiny whatever the data.
* :func:`append` -- the flat-L2 behaviour: duplicates are kept, new rows get
  consecutive positions after the existing ones.
* :func:`open_or_create` -- the newest stored version, or an empty index;
  :func:`write_version` -- persist the next version beside it, never
  overwriting the path being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refract.functions import text as TX
from refract.sources import tables

KEY = ["index_name", "namespace", "id"]


def records(df: DataFrame, *, index_name: str, namespace: str, id_col: Column,
            vec_col: str, metadata: Column, batch_ord: int = 0) -> DataFrame:
    """Build index records ``{id, values, metadata}``."""
    return df.select(F.lit(index_name).alias("index_name"), F.lit(namespace).alias("namespace"),
                     id_col.cast("string").alias("id"), F.col(vec_col).alias("embedding"),
                     metadata.alias("metadata"), F.lit(batch_ord).alias("batch_ord"))


def legacy_id(index: str, seq: str | None = None) -> Column:
    """``str(index) + str(seq)`` ids."""
    return TX.legacy_vector_id(index, seq)


def user_metadata(user_id: Column, user_name: Column, is_published: Column) -> Column:
    """Metadata of a user's record (P7, T14); the id is kept as text."""
    return F.struct(user_id.cast("string").alias("user_id"), user_name.alias("user_name"),
                    is_published.alias("is_published"))


def stored_versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the finished versions under ``base``, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names
                  if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(f"{base}/{n}/_SUCCESS")))


def open_or_create(spark: SparkSession, base: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """(index, version): the newest finished version under ``base``, or, where
    there is none, an empty index of this schema with version 0 (K6)."""
    found = stored_versions(spark, base)
    if not found:
        return spark.createDataFrame([], schema), 0
    return spark.read.schema(schema).parquet(version_path(base, found[-1])), found[-1]


def dim_ok(vec_col: str, dims: int) -> Column:
    return F.size(vec_col) == dims


def dim_check(df: DataFrame, vec_col: str, dims: int) -> DataFrame:
    """Keep only vectors of the index dimension (the create-time contract)."""
    return df.where(dim_ok(vec_col, dims))


def upsert(existing: DataFrame | None, batch: DataFrame, order_col: str | None = None) -> DataFrame:
    """Insert-or-replace by (index_name, namespace, id).  A row of this call
    always replaces a stored one, whatever ``batch_ord`` either has.  Inside
    the batch the highest ``batch_ord`` wins, then the highest ``order_col``
    (dropped afterwards); without one, the last row as the batch was read."""
    row = F.col(order_col) if order_col else F.monotonically_increasing_id()
    b = batch.withColumn("_row", row).withColumn("_new", F.lit(True))
    if order_col:
        b = b.drop(order_col)
    allr = b if existing is None else b.unionByName(
        existing.withColumn("_row", F.lit(None).cast(b.schema["_row"].dataType)).withColumn("_new", F.lit(False)))
    payload = [c for c in allr.columns if c not in KEY and c not in ("_row", "_new")]
    latest = (allr.groupBy(*KEY)
              .agg(F.max_by(F.struct(*payload), F.struct("_new", "batch_ord", "_row")).alias("_v")))
    return latest.select(*KEY, *[F.col(f"_v.{c}").alias(c) for c in payload])


def append(existing: DataFrame | None, batch: DataFrame, order_cols: list[str]) -> DataFrame:
    """Flat index append: duplicates kept, ``pos`` continues after the
    existing maximum (positions assigned distributedly)."""
    start = 0
    if existing is not None:
        m = existing.agg(F.max("pos")).first()[0]  # one scalar
        start = 0 if m is None else m + 1
    new = tables.index_rows(batch, order_cols, "pos").withColumn("pos", F.col("pos") + F.lit(start))
    return new if existing is None else existing.unionByName(new)


def version_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v{version:06d}"


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write index version ``version`` under ``base``; returns its path."""
    path = version_path(base, version)
    df.write.mode("errorifexists").partitionBy("index_name", "namespace").parquet(path)
    return path
