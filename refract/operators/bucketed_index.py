"""A stored vector index that an upsert touches only where it changes.

Rows lie in buckets of their key's hash.  An upsert writes its own rows as one
more commit and a new manifest, and reads nothing of the index but the last
manifest; no stored row is rewritten.  Reading merges: in a bucket with later
commits the base rows whose key came again give way to the last row of that
key.  The keys that came again are found on narrow rows, so base vectors are
only shuffled where those keys are too many to be broadcast by their measured
size.  :func:`compact` rewrites the buckets in which later commits have grown,
and no others.

    base/data/commit=N/bucket=B/*.parquet    rows, with their order in the commit
    base/manifest/version=V/*.parquet        (commit, bucket, base, n), one file

A version is its manifest, which is written last, as one file: a commit
without one is never read, and is overwritten when it is tried again.  One
writer at a time; any number of readers, of any version.  A manifest has a row
for each bucket and commit since its last compaction; that, and no row of the
index, is what the driver sees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refract.operators.index import KEY
from refract.session import materialize

BUCKETS = 64
#: Rows of later commits, as a share of a bucket's base rows, from which it is compacted.
COMPACT_SHARE = 0.25
MANIFEST = "commit int, bucket int, base boolean, n long"
ORDER = ["commit", "batch_ord", "_row"]


@dataclass(frozen=True)
class Index:
    """A version of the index under ``base``; 0 is the empty one."""

    spark: SparkSession
    base: str
    schema: T.StructType
    version: int
    buckets: int

    @property
    def manifest(self) -> list:
        if not self.version:
            return []
        return self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/version={self.version}").collect()


def versions(spark: SparkSession, base: str) -> list[int]:
    """Finished versions under ``base``, ascending."""
    try:
        found = spark.read.schema(MANIFEST + ", version int").parquet(f"{base}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r.version for r in found.select("version").distinct().collect())


def open_index(spark: SparkSession, base: str, schema: T.StructType, version: int | None = None, buckets: int = BUCKETS) -> Index:
    """The newest version, or the one named; the empty index of this schema
    where there is none (K6).  ``buckets`` is fixed by the first commit."""
    base = base.rstrip("/")
    if version is None:
        version = max(versions(spark, base), default=0)
    return Index(spark, base, schema, version, buckets)


def _bucket(n: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int").alias("bucket")


def _stored(ix: Index, parts: list[tuple[int, int]]) -> DataFrame:
    """The rows of these (commit, bucket) folders, with both numbers."""
    schema = T.StructType([*ix.schema.fields, T.StructField("_row", T.LongType()),
                           T.StructField("commit", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    if not parts:
        return ix.spark.createDataFrame([], schema)
    return (ix.spark.read.schema(schema).option("basePath", f"{ix.base}/data")
            .parquet(*[f"{ix.base}/data/commit={c}/bucket={b}" for c, b in sorted(parts)]))


def _last(rows: DataFrame) -> DataFrame:
    """The last row of each key: chosen on narrow rows, fetched by a semi join."""
    best = (rows.groupBy(*KEY).agg(F.max(F.struct(*ORDER)).alias("_w"))
            .select(*KEY, *[F.col(f"_w.{c}").alias(c) for c in ORDER]))
    same = F.lit(True)
    for c in [*KEY, *ORDER]:
        same &= rows[c].eqNullSafe(best[c])
    return rows.join(best, same, "left_semi")


def _merged(ix: Index, manifest: list, buckets: set[int] | None = None) -> DataFrame:
    """One row a key of these buckets (all if none)."""
    parts: dict[int, list] = {}
    for r in manifest:
        if buckets is None or r.bucket in buckets:
            parts.setdefault(r.bucket, []).append(r)
    base = _stored(ix, [(r.commit, r.bucket) for rs in parts.values() for r in rs if r.base])
    later = [(r.commit, r.bucket) for rs in parts.values() for r in rs if not r.base]
    if not later:
        return base
    clean = [b for b, rs in parts.items() if all(r.base for r in rs)]
    later = _stored(ix, later)
    again = later.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(KEY)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(KEY):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    dirty = base.where(~F.col("bucket").isin(clean)).join(again, same, "left_anti")
    return base.where(F.col("bucket").isin(clean)).unionByName(dirty).unionByName(_last(later))


def read(ix: Index) -> DataFrame:
    """One row for each (index_name, namespace, id): the last one upserted."""
    return _merged(ix, ix.manifest).select(*ix.schema.names)


def _commit(ix: Index, rows: DataFrame, base: bool, version: int) -> list[tuple[int, int, bool, int]]:
    """Write rows as commit ``version``; their manifest rows."""
    path = f"{ix.base}/data/commit={version}"
    # rebalanced, so that a bucket with very many rows takes several tasks and files
    (rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path))
    stored = ix.spark.read.schema("bucket int").parquet(path)
    return [(version, r["bucket"], base, r["count"]) for r in stored.groupBy("bucket").count().collect()]


def _finish(ix: Index, manifest: list, version: int) -> Index:
    (ix.spark.createDataFrame([tuple(r) for r in manifest], MANIFEST).coalesce(1)
     .write.mode("overwrite").parquet(f"{ix.base}/manifest/version={version}"))
    return Index(ix.spark, ix.base, ix.schema, version, ix.buckets)


def upsert(ix: Index, batch: DataFrame, order_col: str | None = None, version: int | None = None) -> Index:
    """Insert or replace by key.  A row of this batch always replaces a stored
    one; inside the batch the highest ``batch_ord`` wins, then the highest
    ``order_col`` (a whole number, not stored); without one, the last row as
    the batch was read.  ``version``: the number of the new version, for a
    batch that may be tried again."""
    version = version or ix.version + 1
    row = F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()
    rows = batch.select(*[F.col(c).cast(ix.schema[c].dataType).alias(c) for c in ix.schema.names], row.alias("_row"), _bucket(ix.buckets))
    if ix.version:
        return _finish(ix, [*ix.manifest, *_commit(ix, rows, False, version)], version)
    # the first commit is a base: its keys are unique; the rows are stored as
    # they came before the last ones are chosen, so that their order is fixed
    came = materialize(rows.withColumn("commit", F.lit(version)), "first_commit")
    return _finish(ix, _commit(ix, _last(came).drop("commit"), True, version), version)


def compact(ix: Index, share: float = COMPACT_SHARE) -> Index:
    """A version in which buckets with many later rows are one base again; the
    same version where there is none."""
    manifest = ix.manifest
    base, later = {}, {}
    for r in manifest:
        held = base if r.base else later
        held[r.bucket] = held.get(r.bucket, 0) + r.n
    due = {b for b, n in later.items() if n > share * base.get(b, 0)}
    if not due:
        return ix
    rows = _merged(ix, manifest, due).drop("commit")
    new = _commit(ix, rows, True, ix.version + 1)
    return _finish(ix, [r for r in manifest if r.bucket not in due] + new, ix.version + 1)
