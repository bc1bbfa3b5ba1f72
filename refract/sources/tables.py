"""Table sources, row identity and row-range scans.

Articles are identified by an explicit ``article_index`` column made once at
load time.  Where the input has a natural key (``documents.doc_id``) that key
is used directly; where identity is a *position* (a concatenation of files,
the row order of a link list) :func:`index_rows` assigns consecutive
positions without ever moving all rows into one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refract.functions import text as T
from refract.session import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Tables whose rows carry long texts: per-row work dominates, so a scan that
# yields fewer partitions than the cluster can run is spread out first.
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin to the default parallelism when the scan is narrower
    (e.g. one large file with one row group).  At scale, scans already have
    more partitions than cores and this is a no-op (no shuffle); filters and
    column pruning still reach the scan below the repartition."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``<sf_dir>/<name>.parquet`` (pushdown/pruning by Catalyst)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def articles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             link_col: str = "source") -> DataFrame:
    """``documents`` -> ``articles(article_index, title, link, content)``.

    Title is the first line of the text, as a scraped page's heading would be.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("article_index"),
        T.first_line(text_col).alias("title"),
        F.col(link_col).alias("link"),
        F.col(text_col).alias("content"),
    )


# ------------------------------------------------------------------- S7
_PART_SHIFT = 33  # monotonically_increasing_id = partition << 33 | row


def index_rows(df: DataFrame, order_cols: Sequence[str | Column],
               out_col: str = "row_index") -> DataFrame:
    """Consecutive 0-based positions in ``order_cols`` order, computed
    distributedly.

    One range-partitioned sort, whose rows are stored once with their sort
    partition and their place in it.  The per-partition counts are taken from
    that same stored table (one row per sort partition, so their size is
    bounded by the partition count, not by the data), turned into offsets and
    broadcast back.  No step puts all rows into one task, and no second range
    exchange can draw other bounds.  ``order_cols`` should form a unique key
    so the positions are reproducible.
    """
    mid = F.monotonically_increasing_id()
    tagged = df.orderBy(*order_cols).withColumn("_mid", mid)
    stored = materialize(tagged.withColumn("_part", F.shiftright("_mid", _PART_SHIFT)), "positions")
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (stored.join(F.broadcast(offsets), "_part")
            .withColumn(out_col, F.col("_off") + F.col("_mid")
                        - F.shiftleft("_part", _PART_SHIFT))
            .drop("_mid", "_part", "_off"))


# ------------------------------------------------------------- S5 / S6
def row_range(df: DataFrame, start: int, end: int, idx_col: str = "article_index") -> DataFrame:
    """Half-open ``[start, end)`` on the explicit index (pushed to the scan)."""
    return df.where((F.col(idx_col) >= start) & (F.col(idx_col) < end))


def first_n(df: DataFrame, n: int, order_col: str = "article_index") -> DataFrame:
    """``min(len(data), n)`` leading records: a top-n, planned as
    TakeOrderedAndProject (each task keeps n rows, the driver merges)."""
    return df.orderBy(order_col).limit(n)


# ------------------------------------------------------------- S3 / U2
def concat_sources(frames: Sequence[DataFrame], order_col: str,
                   out_col: str = "article_index") -> DataFrame:
    """Concatenate several record sets (bag union, missing columns null) and
    number the records by position across the concatenation: file ordinal
    first, then position inside the file (``order_col``)."""
    tagged = [f.withColumn("source_ord", F.lit(i)) for i, f in enumerate(frames)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    return index_rows(union, ["source_ord", order_col], out_col)
