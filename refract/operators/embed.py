"""Text -> vector (T9, F8) and token-vector pooling.

The offline embedding is a **hashed bag of words**: tokens are lower-cased
letter/digit runs, each hashed to one of ``dims`` buckets by the first 32
bits of its MD5.  A text's vector is kept as the multiset of its bucket ids
(``array<int>``); counting happens inside the nearest-neighbour kernel, so no
shuffle is needed to build vectors.  Integer counts keep cosine scores exact
and bit-reproducible, so top-1 ties resolve identically in any engine.

A remote or model-based embedder plugs in through :func:`embed_with`
(Arrow-batched ``mapInPandas``, model created once per task).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from refract.functions import rows as R
from refract.functions import text as T

DEFAULT_DIMS = 1024
MAX_TOKENS = 512


def token_bucket(tok: Column, dims: int = DEFAULT_DIMS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"),
                  F.lit(dims)).cast("int")


def hash_buckets(text: Column | str, dims: int = DEFAULT_DIMS) -> Column:
    """``array<int>``: one bucket id per token (a sparse count vector)."""
    return F.transform(T.tokens(text), lambda t: token_bucket(t, dims))


def stored_buckets(text: Column | str, dims: int = DEFAULT_DIMS, ordered: bool = False) -> Column:
    """:func:`hash_buckets` in the narrowest integers that hold ``dims`` of them,
    for vectors that are stored and shuffled.  ``ordered``: sorted, so equal
    bags are equal arrays."""
    found = hash_buckets(text, dims)
    return (F.array_sort(found) if ordered else found).cast("array<smallint>" if dims <= 1 << 15 else "array<int>")


def bucket_counts(df: DataFrame, id_cols: Sequence[str], buckets_col: str) -> DataFrame:
    """Long form ``(ids..., bucket, cnt)`` of a bucket multiset column."""
    return (R.explode_rows(df, list(id_cols), F.col(buckets_col), "bucket")
            .groupBy(*id_cols, "bucket").agg(F.count(F.lit(1)).alias("cnt")))


def embed_with(df: DataFrame, text_col: str, make_fn: Callable[[], Callable[[list[str]], list[list[float]]]],
               out_col: str = "embedding") -> DataFrame:
    """Apply a user embedder to text batches (newlines normalised first)."""
    schema = StructType([*df.schema.fields, StructField(out_col, ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for pdf in batches:
            texts = [t.replace("\n", " ") for t in pdf[text_col].fillna("")]
            pdf = pdf.copy()
            pdf[out_col] = fn(texts)
            yield pdf

    return df.mapInPandas(run, schema)


# ------------------------------------------------------------------- A7
def first_k_per_group(df: DataFrame, group_col: str, order_col: str, k: int,
                      salt_buckets: int = 32) -> DataFrame:
    """The ``k`` smallest ``order_col`` rows of every group, skew-safe.

    A hot group is first split by a salt; each (group, salt) part keeps its
    own first ``k`` (window over a bounded part), then the at most
    ``k * salt_buckets`` survivors per group are ranked again.  No task ever
    sorts more than one salted part of a group.  ``order_col`` must be unique
    within a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order_col), F.lit(salt_buckets)))
    w1 = Window.partitionBy(group_col, "_salt").orderBy(order_col)
    part = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(group_col).orderBy(order_col)
    return (part.withColumn("tok_pos", F.row_number().over(w2) - 1)
            .where(F.col("tok_pos") < k).drop("_salt", "_r"))


def mean_pool(token_vectors: DataFrame, group_col: str, order_col: str, vec_col: str,
              max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Unmasked mean of a group's token vectors over its first ``max_tokens``
    tokens (input truncation), one row per (group, dim): partial + final
    hash aggregation, no group is ever collected."""
    toks = first_k_per_group(token_vectors, group_col, order_col, max_tokens)
    return (toks.select(group_col, F.posexplode(vec_col).alias("dim", "v"))
            .groupBy(group_col, "dim").agg(F.avg(F.col("v").cast("double")).alias("value")))


def pooled_vectors(long_means: DataFrame, group_col: str) -> DataFrame:
    """Re-assemble ``(group, dim, value)`` into ``array<double>`` ordered by dim
    (one short array per group; dims are bounded by the model width)."""
    return (long_means.groupBy(group_col)
            .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_p"))
            .select(group_col, F.transform("_p", lambda x: x["value"]).alias("embedding")))
