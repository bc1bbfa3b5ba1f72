"""Helpers shared by the operators: row keys, stored intermediates, slices of
Arrow batches, worker-lifetime caches."""

from __future__ import annotations

import ctypes
import functools
import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refract.session import materialize

#: Text bytes that one step inside a task works on at once (a longer text is
#: a slice of its own).
SLICE_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """``base``, with underscores until no column of ``df`` has that name."""
    names = {c.lower() for c in df.columns}
    while base.lower() in names:
        base += "_"
    return base


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` stored once with a unique row number (its column's name is
    returned).  The number is computed when the rows are written, so a task
    that is run again later reads the same one."""
    key = fresh(df, "_rid")
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), name), key


def content_keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``df`` with a key of 128 bits made of id and text, for decisions that are
    the same for rows that repeat both: nothing needs to be stored for it."""
    key = fresh(df, "_key")
    said = F.concat(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string"), F.lit("\0")), F.lit("\0")) for c in (id_col, text_col)])
    return df.withColumn(key, F.unhex(F.md5(said.cast("binary")))), key


def keep_rows(rows: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows of a :func:`content_keyed` frame whose key is in ``kept[key]``,
    one of each."""
    n = fresh(rows, "_n")
    out = rows.join(kept.select(key), key, "left_semi")
    return out.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(n) == 1).drop(key, n)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4.  A null
    id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def text_slices(batches: Iterable[pa.RecordBatch], text: str,
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``max_bytes`` of text each;
    one longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def releasing(run):
    """``run`` over batches, after which the worker gives back the memory that
    its allocators hold for reuse: workers outlive their tasks, and several of
    them share an executor's memory."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # where the C library has it
            if trim is not None:
                trim(0)
    return wrapped


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker.  The operators'
    code is shipped by value, so module globals last for one task only."""
    mod = sys.modules.get("_refract_worker")
    if mod is None:
        mod = sys.modules["_refract_worker"] = types.ModuleType("_refract_worker")
        mod.caches = {}
    return mod.caches.setdefault(name, {})
