"""Exact dedup with a heavy-hitter split.

Digests (sha-256 of the text with A-Z lower-cased) are stored once.  A
Misra-Gries pass finds the digests that may hold more than ``1 / heavy`` of
all rows: at most ``2 * heavy`` of them whatever the data.  Their exact counts
and winners (partial aggregation, so no task meets all copies) are broadcast
and settle those rows where they are read; all other digests, whose groups
are smaller than ``rows / heavy``, take the ordinary shuffle.

Defined results: a null text counts as empty; null ids belong to their group
but stay only where the whole group has none; of rows that repeat the largest
id one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refract.llm import common as C
from refract.session import materialize

#: Digests with more than one ``HEAVY``-th of the rows are settled by broadcast.
HEAVY = 256


def merge_counts(held: dict, new: dict, size: int) -> dict:
    """One Misra-Gries step for a batch of counts: add, then take the
    (size+1)-th largest counter off all and drop what is not above zero."""
    for k, n in new.items():
        held[k] = held.get(k, 0) + n
    if len(held) > size:
        cut = sorted(held.values(), reverse=True)[size]
        held = {k: n - cut for k, n in held.items() if n > cut}
    return held


def _misra_gries(heavy: int):
    size = 4 * heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        rows = 0
        for b in batches:
            rows += b.num_rows
            vc = pc.value_counts(b.column(0))
            held = merge_counts(held, dict(zip(vc.field(0).to_pylist(), vc.field(1).to_pylist())), size)
        # what stays out here and what the counters lost is at most
        # rows / (2 * heavy) for one digest, summed over all partitions
        out = [(k, n) for k, n in held.items() if n * size > rows] + [(None, rows)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()),
                                          pa.array([n for _, n in out], pa.int64())], ["digest", "n"])
    return run


def heavy_digests(digests: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """A superset, of at most ``2 * heavy`` rows, of the digests that more
    than one ``heavy``-th of all rows hold.  Column ``digest``, not null."""
    found = materialize(digests.select("digest").mapInArrow(_misra_gries(heavy), "digest binary, n long")
                        .groupBy("digest").agg(F.sum("n").alias("n")), "heavy")
    rows = found.where("digest is null").agg(F.sum("n")).first()[0] or 0
    return found.where(F.col("digest").isNotNull() & (F.col("n") * (2 * heavy) > rows)).select("digest")


def _winners(d: DataFrame) -> DataFrame:
    order = F.struct(F.col("id").isNotNull().alias("a"), "id", "rid")
    return (d.groupBy("digest").agg(F.max(order).alias("w"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("w.id").alias("keep_id"), F.col("w.rid").alias("keep_rid"), "group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 key: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: ``id``, ``rid`` (``key``, or a number made here),
    ``digest``, ``keep_id``, ``keep_rid``, ``group_size``, ``kept``."""
    rid = F.col(key) if key else F.monotonically_increasing_id()
    digest = F.unhex(F.sha2(C.ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
    d = materialize(docs.select(F.col(id_col).alias("id"), rid.alias("rid"), digest.alias("digest")), "digests")
    hot = F.broadcast(heavy_digests(d, heavy))                       # at most 2 * heavy rows
    verified = materialize(_winners(d.join(hot, "digest", "left_semi")), "winners")
    settled = d.join(F.broadcast(verified), "digest")                # where they are read
    rest = d.join(F.broadcast(verified.select("digest")), "digest", "left_anti")
    rest = rest.join(_winners(rest), "digest")
    return settled.unionByName(rest).withColumn("kept", F.col("rid") == F.col("keep_rid"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    rows, key = C.content_keyed(docs, id_col, text_col)
    return C.keep_rows(rows, key, exact_groups(rows, id_col, text_col, key)
                       .where("kept").select(F.col("rid").alias(key)))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s)"""


def query(spark, sf_dir: str) -> DataFrame:
    g = exact_groups(C.read(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                    F.lower(F.hex("digest")).alias("text_sha256"))
