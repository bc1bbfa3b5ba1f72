"""Near-duplicate vectors: random-hyperplane sign hashing in several tables,
exact cosine of the vectors that share a bucket, connected components.

Bits and tables follow from the largest label: bits so that a bucket holds
about ``BUCKET_ROWS`` vectors spread at random, tables so that a pair at the
threshold is missed with a probability of ``MISS`` at most (closer pairs much
less).  A pair that shares buckets in several tables is counted in the first
of them, which both rows' codes tell, so pairs are never emitted nor made
distinct: each bucket gives one row a vector, with its number of new links
and the bucket's local root.  A bucket with more than ``BLOCK`` rows is dealt
over blocks, and every two blocks meet in a task of their own.

Equal vectors of a label are one class (found by 128 bits of a hash, on narrow
rows) and are hashed and compared once, by the class's first row; a link of two
classes counts as often as the other class has rows, and the rows of a class
are linked with each other.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components, and rows with a null label, link with nothing; vectors
of different lengths link with nothing; repeated rows link like any other; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refract.llm.common import read
from refract.llm.components import connected_components, forest
from refract.session import materialize

THRESHOLD = 0.93
MISS = 0.002
BUCKET_ROWS, BLOCK, MAX_BITS = 8, 512, 30
SEED = 20240229


def plan(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for the largest label's number of rows."""
    same = 1 - math.acos(min(1.0, threshold)) / math.pi          # one bit agrees
    bits = min(MAX_BITS, max(6, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))))
    hit = same ** bits
    return bits, 1 if hit >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - hit))


def _hash(bits: int, tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for b in batches:
            vec = b.column("vec")
            size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False)
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                x = pc.list_flatten(vec.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                with np.errstate(all="ignore"):
                    wide = x.astype(np.float64)
                    norm = np.sqrt((wide * wide).sum(axis=1))
                ok = np.isfinite(wide).all(axis=1) & np.isfinite(norm) & (norm > 0)
                at, x, wide, norm = at[ok], x[ok], wide[ok], norm[ok]
                if not len(at):
                    continue
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, bits * tables))
                codes = ((wide / norm[:, None]) @ planes[d] > 0).reshape(-1, tables, bits) @ weights
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid").take(take), b.column("times").take(take), b.column("label").take(take), pa.array(np.full(len(at), d, np.int32)),
                     pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))],
                    ["rid", "times", "label", "dim", "v", "codes"])
    return run


def links_in(x: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray, cross: bool, threshold: float, times: np.ndarray):
    """(new links of each row, all linked pairs as two index arrays) of one
    bucket, or of two of its blocks when ``cross``; ``times``: how many equal
    vectors each row stands for."""
    norm = np.sqrt((x * x).sum(axis=1))
    like = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    if cross:
        like &= side[:, None] < side[None, :]
        i, j = np.nonzero(like)
    else:
        i, j = np.nonzero(np.triu(like, 1))
    first = (codes[i] == codes[j]).argmax(axis=1) == table if len(i) else np.zeros(0, bool)
    i1, j1 = i[first], j[first]
    n = np.bincount(i1, weights=times[j1], minlength=len(x)) + np.bincount(j1, weights=times[i1], minlength=len(x))
    return n.astype(np.int64), i, j


def _buckets(threshold: float, kind: str):
    key = ["label", "dim", "t", "code", "bi", "bj"]

    def groups(batches):
        """Runs of equal keys; they come sorted and may span batches."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            cols = [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in key]
            new = np.zeros(t.num_rows, bool)
            new[:1] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(new)
            last = int(cut[-1]) if len(cut) else 0
            done = t.slice(0, last)
            if done.num_rows:
                yield done, cut
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield held, np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in groups(batches):
            cut = np.append(cut[cut < t.num_rows], t.num_rows)
            rid = t.column("rid").to_numpy()
            side, table, bi, bj, dim, times = (t.column(c).to_numpy() for c in ("block", "t", "bi", "bj", "dim", "times"))
            v = t.column("v").combine_chunks()
            codes = pc.list_flatten(t.column("codes").combine_chunks()).to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            out = []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if e - s < 2:
                    continue
                x = np.frombuffer(b"".join(v.slice(s, e - s).to_pylist()), kind).reshape(-1, int(dim[s])).astype(np.float64)
                n, i, j = links_in(x, codes[s:e], int(table[s]), side[s:e], bi[s] != bj[s], threshold, times[s:e])
                if len(i):
                    ids = rid[s:e]
                    some = np.unique(np.concatenate([i, j]))
                    if len(i) == len(some) - 1 == 1:
                        root = dict.fromkeys(some.tolist(), int(some[0]))
                    else:
                        root = forest(zip(i.tolist(), j.tolist()))
                    out.extend((int(ids[k]), int(n[k]), int(ids[root[k]])) for k in some.tolist())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["rid", "n", "root"])
    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per input row: ``vec_id`` (the id), ``n_links``, ``component_id``,
    ``kept``; only rows of one label are compared."""
    ids = materialize(df.select(F.col(id_col).alias("vec_id"), F.monotonically_increasing_id().alias("rid"),
                                F.col(vec_col).alias("vec"), F.col(label_col).alias("label")), "vecrows")
    kind = "<f8" if "double" in df.schema[vec_col].dataType.simpleString() else "<f4"
    some = ids.where("label is not null and vec is not null")
    same = [F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit(SEED), "vec", "label").alias("h2")]
    equal = materialize(some.select(*same).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "equal")
    # rows of a class with several: (rid, class's first row); the join can split a class with very many rows
    members = materialize(some.select("rid", *same).join(equal, ["h1", "h2"]).drop("times"), "members")
    first = materialize(members.groupBy("h1", "h2").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("times")), "firsts")
    member = materialize(members.join(first, ["h1", "h2"]).select("rid", "first", "times"), "member")
    some = (some.join(member, "rid", "left").where("first is null or first = rid")
            .select("rid", "label", "vec", F.coalesce("times", F.lit(1).cast("long")).alias("times")))
    sizes = some.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    bits, tables = plan(sizes.agg(F.max("n")).first()[0] or 0, threshold, miss)
    label = df.schema[label_col].dataType.simpleString()
    v = materialize(some.mapInArrow(_hash(bits, tables, kind), f"rid long, times long, label {label}, dim int, v binary, codes array<int>"), "codes")
    bucket = ["label", "dim", "t", "code"]
    rows = v.select("rid", "times", "label", "dim", "v", "codes", F.posexplode("codes").alias("t", "code"))
    large = (v.select("label", "dim", F.posexplode("codes").alias("t", "code")).groupBy(*bucket)
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
             .select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = (rows.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(*bucket, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rid", "times", "v", "codes"))
    # label order within a partition is by hash where it isn't a number
    key = [*bucket, "bi", "bj"]
    rows = rows.withColumn("label", F.xxhash64("label"))
    found = (rows.repartition(*key).sortWithinPartitions(*key)
             .mapInArrow(_buckets(threshold, kind), "rid long, n long, root long"))
    found = materialize(found.groupBy("rid", "root").agg(F.sum("n").alias("n")), "links")
    comp = connected_components(found, "rid", "root").withColumnRenamed("node", "rid")
    n = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    # of each class's first row: links with other classes, root; a vector that can't link has none with its equals either
    of = materialize(v.select("rid", "times").join(n, "rid", "left").join(comp, "rid", "left").select(
        F.col("rid").alias("first"), (F.coalesce("n_links", F.lit(0).cast("long")) + F.col("times") - 1).alias("n_links"),
        F.coalesce("root", "rid").alias("root")), "classes")
    out = (ids.select("vec_id", "rid").join(member.select("rid", "first"), "rid", "left")
           .select("vec_id", "rid", F.coalesce("first", "rid").alias("first")).join(of, "first", "left")
           .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "rid").alias("root")))
    out = materialize(out, "linked")
    # stored, so that the join can split a root with very many rows
    low = materialize(out.groupBy("root").agg(F.min("vec_id").alias("component_id")), "smallest")
    return out.join(low, "root").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
