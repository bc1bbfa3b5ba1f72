"""Exact and approximate nearest-neighbour joins.

Exact k-NN is a **blocked matrix join**.  Within each namespace, queries are
hashed into ``bq`` blocks and index rows into ``bx`` blocks, with block
counts derived from the namespace's row counts so every block holds about
``q_block`` / ``x_block`` rows whatever the skew (a namespace with a third of
all rows just gets more blocks).  Block pair ``(qb, xb)`` is scored with NumPy
matrix products, and no pair is ever materialised as a row.

Without namespaces, or with few of them, **no row is copied for the blocks it
meets**: every block is one row, the index blocks are stored once, and a
cartesian product hands each query block the stored index blocks one after
the other (:func:`_streamed`).  Queries asked in every namespace are one row
each, whatever the number of namespaces.  The worker keeps the running top-k of its
query blocks, so what is written, shuffled and returned grows with the rows,
while reading and scoring grow with the pairs.

With many namespaces each query row is sent to the ``bx`` index blocks of its
namespace and each index row to the ``bq`` query blocks, and block pairs meet
in a ``cogroup``; a final window keeps the top-k of at most ``bx * k``
candidates per query.

Ties are broken by the index key in ascending order, both inside a block
(index rows are sorted by key before scoring) and across blocks.

Approximate k-NN (:func:`lsh_knn`) replaces the namespace by random
hyperplane bands (L tables of b sign bits): candidates are the rows sharing
a band bucket, scored exactly with the same blocked kernel, so hot buckets
are split the same way.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from refract.functions import rows as R
from refract.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows per block (per namespace).  Query rows are scored in chunks of
# SCORE_ROWS so the score matrix stays bounded (SCORE_ROWS x X_BLOCK floats).
# Scoring costs tens of nanoseconds per (query, index row) pair, while the
# copies that send every row to the blocks it meets cost well under a byte
# of shuffle per pair, so blocks are kept small enough that a block pair is
# about a second of work and the pairs spread evenly over the cores.
Q_BLOCK = 4096
X_BLOCK = 8192
SCORE_ROWS = 2048
# Scores of dense vectors held at once (16 MB of doubles): several workers share
# an executor's memory, and a chunk that stays in the cache is scored faster.
SCORE_CELLS = 1 << 21
# Index rows of which only the best score is looked at for a bound of the k-th best.
BOUND_ROWS = 64
# Tasks are CPU-bound, so the pair shuffle gets an explicit partition count
# (this many per core, or spark.sql.shuffle.partitions if larger) that AQE
# does not coalesce by bytes.
PAIR_TASKS_PER_CORE = 16
# Block-count rows (one per namespace, three numbers each) broadcast without
# a look at their bytes when the caller bounds the namespace count by this many.
MAX_BROADCAST_NAMESPACES = 100_000
# Up to this many namespaces, blocks are streamed: every task reads all index
# blocks, also those of namespaces that none of its queries are in.
STREAM_NAMESPACES = 16
# Blocks in one file: the Parquet reader holds a batch of rows at once.
BLOCKS_PER_FILE = 4


# ------------------------------------------------------- scalar functions
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """dot / (sqrt(|a|^2) * sqrt(|b|^2)) over two numeric arrays."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# ------------------------------------------------------------- kernel
def _matrix(col: pd.Series, kind: str, dims: int | None) -> np.ndarray:
    if kind == "buckets":
        lens = col.map(len).to_numpy()
        rows = np.repeat(np.arange(len(col)), lens)
        cols = np.concatenate(col.to_numpy()).astype(np.int64) if lens.sum() else np.zeros(0, np.int64)
        flat = np.bincount(rows * dims + cols, minlength=len(col) * dims)
        # integer counts: float32 products and sums stay exact (< 2**24)
        return flat.reshape(len(col), dims).astype(np.float32)
    return np.vstack(col.to_numpy()).astype(np.float64)


def _triplets(col: pd.Series, dims: int):
    """(row, bucket, count) of a bucket-multiset column, sorted by bucket."""
    lens = col.map(len).to_numpy()
    if lens.sum() == 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.float32)
    rows = np.repeat(np.arange(len(col)), lens)
    cols = np.concatenate(col.to_numpy()).astype(np.int64)
    keys, cnt = np.unique(cols * len(col) + rows, return_counts=True)   # bucket-major
    return keys % len(col), keys // len(col), cnt.astype(np.float32 if cnt.max() < EXACT_F32 else np.float64)


# Integers below this are exact in float32.
EXACT_F32 = 1 << 24

# A bucket is scored densely when the (query, index row) pairs sharing it
# exceed this fraction of all pairs: a dense column costs every pair one
# BLAS multiply-add, a pair of another bucket roughly a thousand times more.
HOT_PAIR_FRACTION = 1e-3
# Cells of the other buckets laid out at once, and the fewest index rows of each
# for which that is done.
COLD_CELLS = 1 << 21
COLD_COLUMNS = 256


def _sparse_dots(q: tuple, x: tuple, nq: int, nx: int, dims: int, dtype=np.float32) -> np.ndarray:
    """Integer dot products of two bucket-count sets, exact when ``dtype``
    holds the largest of them.

    Buckets shared by many pairs (stop words) are scored with one dense
    product over just those columns; the other buckets of each query are
    added as dense rows, or pair by pair where they are too many to lay out.
    """
    qr, qb, qc = q
    xr, xb, xc = x
    S = np.zeros((nq, nx), dtype)
    if len(qb) == 0 or len(xb) == 0:
        return S
    xdf = np.bincount(xb, minlength=dims)
    qdf = np.bincount(qb, minlength=dims)
    hot = np.nonzero(qdf.astype(np.float64) * xdf > HOT_PAIR_FRACTION * nq * nx)[0]
    if len(hot):
        pos = np.full(dims, -1)
        pos[hot] = np.arange(len(hot))
        qh = pos[qb] >= 0
        xh = pos[xb] >= 0
        Qh = np.zeros((nq, len(hot)), dtype)
        Qh[qr[qh], pos[qb[qh]]] = qc[qh]
        XhT = np.zeros((len(hot), nx), dtype)     # built transposed: contiguous for BLAS
        XhT[pos[xb[xh]], xr[xh]] = xc[xh]
        np.matmul(Qh, XhT, out=S)
        qr, qb, qc = qr[~qh], qb[~qh], qc[~qh]
    if len(qb) == 0:
        return S
    # cold buckets: each query adds the rows of its buckets, a range of index rows at a time
    used = np.flatnonzero((np.bincount(qb, minlength=dims) > 0) & (xdf > 0))
    pos = np.full(dims, -1)
    pos[used] = np.arange(len(used))
    width = COLD_CELLS // max(1, len(used))
    if width >= COLD_COLUMNS:
        xk, qk = pos[xb] >= 0, pos[qb] >= 0
        xr, xb, xc = xr[xk], pos[xb[xk]], xc[xk]
        order = np.argsort(qr[qk], kind="stable")
        qr, qb, qc = qr[qk][order], pos[qb[qk]][order], qc[qk][order].astype(dtype, copy=False)
        asked, start = np.unique(qr, return_index=True)
        spans = list(zip(asked.tolist(), start.tolist(), [*start[1:].tolist(), len(qr)]))
        for lo in range(0, nx, width):
            at = (xr >= lo) & (xr < lo + width)
            part = np.zeros((len(used), min(width, nx - lo)), dtype)
            part[xb[at], xr[at] - lo] = xc[at]
            for i, a, b in spans:
                S[i, lo:lo + width] += qc[a:b] @ part.take(qb[a:b], axis=0)
        return S
    # very many of them: expand (query, index row) pairs sharing a bucket, sum them
    xs = np.searchsorted(xb, np.arange(dims + 1))
    start, lens = xs[qb], xs[qb + 1] - xs[qb]
    total = int(lens.sum())
    if total:
        offs = np.repeat(np.cumsum(lens) - lens, lens)
        xpos = np.repeat(start, lens) + (np.arange(total) - offs)
        flat = np.repeat(qr, lens) * nx + xr[xpos]
        vals = np.repeat(qc, lens).astype(dtype, copy=False) * xc[xpos]
        np.add.at(S.reshape(-1), flat, vals)     # unbuffered: repeated cells all add
    return S


def _block_topk(qpdf: pd.DataFrame, xpdf: pd.DataFrame, *, k, q_id, x_id, kind, dims,
                metric, min_score, exclude) -> pd.DataFrame:
    out_cols = list(q_id) + list(x_id) + ["score", "_r"]
    if len(qpdf) == 0 or len(xpdf) == 0:
        return pd.DataFrame({c: [] for c in out_cols})
    xpdf = xpdf.sort_values(list(x_id), kind="stable").reset_index(drop=True)
    X, nx = _index_block(xpdf["_xv"], kind, dims)
    return _score(qpdf, xpdf, X, nx, k=k, q_id=q_id, x_id=x_id, kind=kind, dims=dims, metric=metric,
                  min_score=min_score, exclude=exclude)


def _index_block(vecs: pd.Series, kind: str, dims: int | None) -> tuple:
    """Vectors of an index block in the kernel's form, and their squared norms."""
    if kind == "buckets":
        X = _triplets(vecs, dims)
        return X, np.bincount(X[0], weights=X[2].astype(np.float64) ** 2, minlength=len(vecs))
    X = _matrix(vecs, kind, dims)
    return X, np.einsum("ij,ij->i", X, X, dtype=np.float64)


def _score(qpdf, xpdf, X, nx, *, k, q_id, x_id, kind, dims, metric, min_score, exclude, Q=None) -> pd.DataFrame:
    """``Q``: the matrix of ``qpdf``'s vectors, where it is known."""
    rows = SCORE_ROWS if kind == "buckets" else max(1, min(SCORE_ROWS, SCORE_CELLS // len(xpdf)))
    parts = [_score_chunk(qpdf.iloc[a:a + rows].reset_index(drop=True), xpdf, X, nx, k=k,
                          q_id=q_id, x_id=x_id, kind=kind, dims=dims, metric=metric,
                          min_score=min_score, exclude=exclude, Q=None if Q is None else Q[a:a + rows])
             for a in range(0, len(qpdf), rows)]
    return pd.concat(parts, ignore_index=True)


def _kth_bound(A: np.ndarray, k: int) -> np.ndarray:
    """A score of each row that at least ``k`` of its scores reach: the ``k``-th
    best of the best of runs of columns, so that only those are partitioned."""
    if k == 1:
        return A.max(axis=1)
    n = A.shape[1] // BOUND_ROWS
    if n >= 4 * k:
        A = A[:, :n * BOUND_ROWS].reshape(len(A), n, BOUND_ROWS).max(axis=2)
    return -np.partition(-A, k - 1, axis=1)[:, k - 1]


SCREEN_TOL = 1e-4  # float32 screening margin on the cosine scale


def _score_chunk(qpdf, xpdf, X, nx, *, k, q_id, x_id, kind, dims, metric, min_score, exclude, Q=None):
    if kind == "buckets":
        Qt = _triplets(qpdf["_qv"], dims)
        nq = np.bincount(Qt[0], weights=Qt[2].astype(np.float64) ** 2, minlength=len(qpdf))
        # no dot product, nor any part of one, is above the longest |q| |x|
        top = np.sqrt(nq.max(initial=0.0) * nx.max(initial=0.0))
        dots = _sparse_dots(Qt, X, len(qpdf), len(xpdf), dims, np.float32 if top < EXACT_F32 else np.float64)
        Q = None
    else:
        Q = _matrix(qpdf["_qv"], kind, dims) if Q is None else Q
        dots = Q @ X.T
        nq = np.einsum("ij,ij->i", Q, Q, dtype=np.float64)

    def exact(r, c):
        if metric == "l2":
            return A[r, c] - nq[r]
        d = dots[r, c].astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            v = d / (np.sqrt(nq[r]) * np.sqrt(nx[c]))
        return np.where(np.isfinite(v), v, -np.inf)

    # approximate scores (float32) screen the candidates; the candidates are
    # re-scored exactly in float64 from the untouched dot products below.
    # Cosine screening scores are dot / |x| only: the query norm is one
    # positive factor per row, so it scales that row's tolerance and
    # min_score bound instead of every score.
    if metric == "cosine":
        with np.errstate(divide="ignore"):
            ix = (1.0 / np.sqrt(nx)).astype(np.float32)
        ix[~np.isfinite(ix)] = 0
        A = np.multiply(dots, ix[None, :], dtype=np.float32)   # new array: dots stay exact
        if (nx == 0).any():                # zero vectors have no cosine
            A[:, nx == 0] = -np.inf
        row_scale = np.sqrt(nq)            # screening score * |q|^-1 = cosine
        base_tol = SCREEN_TOL
    else:
        # the query's norm is one term of its whole row and orders nothing
        A = np.multiply(dots, 2.0, out=dots)
        A -= nx[None, :]
        row_scale = np.ones(len(nq))
        base_tol = 1e-6 * (1.0 + 2.0 * (nq.max(initial=0.0) + nx.max(initial=0.0)))
    tol = base_tol * row_scale
    for qc, xc in exclude:
        A[qpdf[qc].to_numpy()[:, None] == xpdf[xc].to_numpy()[None, :]] = -np.inf
    kk = min(k, A.shape[1])
    v = _kth_bound(A, kk)
    # a candidate is finite, within tol of a bound of the row's k-th best (every
    # finite score when the row has fewer than k) and above min_score
    thr = (v - tol).astype(A.dtype)
    thr[~np.isfinite(thr)] = np.finfo(A.dtype).min
    if min_score is not None:
        lo = ((min_score - base_tol) * row_scale).astype(A.dtype)
        thr = np.maximum(thr, np.nextafter(lo, A.dtype.type(np.inf)))
    if metric == "cosine":
        thr[nq == 0] = np.inf              # zero query: no cosine
    # places in one dimension: numpy finds them several times faster than in two
    rows, cols = np.divmod(np.flatnonzero(A >= thr[:, None]), A.shape[1])
    scores = exact(rows, cols)
    ok = np.isfinite(scores)
    if min_score is not None:
        ok &= scores > min_score
    rows, cols, scores = rows[ok], cols[ok], scores[ok]
    order = np.lexsort((cols, -scores, rows))       # best first, ties: lowest key
    rows, cols, scores = rows[order], cols[order], scores[order]
    ranks = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = ranks < kk
    rows, cols, scores, ranks = rows[keep], cols[keep], scores[keep], ranks[keep]
    if metric == "l2":  # exact distance for the kept pairs (no cancellation)
        diff = Q[rows].astype(np.float64) - X[cols]
        scores = -np.einsum("ij,ij->i", diff, diff)
    res = {c: qpdf[c].to_numpy()[rows] for c in q_id}
    res.update({c: xpdf[c].to_numpy()[cols] for c in x_id})
    res["score"] = scores
    res["_r"] = ranks.astype(np.int32)
    return pd.DataFrame(res)


# ------------------------------------------------------- streamed blocks
def _number(key: Sequence[str], blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(*key), blocks if isinstance(blocks, Column) else F.lit(blocks)).cast("int")


def _blocks(df: DataFrame, keys: Sequence[str], cols: Sequence[str], partitions: int) -> DataFrame:
    """One row for each block: its namespace and number (``keys``) and its ``_rows``."""
    return df.repartition(partitions, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("_rows"))


def _of_block(value: pa.ListScalar) -> pa.Table:
    """The rows of a block, in memory of their own."""
    rows = pa.concat_arrays([value.values])
    return pa.Table.from_arrays([rows.field(i) for i in range(rows.type.num_fields)], names=[f.name for f in rows.type])


def _best(found: pa.Table, x_id: Sequence[str], k: int) -> pa.Table:
    """The ``k`` best rows of each query (``_q``), ties by index key, nulls first."""
    keys = [("_q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in x_id]]
    found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_start"))
    q = found["_q"].to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _marks(lists: tuple, rows: pa.Table, vecs: pd.Series) -> np.ndarray:
    """A boolean for each query and list: what ``lists`` marks for these rows."""
    return lists[1](vecs, *[rows[c].to_pandas() for c in lists[2:]])


def _stream_kernel(schema: pa.Schema, *, q_keep, x_id, q_vec, k, kind, dims, metric, min_score, exclude, lists, every) -> Callable:
    """Block pairs, each index block beside the query blocks of the task, to the
    top ``k`` of every query.  With ``lists`` = (index column, function, query
    columns...) a query meets the index rows of those lists alone that the
    function marks: query vectors and columns to booleans, a column for each
    list.  With ``every``, a column's name, a query has a top ``k`` in each
    namespace, which goes to that column."""
    params = dict(k=k, q_id=["_q"], x_id=["_x"], kind=kind, dims=dims, metric=metric, min_score=min_score, exclude=exclude)

    def frame(t: pa.Table, no: str, vec: str, name: str, cols) -> pd.DataFrame:
        return pd.DataFrame({no: np.arange(len(t)), name: t[vec].to_pandas()} | {c: t[c].to_pandas() for c in cols})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best, at = {}, {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                this = batch["_ns"][i].as_py(), batch["_xb"][i].as_py()
                if this != at:
                    xt = _of_block(batch["_xrows"][i])
                    xpdf = frame(xt, "_x", "_xv", "_xv", [c for _, c in exclude])
                    X, nx = _index_block(xpdf["_xv"], kind, dims)
                    parts = [(xpdf, X, nx)]
                    if lists:
                        of = xt[lists[0]].to_numpy()                   # rows are sorted by list
                        cut = np.flatnonzero(np.diff(of, prepend=of[0] - 1, append=of[-1] + 1)).tolist()
                        parts += [(xpdf.iloc[a:b], X[a:b], nx[a:b]) for a, b in zip(cut, cut[1:])]
                        here = of[cut[:-1]].astype(np.int64)
                        # all of them by key alone, for queries that meet each list of the block
                        by_key = pc.sort_indices(xt, sort_keys=[(c, "ascending") for c in x_id], null_placement="at_start").to_numpy()
                        parts[0] = xpdf.iloc[by_key], X[by_key], nx[by_key]
                    xids, at = xt.select(list(x_id)), this
                no = batch["_qns"][i].as_py(), batch["_qb"][i].as_py()
                of_ns = no, this[0] if every else None
                qt = _of_block(batch["_qrows"][i])
                qpdf = frame(qt, "_q", q_vec, "_qv", [c for c, _ in exclude])
                if no not in asked:
                    marks = np.packbits(_marks(lists, qt, qpdf["_qv"]), axis=1) if lists else None
                    asked[no] = qt.select(list(q_keep)), marks
                found, Q = [], None
                if kind != "buckets" and len(qpdf):
                    Q = _matrix(qpdf["_qv"], kind, dims)
                meets = np.ones((len(qpdf), 1), bool)
                if lists:
                    marked = (asked[no][1][:, here >> 3] >> (7 - (here & 7)).astype(np.uint8) & 1).astype(bool)
                    whole = marked.all(axis=1)
                    meets = np.column_stack([whole, marked & ~whole[:, None]])
                for (x, part, norms), q in zip(parts, meets.T):
                    q = np.flatnonzero(q)
                    if len(q):
                        some = len(q) < len(qpdf)
                        found.append(_score(qpdf.iloc[q] if some else qpdf, x, part, norms, **params, Q=Q[q] if some and Q is not None else Q))
                found = [f for f in found if len(f)]
                if found:
                    f = pd.concat(found, ignore_index=True)
                    new = xids.take(pa.array(f["_x"].to_numpy(np.int64)))
                    new = new.append_column("_q", pa.array(f["_q"].to_numpy(np.int64))).append_column("score", pa.array(f["score"].to_numpy(np.float64)))
                    best[of_ns] = _best(pa.concat_tables([best[of_ns], new]) if of_ns in best else new, x_id, k)
        for (no, ns), found in best.items():
            q = found["_q"].to_numpy()
            out = asked[no][0].take(found["_q"])
            if every:
                out = out.add_column(0, every, pa.array([ns] * len(q), schema.field(every).type))
            for c in x_id:
                out = out.append_column(c, found[c])
            out = out.append_column("score", found["score"])
            out = out.append_column("_r", pa.array((np.arange(len(q)) - np.searchsorted(q, q)).astype(np.int32)))
            yield from out.cast(schema).combine_chunks().to_batches()

    return run


def _packed(sizes: dict, block: int) -> tuple[list, int]:
    """Blocks of about ``block`` rows for groups of ``sizes`` rows, each as
    (group, its first block, its blocks), and their number: small groups share
    a block, large ones have several."""
    out, n, held = [], 0, 0
    for which, rows in sorted(sizes.items()):
        if held and held + rows > block:
            n, held = n + 1, 0
        pieces = -(-rows // block)
        out.append((which, n, pieces))
        n, held = (n, held + rows) if pieces == 1 else (n + pieces, 0)
    return out, n + (held > 0)


def _met_namespaces(lists: tuple, q_vec: str, of: int) -> Callable:
    """The namespaces (``of`` lists each) that the queries of a block have lists in."""
    # not for the planner to evaluate again where it looks for nulls
    def met(blocks: pa.Array) -> pa.Array:
        found = []
        for value in blocks:
            rows = _of_block(value)
            some = np.flatnonzero(_marks(lists, rows, rows[q_vec].to_pandas()).any(axis=0))
            found.append(np.unique(some // of).astype(np.int32))
        return pa.array(found, pa.list_(pa.int32()))

    return F.arrow_udf(met, "array<int>").asNondeterministic()


def _streamed(q: DataFrame, x: DataFrame, rows: Sequence, schema: T.StructType, *, q_keep: Sequence[str], x_id: Sequence[str],
              q_vec: str, q_key: Sequence[str], q_block: int, x_block: int, partitions: int, lists=None, every=None,
              home: tuple | None = None, **params) -> DataFrame:
    """Top ``k`` of each task's index blocks for every query, without copies of
    rows: index blocks are stored once, and the tasks of a cartesian product
    read them.  ``rows``: (namespace, queries, index rows), collected.

    A task holds the query blocks of one partition and one index block.  Where
    query blocks are fewer than ``partitions``, the stored blocks are read in
    several slices, each giving up to ``k`` rows a query.

    ``home``: (query column with a list, queries of each such list, lists in a
    namespace).  Queries of a list lie in the same blocks then, and a block of
    them meets the namespaces alone that one of its queries has a list in."""
    share = T.StructType([x.schema["_ns"], T.StructField("_bq", T.IntegerType()), T.StructField("_bx", T.IntegerType())])
    blocks = [(ns, -(-nq // q_block), -(-nx // x_block)) for ns, nq, nx in rows]
    # with lists, or asked in every namespace, all queries are one, which meets those of all index rows
    one = bool(lists or every)
    n_q = max([1, *(b[1] for b in blocks)]) if one else max(1, sum(b[1] for b in blocks))
    at = []
    if home:
        at, n_q = _packed(home[1], q_block)
    n_x = max(1, sum(b[2] for b in blocks))
    counts = F.broadcast(q.sparkSession.createDataFrame(blocks, share))
    cols = [*([lists[0]] if lists else []), *x_id, "_xv"]
    xs = _blocks(x.join(counts, "_ns").withColumn("_xb", _number(x_id, F.col("_bx"))), ["_ns", "_xb"], cols, min(n_x, partitions))
    # sorted by list and key
    xs = materialize(xs.select("_ns", "_xb", F.array_sort("_rows").alias("_xrows")), "knn_index", BLOCKS_PER_FILE)
    if home:
        of_home = T.StructType([q.schema[home[0]], T.StructField("_from", T.IntegerType()), T.StructField("_pieces", T.IntegerType())])
        qs = (q.join(F.broadcast(q.sparkSession.createDataFrame(at, of_home)), home[0])
              .withColumn("_qb", F.col("_from") + _number(q_key, F.col("_pieces"))))
    elif one:
        qs = q.withColumn("_qb", _number(q_key, n_q))
    else:
        qs = q.join(counts, "_ns").withColumn("_qb", _number(q_key, F.col("_bq")))
    tasks = min(n_q, partitions)
    keys, held = (["_qb"] if one else ["_ns", "_qb"]), list(dict.fromkeys([*q_keep, q_vec, *(lists[2:] if lists else [])]))
    qs = _blocks(qs, keys, held, tasks).withColumnsRenamed({"_ns": "_qns", "_rows": "_qrows"})
    if one:
        # a number alone tells their blocks apart: a constant key would cost a second shuffle
        qs = qs.withColumn("_qns", F.lit(0))
    slices = xs.coalesce(max(1, min(n_x, -(-partitions // tasks))))
    meet = F.lit(True) if one else F.col("_ns") == F.col("_qns")
    if home:
        qs = qs.withColumn("_met", _met_namespaces(lists, q_vec, home[2])("_qrows"))
        meet = F.array_contains("_met", F.col("_ns"))
    pairs = slices.join(qs.hint("shuffle_replicate_nl"), meet).drop("_met")
    run = _stream_kernel(to_arrow_schema(schema), q_keep=list(q_keep), x_id=list(x_id), q_vec=q_vec, lists=lists, every=every, **params)
    return pairs.mapInArrow(run, schema)


def _cogrouped(q: DataFrame, x: DataFrame, n_x: DataFrame, schema: T.StructType, bound: int | None, *, q_keep, x_id, q_vec, q_key,
               q_block, x_block, partitions, **params) -> DataFrame:
    """Top ``k`` of each block for every query of many namespaces: rows are
    copied to the block pairs of their namespace, which meet in a cogroup."""
    # Block counts per namespace: one row per namespace.  The query and index
    # rows must never be shuffled by namespace to meet them -- that shuffle
    # would put a namespace holding a third of all rows into one task -- so
    # the counts are broadcast: directly when the namespace count has a known
    # bound (one row each), else written out so the planner knows their size
    # and broadcasts them under Spark's own size threshold (with very many
    # namespaces it stays a shuffle join, where AQE splits a hot namespace).
    counts = (q.groupBy("_ns").agg(F.count(F.lit(1)).alias("_nq")).join(n_x, "_ns")
              .select("_ns", F.ceil(F.col("_nq") / q_block).cast("int").alias("_bq"),
                      F.ceil(F.col("_nx") / x_block).cast("int").alias("_bx")))
    if bound is not None and bound <= MAX_BROADCAST_NAMESPACES:
        # the bound is checked where it is relied on: more rows are an error
        n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
        over = F.raise_error(F.lit(f"more than {bound} namespaces, the bound that the caller gave")).cast("boolean")
        counts = F.broadcast(counts.withColumn("_n", n).where(F.when(F.col("_n") > bound, over).otherwise(True)).drop("_n"))
    else:
        counts = materialize(counts, "knn_blocks")
    qg = (q.join(counts, "_ns")
          .withColumn("_qb", F.pmod(F.xxhash64(*q_key), F.col("_bq")).cast("int"))
          .withColumn("_xb", F.explode(F.sequence(F.lit(0), F.col("_bx") - 1))))
    xg = (x.join(counts, "_ns")
          .withColumn("_xb", F.pmod(F.xxhash64(*x_id), F.col("_bx")).cast("int"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_bq") - 1))))

    def kernel(qpdf: pd.DataFrame, xpdf: pd.DataFrame) -> pd.DataFrame:
        return _block_topk(qpdf.assign(_qv=qpdf[q_vec]), xpdf, q_id=q_keep, x_id=x_id, **params)

    keys = ["_ns", "_qb", "_xb"]
    # both sides hash-partitioned alike on the block keys: the cogroup reuses
    # this exchange, and a by-number repartition is not coalesced by AQE
    return (qg.select(*dict.fromkeys([*q_keep, *keys, q_vec])).repartition(partitions, *keys).groupBy(*keys)
            .cogroup(xg.select(*x_id, *keys, "_xv").repartition(partitions, *keys).groupBy(*keys))
            .applyInPandas(kernel, schema))


# ------------------------------------------------------------ operator
def knn(queries: DataFrame, index: DataFrame, *, k: int, q_id: Sequence[str], x_id: Sequence[str],
        q_vec: str, x_vec: str, kind: str = "dense", dims: int | None = None,
        metric: str = "cosine", ns: str | None = None, min_score: float | None = None,
        exclude: Sequence[tuple[str, str]] = (), q_block: int = Q_BLOCK,
        x_block: int = X_BLOCK, partitions: int | None = None,
        ns_bound: int | None = None, lists: tuple | None = None, home: str | None = None) -> DataFrame:
    """Top-``k`` index rows per query row.

    ``kind``: ``dense`` (numeric arrays) or ``buckets`` (hashed bag of words,
    ``dims`` required).  ``metric``: ``cosine`` (score = similarity) or
    ``l2`` (score = squared distance, ascending).  ``ns``: a column on both
    sides restricting matches to the same namespace; queries without it are
    asked in every namespace of the index, whose number ``ns_bound`` bounds by
    ``STREAM_NAMESPACES`` at most.  ``exclude``: pairs of
    (query column, index column) that must differ (e.g. self matches).
    ``min_score``: cosine scores at or below are not matches.
    ``partitions``: tasks scoring block pairs (default: the larger of
    ``spark.sql.shuffle.partitions`` and ``PAIR_TASKS_PER_CORE`` per core).
    ``ns_bound``: a known upper bound on the number of namespaces (e.g. the
    number of runs); without one the block counts are sized by a small job.

    ``lists``: an index column with a list's number (from 0), a function from
    query vectors to booleans, a column for each list, and further query columns
    that the function takes: a query meets the rows of its marked lists alone
    (no ``ns`` then).  ``home``: a query column with a list near the query, by
    which blocks of queries are made, so that they need not meet all lists.

    Returns ``q_id..., [ns], x_id..., score, rank`` (rank 1 = best).
    Calling it runs small jobs.  With at most ``STREAM_NAMESPACES`` namespaces
    (no ``ns``, or ``ns_bound``) the rows are counted and the index blocks are
    written under the checkpoint folder; else, without a bound, the
    per-namespace block counts are (one row per namespace).  Both inputs are
    read twice then; pass materialised inputs when they are costly.
    """
    q_id, x_id = list(q_id), list(x_id)
    every = ns if ns and ns not in queries.columns else None
    if every and (ns_bound is None or ns_bound > STREAM_NAMESPACES):
        raise ValueError(f"queries asked in every namespace need a bound of {STREAM_NAMESPACES} namespaces at most")
    nsq = F.col(ns) if ns and not every else F.lit(0)
    qv = q_vec if q_vec in q_id else "_qv"
    q = queries.select(*q_id, nsq.alias("_ns"), *([] if qv in q_id else [F.col(q_vec).alias("_qv")]),
                       *dict.fromkeys([*(lists[2:] if lists else ()), *([home] if home else ())]))
    in_list = [lists[0]] if lists else []
    x = index.select(*x_id, *in_list, (F.col(ns) if ns else F.lit(0)).alias("_ns"), F.col(x_vec).alias("_xv"))
    if ns and not every:
        q = q.withColumn(ns, F.col("_ns")) if ns not in q_id else q
    extra_q = [ns] if ns and not every and ns not in q_id else []
    q_keep = q_id + extra_q
    schema = T.StructType(
        [queries.schema[c] if c in queries.columns else index.schema[c] for c in ([every] if every else []) + q_keep]
        + [index.schema[c] for c in x_id]
        + [T.StructField("score", T.DoubleType()), T.StructField("_r", T.IntegerType())])
    params = dict(k=k, x_id=x_id, kind=kind, dims=dims, metric=metric, min_score=min_score, exclude=list(exclude))
    if partitions is None:
        spark = queries.sparkSession
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                         PAIR_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)

    n_x = x.groupBy("_ns").agg(F.count(F.lit(1)).alias("_nx"))
    bound = 1 if not ns else ns_bound
    if bound is not None and bound <= STREAM_NAMESPACES:
        if lists:
            # lists that lie side by side make a group, the namespace of their rows
            sizes = {r[0]: r[1] for r in x.groupBy(lists[0]).count().collect()}                  # a row for each list
            of = max(1, x_block * len(sizes) // max(1, sum(sizes.values())))
            x = x.withColumn("_ns", F.floor(F.col(lists[0]) / of).cast("int"))
            groups, asked = Counter(), q.count()
            for which, n in sizes.items():
                groups[which // of] += n
            rows = [(g, asked, n) for g, n in groups.items()]
            if home:
                home = home, {r[0]: r[1] for r in q.groupBy(home).count().collect()}, of                  # a row for each list
        else:
            if every:
                both = n_x.where(F.col("_ns").isNotNull()).withColumn("_nq", F.lit(q.count()))
            else:
                both = q.groupBy("_ns").agg(F.count(F.lit(1)).alias("_nq")).join(n_x, "_ns")
            rows = [(r["_ns"], r["_nq"], r["_nx"]) for r in both.limit(bound + 1).collect()]
            if len(rows) > bound:
                raise ValueError(f"more than {bound} namespaces, the bound that the caller gave")
        blocks = _streamed(q, x, rows, schema, q_keep=q_keep, q_vec=qv, q_key=q_id, q_block=q_block, x_block=x_block,
                           partitions=partitions, lists=lists, every=every, home=home if lists else None, **params)
        if every:
            # a query's namespaces lie in one partition, so what goes on with them needs no other shuffle
            blocks = blocks.repartition(*q_id)
    else:
        blocks = _cogrouped(q, x, n_x, schema, bound, q_keep=q_keep, q_vec=qv, q_key=q_id, q_block=q_block, x_block=x_block,
                            partitions=partitions, **params)
    part = q_keep if not ns or ns in q_keep else q_keep + [ns]
    if metric == "l2":  # kernel scores are negated distances
        scored = blocks.withColumn("score", -F.col("score"))
        order = [F.col("score").asc()] + [F.col(c).asc() for c in x_id]
    else:
        scored = blocks
        order = [F.col("score").desc()] + [F.col(c).asc() for c in x_id]
    w = Window.partitionBy(*part).orderBy(*order)
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .drop("_r"))


def top_k(found: DataFrame, q_id: Sequence[str], x_id: Sequence[str], k: int) -> DataFrame:
    """The ``k`` best scores of each query, ties by index key, with their rank."""
    w = Window.partitionBy(*q_id).orderBy(F.col("score").desc(), *[F.col(c).asc() for c in x_id])
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ----------------------------------------------------------------- LSH
def hyperplanes(dims: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    """Fixed random hyperplanes (a parameter-sized constant, not data)."""
    return np.random.default_rng(seed).standard_normal((tables * bits, dims))


def lsh_bands(vec: Column | str, planes: np.ndarray, tables: int, bits: int) -> Column:
    """``array<long>``: one bucket id per table (``table << bits | code``)."""
    p = planes

    @F.pandas_udf("array<long>")
    def _bands(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        M = np.vstack(s.to_numpy()).astype(np.float64)
        signs = (M @ p.T >= 0).reshape(len(s), tables, bits)
        codes = (signs * (1 << np.arange(bits))).sum(axis=2)
        ids = (np.arange(tables)[None, :] << bits) | codes
        return pd.Series(list(ids.astype(np.int64)))

    return _bands(F.col(vec) if isinstance(vec, str) else vec)


def lsh_knn(queries: DataFrame, index: DataFrame, *, k: int, q_id: Sequence[str],
            x_id: Sequence[str], q_vec: str, x_vec: str, dims: int, tables: int = 8,
            bits: int = 4, exclude: Sequence[tuple[str, str]] = (), seed: int = 7) -> DataFrame:
    """Approximate cosine top-k: candidates share a hyperplane band bucket."""
    planes = hyperplanes(dims, tables, bits, seed)
    qb = R.explode_rows(queries, [*q_id, q_vec], lsh_bands(q_vec, planes, tables, bits), "_band")
    xb = R.explode_rows(index, [*x_id, x_vec], lsh_bands(x_vec, planes, tables, bits), "_band")
    per_band = knn(qb, xb, k=k, q_id=list(q_id), x_id=list(x_id), q_vec=q_vec, x_vec=x_vec,
                   kind="dense", metric="cosine", ns="_band", exclude=exclude,
                   ns_bound=tables << bits)
    best = per_band.groupBy(*q_id, *x_id).agg(F.max("score").alias("score"))
    return top_k(best, list(q_id), list(x_id), k)
