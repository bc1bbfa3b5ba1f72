"""Approximate cosine neighbours by inverted lists, with a wanted recall.

A coarse quantiser (``lists`` unit centroids) is trained by Lloyd rounds: each
round is one Spark pass that sums the sample's vectors by their nearest
centroid, partially in each task.  Every index row is stored with its list.  A
question looks into its ``probes`` nearest lists.  Lists side by side make the
index blocks of :mod:`refract.operators.knn`, which are stored once and read
beside each block of questions; a hot list is cut into blocks, and scores are
exact.

How many lists to probe follows from a measured curve: for a sample of
questions the exact neighbours are found, and with them the place of each
neighbour's list in its question's order of lists.  The least number of lists
that holds the wanted share of neighbours (with a margin for the sample's
size) is taken.  Where vectors have no clusters that number is large, up to all
lists, which is the exact search: recall is kept, and the share of pairs that
are scored (:func:`scored_share`) tells what it costs.

Exact Euclidean search (J6) uses the same lists as balls: a centre and a
radius bound how near any row of a ball can be, so whole balls are skipped
(:func:`l2_search`).

What reaches the driver is bounded by parameters: the centroids (``lists``
vectors) and one count for each list.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refract.functions import rows as R
from refract.operators import knn as K
from refract.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_LISTS = 4096
#: Rows for each list that the centroids are trained on, Lloyd rounds at most,
#: and questions whose exact neighbours give the curve.
ROWS_PER_LIST, ROUNDS, TUNE_QUESTIONS = 256, 12, 512
RECALL = 0.95
_BITS = 1 << 30
#: Distances of questions to centres held at once (16 MB of doubles).
DISTANCE_CELLS = 1 << 21


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def _matrix(s: pd.Series, unit: bool = True) -> np.ndarray:
    m = np.vstack(s.to_numpy()).astype(np.float64)
    return _unit(m) if unit else m


def distances(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to centroids, of small differences too."""
    d = np.empty((len(m), len(c)))
    for j, x in enumerate(c):
        d[:, j] = np.sqrt(((m - x) ** 2).sum(axis=1))
    return d


def _share(df: DataFrame, by: Sequence[str], rows: int, of: int, salt: int) -> DataFrame:
    """About ``rows`` of the ``of`` rows of ``df``, by a hash of their key."""
    if of <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(_BITS)) < int(rows / of * _BITS))


def train_centroids(vectors: DataFrame, vec: str, by: Sequence[str], lists: int, rows: int, rounds: int = ROUNDS,
                    unit: bool = True) -> np.ndarray:
    """Centroids of ``vectors`` (``rows`` of them) after Lloyd rounds that begin
    with the rows of least hash: unit ones nearest by cosine, or means nearest
    by Euclidean distance."""
    sample = materialize(_share(vectors.where(F.col(vec).isNotNull()).select(*by, vec), by, lists * ROWS_PER_LIST, rows, 1), "ivf_sample")
    first = sample.orderBy(F.xxhash64(*by, F.lit(2)), *by).limit(lists).select(vec).toPandas()
    if not len(first):
        return np.zeros((0, 0))
    c = _matrix(first[vec], unit)
    width = c.shape[1]
    for _ in range(rounds):
        def sums(frames: Iterator[pd.DataFrame], c=c) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(c), width + 1))
            for f in frames:
                m = _matrix(f[vec], unit)
                near = (m @ c.T).argmax(axis=1) if unit else distances(m, c).argmin(axis=1)
                np.add.at(total, near, np.column_stack([m, np.ones(len(m))]))
            some = np.flatnonzero(total[:, -1])
            yield pd.DataFrame({"list": some.astype(np.int32), "s": list(total[some])})
        parts = sample.select(vec).mapInPandas(sums, "list int, s array<double>")
        zero = F.array_repeat(F.lit(0.0), width + 1)
        found = parts.groupBy("list").agg(F.aggregate(F.collect_list("s"), zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("s")).toPandas()
        new = c.copy()                                       # a list without rows keeps its centroid
        sums_ = np.vstack(found["s"].to_numpy())
        new[found["list"].to_numpy()] = _unit(sums_[:, :-1]) if unit else sums_[:, :-1] / sums_[:, -1:]
        moved = float(np.abs(new - c).max())
        c = new
        if moved < 1e-9:
            break
    return c


def nearest_lists(vec: Column | str, centroids: np.ndarray, probes: int) -> Column:
    """``array<int>``: the ``probes`` lists nearest to a vector, nearest first
    (of equal ones the lower number); empty for a null."""
    c = centroids

    @F.pandas_udf("array<int>")
    def _nearest(s: pd.Series) -> pd.Series:
        out: list = [[]] * len(s)
        some = np.flatnonzero(s.notna().to_numpy())
        if len(some):
            order = np.argsort(-(_matrix(s.iloc[some]) @ c.T), axis=1, kind="stable")[:, :probes]
            for i, lists in zip(some.tolist(), order.tolist()):
                out[i] = lists
        return pd.Series(out)

    return _nearest(F.col(vec) if isinstance(vec, str) else vec)


@dataclass(frozen=True)
class Lists:
    """An index: rows with their list (``_list``), the centroids, the number of
    rows, and how many lists a question probes."""

    rows: DataFrame
    x_id: tuple[str, ...]
    x_vec: str
    centroids: np.ndarray
    n: int
    probes: int


def build(index: DataFrame, x_id: Sequence[str], x_vec: str, lists: int | None = None, rounds: int = ROUNDS) -> Lists:
    """Every row of ``index`` in its list; rows without a vector are in none.
    ``lists``: the square root of the number of rows if none, at most
    ``MAX_LISTS``.  Probes all lists until :func:`tune` has measured."""
    index = materialize(index.where(F.col(x_vec).isNotNull()).select(*x_id, x_vec), "ivf_rows")
    n = index.count()
    lists = max(1, min(lists or math.isqrt(n), MAX_LISTS, n or 1))
    c = train_centroids(index, x_vec, list(x_id), lists, n, rounds)
    if not len(c):
        return Lists(index.withColumn("_list", F.lit(0)), tuple(x_id), x_vec, c, 0, 1)
    rows = index.withColumn("_list", nearest_lists(x_vec, c, 1)[0])
    return Lists(materialize(rows, "ivf_lists"), tuple(x_id), x_vec, c, n, len(c))


def curve(ix: Lists, questions: DataFrame, q_id: Sequence[str], q_vec: str, k: int = 1,
          exclude: Sequence[tuple[str, str]] = (), sample: int = TUNE_QUESTIONS) -> np.ndarray:
    """Share of the exact ``k`` neighbours that the nearest 1, 2, ... lists
    hold, over a sample of questions; and their number, last."""
    q = questions.where(F.col(q_vec).isNotNull())
    q = materialize(_share(q, q_id, sample, q.count(), 3).select(*q_id, q_vec), "ivf_questions")
    true = K.knn(q, ix.rows, k=k, q_id=q_id, x_id=ix.x_id, q_vec=q_vec, x_vec=ix.x_vec, exclude=exclude)
    of = ix.rows.select(*ix.x_id, "_list")
    order = q.select(*q_id, nearest_lists(q_vec, ix.centroids, len(ix.centroids)).alias("_order"))
    place = (true.join(of, list(ix.x_id)).join(order, list(q_id))
             .groupBy(F.array_position("_order", F.col("_list")).alias("p")).count().collect())        # a row for each list
    hit = np.zeros(len(ix.centroids) + 1)
    for r in place:
        hit[r["p"]] += r["count"]
    return np.append(np.cumsum(hit)[1:] / max(1.0, hit.sum()), hit.sum())


def tune(ix: Lists, questions: DataFrame, q_id: Sequence[str], q_vec: str, recall: float = RECALL, k: int = 1,
         exclude: Sequence[tuple[str, str]] = (), sample: int = TUNE_QUESTIONS) -> Lists:
    """``ix`` with the least number of probed lists whose measured share, less
    two standard errors of the sample, reaches ``recall``."""
    if not ix.n:
        return ix
    *share, n = curve(ix, questions, q_id, q_vec, k, exclude, sample).tolist()
    enough = [p for p, s in enumerate(share, 1) if n and s - 2 * math.sqrt(s * (1 - s) / n) >= recall]
    return Lists(ix.rows, ix.x_id, ix.x_vec, ix.centroids, ix.n, enough[0] if enough else len(ix.centroids))


def _probed(ix: Lists, questions: DataFrame, q_id: Sequence[str], q_vec: str) -> DataFrame:
    return R.explode_rows(questions, [*q_id, q_vec], nearest_lists(q_vec, ix.centroids, ix.probes), "_list")


def search(ix: Lists, questions: DataFrame, *, k: int, q_id: Sequence[str], q_vec: str,
           exclude: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Top ``k`` of the probed lists: ``q_id..., x_id..., score, rank``."""
    q_id, x_id = list(q_id), list(ix.x_id)
    if not ix.n:
        return K.knn(questions, ix.rows, k=k, q_id=q_id, x_id=x_id, q_vec=q_vec, x_vec=ix.x_vec, exclude=exclude)
    c, probes = ix.centroids, ix.probes

    def marks(vecs: pd.Series) -> np.ndarray:
        order = np.argsort(-(_matrix(vecs) @ c.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(vecs), len(c)), bool)
        np.put_along_axis(out, order, True, axis=1)
        return out

    # a question is stored once, not once a list: the kernel finds its lists
    return K.knn(questions.where(F.col(q_vec).isNotNull()), ix.rows, k=k, q_id=q_id, x_id=x_id, q_vec=q_vec, x_vec=ix.x_vec,
                 exclude=exclude, lists=("_list", marks))


def scored_share(ix: Lists, questions: DataFrame, q_id: Sequence[str], q_vec: str) -> float:
    """Pairs that :func:`search` scores, as a share of all."""
    n = _probed(ix, questions, q_id, q_vec).groupBy("_list").agg(F.count(F.lit(1)).alias("q"))
    x = ix.rows.groupBy("_list").agg(F.count(F.lit(1)).alias("x"))
    pairs = n.join(x, "_list").agg(F.sum(F.col("q") * F.col("x"))).first()[0] or 0
    return pairs / max(1, ix.n * questions.where(F.col(q_vec).isNotNull()).count())


# ------------------------------------------------------------ exact, Euclidean
@dataclass(frozen=True)
class Balls:
    """An index in balls: rows with their ball (``_list``), centres, radii and
    numbers of rows."""

    rows: DataFrame
    x_id: tuple[str, ...]
    x_vec: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def build_balls(index: DataFrame, x_id: Sequence[str], x_vec: str, balls: int | None = None, rounds: int = ROUNDS) -> Balls:
    """Every row of ``index`` in the ball of its nearest centre; rows without a
    vector are in none."""
    index = materialize(index.where(F.col(x_vec).isNotNull()).select(*x_id, x_vec), "ball_rows")
    n = index.count()
    balls = max(1, min(balls or math.isqrt(n), MAX_LISTS, n or 1))
    c = train_centroids(index, x_vec, list(x_id), balls, n, rounds, unit=False)
    if not len(c):
        return Balls(index.withColumn("_list", F.lit(0)), tuple(x_id), x_vec, c, np.zeros(0), np.zeros(0, np.int64))

    @F.pandas_udf("list int, d double")
    def nearest(s: pd.Series) -> pd.DataFrame:
        d = distances(_matrix(s, False), c)
        at = d.argmin(axis=1)
        return pd.DataFrame({"list": at.astype(np.int32), "d": d[np.arange(len(at)), at]})

    rows = materialize(index.withColumn("_n", nearest(x_vec)).select(*x_id, x_vec, F.col("_n.list").alias("_list"), F.col("_n.d").alias("_d")), "balls")
    radii, sizes = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for r in rows.groupBy("_list").agg(F.max("_d").alias("r"), F.count(F.lit(1)).alias("n")).collect():       # a row for each ball
        radii[r["_list"]], sizes[r["_list"]] = r["r"], r["n"]
    return Balls(rows.drop("_d"), tuple(x_id), x_vec, c, radii, sizes)


def _first_balls(ix: Balls, k: int):
    """The nearest balls that hold ``k`` rows together."""
    c, sizes = ix.centres, ix.sizes

    @F.pandas_udf("array<int>")
    def pick(s: pd.Series) -> pd.Series:
        o = np.argsort(distances(_matrix(s, False), c), axis=1, kind="stable")
        n = (np.cumsum(sizes[o], axis=1) < k).sum(axis=1) + 1
        return pd.Series([row[:m].tolist() for row, m in zip(o, n)])
    return pick


def _in_first(ix: Balls):
    """Marks the balls of a first round: a boolean for each question and ball."""
    balls = len(ix.centres)

    def marks(vecs: pd.Series, first: pd.Series) -> np.ndarray:
        out = np.zeros((len(vecs), balls), bool)
        n = first.map(len).to_numpy()
        out[np.repeat(np.arange(len(n)), n), np.concatenate(first.to_numpy())] = True
        return out
    return marks


def _in_others(ix: Balls):
    """Marks of the balls that are not among the ``first`` ones those that can
    hold a row as near as ``reach`` (null: any): a row of a ball is at least the
    centre's distance less the radius away."""
    c, sizes, radii = ix.centres, ix.sizes, ix.radii
    c2 = (c * c).sum(axis=1)
    rows = max(1, DISTANCE_CELLS // len(c))
    seen = _in_first(ix)

    def marks(vecs: pd.Series, reach: pd.Series, first: pd.Series) -> np.ndarray:
        out = ~seen(vecs, first) & (sizes > 0)
        far = reach.astype(np.float64).fillna(np.inf).to_numpy()
        for a in range(0, len(vecs), rows):
            m = _matrix(vecs.iloc[a:a + rows], False)
            both = (m * m).sum(axis=1)[:, None] + c2
            # squared distances from products, less what rounding can add: never too large
            least = both - 2 * (m @ c.T) - both * (4 * (c.shape[1] + 8) * np.finfo(float).eps)
            too_far = np.sqrt(np.maximum(least, 0)) - radii > (far[a:a + rows] * (1 + 1e-9) + 1e-9)[:, None]
            out[a:a + rows] &= ~too_far
        return out
    return marks


def l2_search(ix: Balls, questions: DataFrame, *, k: int, q_id: Sequence[str], q_vec: str,
              exclude: Sequence[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(exact top ``k`` by squared distance: ``q_id..., x_id..., score, rank``;
    ``q_id..., _list``: the balls that each question looked into).  A question
    without a vector finds nothing.

    The first round looks into the nearest balls; its ``k``-th distance is the
    reach of the second, which skips every ball that lies beyond it.  In each
    round the blocked kernel streams the balls past the questions, which are
    stored and shuffled once, whatever the number of balls they look into."""
    q_id, x_id = list(q_id), list(ix.x_id)
    q = materialize(questions.where(F.col(q_vec).isNotNull()).select(*q_id, q_vec), "ball_questions")
    order = [F.col("score").asc(), *[F.col(c).asc() for c in x_id]]
    best = Window.partitionBy(*q_id).orderBy(*order)

    def of(found: DataFrame) -> DataFrame:
        return found.drop("rank", "_list").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    if not len(ix.centres):
        found = K.knn(q, ix.rows, k=k, q_id=q_id, x_id=x_id, q_vec=q_vec, x_vec=ix.x_vec, metric="l2", exclude=exclude)
        return found, q.select(*q_id, F.lit(0).alias("_list")).limit(0)
    # a question lies beside those of its nearest ball, which look into like balls
    search = dict(k=k, q_id=q_id, x_id=x_id, q_vec=q_vec, x_vec=ix.x_vec, metric="l2", exclude=exclude, home="_home")
    one = materialize(q.withColumn("_first", _first_balls(ix, k + len(exclude))(q_vec)), "first_balls").withColumn("_home", F.col("_first")[0])
    near = materialize(of(K.knn(one, ix.rows, lists=("_list", _in_first(ix), "_first"), **search)), "first_round")
    reach = near.where(F.col("rank") == k).select(*q_id, F.sqrt("score").alias("_reach"))
    two = materialize(one.join(reach, q_id, "left"), "other_balls")
    others = _in_others(ix)
    more = K.knn(two, ix.rows, lists=("_list", others, "_reach", "_first"), **search)

    @F.pandas_udf("array<int>")
    def marked(s: pd.Series, far: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(x).astype(np.int32).tolist() for x in others(s, far, first)])

    visited = (R.explode_rows(one, q_id, F.col("_first"), "_list")
               .unionByName(R.explode_rows(two, q_id, marked(q_vec, "_reach", "_first"), "_list")))
    return of(near.drop("rank").unionByName(more.select(*near.drop("rank").columns))), visited


def skipped_share(ix: Balls, visited: DataFrame, questions: int) -> float:
    """Share of all (question, row) pairs that :func:`l2_search` didn't score."""
    pairs = visited.join(ix.rows.groupBy("_list").agg(F.count(F.lit(1)).alias("_n")), "_list").agg(F.sum("_n")).first()[0] or 0
    return 1 - pairs / max(1, questions * int(ix.sizes.sum()))
