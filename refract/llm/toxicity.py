"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features are the distinct hashed words, word beginnings (of ``BEGINS`` bytes:
inflected and compound words share them), neighbouring pairs and pairs with
one or two words between them of a whole text.  The model is fitted on a bounded
sample of labelled rows (``TRAIN_ROWS``, by a hash of the id) with a learning
rate of its own for each coordinate and L1 sparsity; the few weights that are
not zero are broadcast, and scoring looks at no other feature.

Defined results: null and empty texts score like texts without features (the
bias); documents with several labels are toxic if one says so; null labels
teach nothing; with nothing to learn from every score is 0; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refract.llm.common import held_out, read, releasing, text_slices
from refract.llm.vec import Words, mix
from refract.session import materialize

DIM_BITS = 20
BEGINS = (4, 5, 6, 7, 8)
SKIPS = (1, 2, 3)                  # distance of the two words of a pair
#: Labelled rows, and features of all of them, that the model is fitted on at most.
TRAIN_ROWS, TRAIN_FEATURES = 16384, 1 << 26
EPOCHS = 3
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0


def features(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), with repetitions."""
    row, h, *begins = words.split(texts, BEGINS)
    shift = np.uint64(64 - DIM_BITS)
    rows, feats = [row], [(h >> shift).astype(np.int64)]
    for b in begins:
        rows.append(row[b != 0])
        feats.append((b[b != 0] >> shift).astype(np.int64))
    with np.errstate(over="ignore"):
        for d in SKIPS:
            if len(row) <= d:
                continue
            same = row[:-d] == row[d:]
            pair = mix(h[:-d] * np.uint64(0xD6E8FEB86659FD93) + h[d:] + np.uint64(d))[same]
            rows.append(row[:-d][same])
            feats.append((pair >> shift).astype(np.int64))
    return np.concatenate(rows), np.concatenate(feats)


@releasing
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in text_slices(batches, "text"):
        row, feat = features(b.column("text"), words)
        both = np.unique((row << DIM_BITS) + feat)
        cut = np.searchsorted(both >> DIM_BITS, np.arange(b.num_rows + 1))
        feat = (both & ((1 << DIM_BITS) - 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(feat))
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), lists], ["k", "y", "x"])


def ftrl(x: list[np.ndarray], y: list[int], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
         l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights after ``epochs`` passes over binary examples; the last one is
    the bias, which has no L1 term."""
    bias = 1 << DIM_BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    lim = np.full(bias + 1, l1)
    lim[bias] = 0.0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= lim[i], 0.0, (np.sign(zi) * lim[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for xi, yi in zip(x, y):
            i = np.append(xi, bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - yi
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    return weights(np.arange(bias + 1))


def _fit(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, x, y = [], [], []
        for b in batches:
            off = b.column("x").offsets.to_numpy()
            flat = b.column("x").values.to_numpy()
            x += [flat[s:e].copy() for s, e in zip(off[:-1], off[1:])]
            y += b.column("y").to_pylist()
            k += b.column("k").to_pylist()
        w = np.zeros(0)
        if x:
            o = np.argsort(np.array(k, np.int64), kind="stable").tolist()
            w = ftrl([x[i] for i in o], [y[i] for i in o], epochs)
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(w[some])], ["i", "w"])
    return releasing(run)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS, epochs: int = EPOCHS, most: int = TRAIN_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) from the labelled rows of ``docs`` that are not
    held out.  Of more than ``rows`` labels a share of ``rows`` is taken by a
    hash of the id; where their texts have more than ``most`` features, a share
    of those rows.  The ids and labels of that sample are broadcast, and one
    task fits them: the first is bounded by ``rows``, the second by ``most``."""
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
           .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("k", F.xxhash64("id")))
    n = lab.count()
    if n > rows:
        lab = lab.where(F.pmod("k", F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id").select("k", "y", "text")
    x = materialize(d.mapInArrow(_examples, "k long, y int, x array<int>"), "examples")
    size = x.agg(F.sum(F.size("x").cast("long"))).first()[0] or 0
    if size > most:
        x = x.where(F.pmod(F.xxhash64("k", F.lit(1)), F.lit(1 << 30)) < int(most / size * (1 << 30)))
    model = x.repartition(1).mapInArrow(_fit(epochs), "i int, w double").collect()   # at most 2 ** DIM_BITS, mostly zero and left out
    return np.array([r.i for r in model], np.int64), np.array([r.w for r in model])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (i, weight) = Words(), model.value
        w = np.zeros((1 << DIM_BITS) + 1)
        w[i] = weight
        some = w != 0
        for b in text_slices(batches, "text"):
            row, feat = features(b.column("text"), words)
            hit = some[feat]
            both = np.unique((row[hit] << DIM_BITS) + feat[hit])
            s = np.bincount(both >> DIM_BITS, weights=w[both & ((1 << DIM_BITS) - 1)], minlength=b.num_rows) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(s, -35, 35))) if len(i) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), b.column("out"), pa.array(p)], ["id", "rid", "held_out", "score"])
    return releasing(run)


def _keep(model, text: str, threshold: float):
    """Rows below the threshold, or whose words say nothing against them; the
    scores are those of :func:`_score`."""
    scores = _score(model)
    i, weight = model.value
    bias = 1 / (1 + np.exp(-weight[i == 1 << DIM_BITS].sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            none = pa.nulls(b.num_rows, pa.int64())
            part = pa.RecordBatch.from_arrays([none, none, none, b.column(text)], ["id", "rid", "out", "text"])
            s = np.concatenate([x.column("score").to_numpy() for x in scores([part])])
            yield b.filter(pa.array((s < threshold) | (s <= bias)))
    return releasing(run)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """``id``, ``rid`` (``key``, or a number made here), ``held_out``, ``score``."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("id"), (F.col(key) if key else F.monotonically_increasing_id()).alias("rid"),
                    held_out(F.col(id_col)).alias("out"), F.col(text_col).alias("text"))
    return d.mapInArrow(_score(model), f"id {docs.schema[id_col].dataType.simpleString()}, rid long, held_out boolean, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their
    columns.  Where the bias alone reaches it (few labels, most of them toxic),
    a text goes only if its own features raise its score.  The model learns from the labelled rows of ``learn_from``."""
    model = docs.sparkSession.sparkContext.broadcast(train(learn_from, labels, id_col, text_col))
    return docs.mapInArrow(_keep(model, text_col, threshold), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    s = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return s.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

