"""Mixing documents to target domain weights by soft membership.

A naive Bayes classifier, fitted on the documents that a labelled table
covers, predicts each document's domain posteriors.  Nonnegative document
rates are then fitted so that the expected tokens of each domain meet their
targets: least squares of the relative errors, by projected gradient.  In the
metric where a document weighs its tokens and a domain its expected tokens,
the step of 1 is safe (the iteration's matrix is row-stochastic).  A rate
depends on the posteriors and on the past sums only (one number a domain and
round), so each round is one pass that replays them and sums again; nothing
else is kept or collected.

Defined results: documents without words have rate 1; with nothing to learn
from there is one domain and every rate is 1; targets for unknown domains are
an error; a rate of 2.3 gives two copies and a third with probability 0.3, by
a hash of the id; repeated rows are documents like any other; an empty table
gives no rows; other columns are kept as they are and not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refract.llm.common import fresh, keyed, read, releasing, text_slices
from refract.llm.langid import SLICE, letter_table, posteriors, train
from refract.llm.vec import Words
from refract.session import materialize

#: Posteriors count at most so many n-grams of a text.
TEMPER = 200.0
#: Default targets: a domain's share of expected tokens to this power.
SMOOTH = 0.7
ROUNDS, TOLERANCE = 60, 1e-6
#: Labelled documents that the classifier learns from, by a hash of the id.
LABELLED_ROWS = 20000
UNKNOWN = "unknown"


def _members(model, labels: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, words = letter_table(), Words()
        names, prior, logp = model.value
        for b in text_slices(batches, "text", SLICE):
            n = b.num_rows
            tokens = np.bincount(words.split(b.column("text"))[0], minlength=n)
            if names:
                p, _ = posteriors(b.column("text").to_pylist(), letters, prior, logp, TEMPER)
            else:
                p = np.ones((n, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), pa.array(tokens.astype(np.int64)),
                                              pa.array(list(p), pa.list_(pa.float64()))], ["id", "rid", "n_tokens", "p"])
    return releasing(run)


def members(docs: DataFrame, labelled: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text",
            key: str | None = None) -> tuple[list[str], DataFrame]:
    """(domains, frame of ``id``, ``rid``, ``n_tokens``, ``p``): the posteriors
    of each document, learnt from the rows of ``labelled`` and their ``label``."""
    model = train(labelled, F.col(text_col), label)
    domains = model[0] or [UNKNOWN]
    d = docs.select(F.col(id_col).alias("id"), (F.col(key) if key else F.monotonically_increasing_id()).alias("rid"),
                    F.col(text_col).alias("text"))
    d = d.mapInArrow(_members(docs.sparkSession.sparkContext.broadcast(model), domains),
                     f"id {docs.schema[id_col].dataType.simpleString()}, rid long, n_tokens long, p array<double>")
    return domains, materialize(d, "members")


def replay(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the steps so far; a step
    is the relative error of each domain."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0.0, r - p @ s)
    return r


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sums(steps: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            p = _matrix(b, k)
            total += (b.column("n_tokens").to_numpy() * replay(p, steps)) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], ["d", "s"])
    return run


def _rates(steps: np.ndarray, domains: list[str]):
    k = len(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b, k)
            rate = np.where(b.column("n_tokens").to_numpy() > 0, replay(p, steps), 1.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("rid"), b.column("n_tokens"), pa.array([domains[i] for i in p.argmax(axis=1)], pa.string()), pa.array(rate)],
                ["id", "rid", "n_tokens", "domain", "rate"])
    return run


def fit_rates(m: DataFrame, domains: list[str], targets: dict[str, float] | None = None,
              rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, float]]:
    """(``id``, ``rid``, ``n_tokens``, ``domain`` (the likeliest), ``rate``,
    ``copies``; expected tokens of each domain under the rates).  ``targets``:
    weights of the domains' tokens, of which there shall be as many as now.
    Where ``rounds`` end above ``tolerance`` (targets that overlapping
    posteriors can't meet) a warning gives the error that is left."""
    k = len(domains)
    if targets and (odd := set(targets) - set(domains)):
        raise ValueError(f"targets for unknown domains: {sorted(odd)}")

    def sums(steps):
        rows = (m.select("n_tokens", "p").mapInArrow(_sums(np.array(steps).reshape(-1, k), k), "d int, s double")
                .groupBy("d").agg(F.sum("s").alias("s")).collect())
        s = np.zeros(k)
        for r in rows:
            s[r.d] = r.s
        return s

    now = base = sums([])
    share = base ** SMOOTH if targets is None else np.array([targets.get(d, 0.0) for d in domains])
    want = share * (base.sum() / share.sum()) if share.sum() > 0 else base
    steps: list[np.ndarray] = []
    for _ in range(rounds):
        err = (now - want) / np.where(base > 0, base, 1.0)
        if np.abs(err).max(initial=0.0) < tolerance:
            break
        steps.append(err)
        now = sums(steps)
    left = float((np.abs(now - want) / np.where(base > 0, base, 1.0)).max(initial=0.0))
    if left >= tolerance:
        warnings.warn(f"mixing: targets missed by up to {left:.3g} of a domain's tokens after {len(steps)} rounds", RuntimeWarning, stacklevel=2)
    kind = m.schema["id"].dataType.simpleString()
    rates = m.mapInArrow(_rates(np.array(steps).reshape(-1, k), domains), f"id {kind}, rid long, n_tokens long, domain string, rate double")
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rates.withColumn("copies", F.floor(F.col("rate") + chance).cast("int")), dict(zip(domains, now.tolist()))


def mix(docs: DataFrame, labels: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        targets: dict[str, float] | None = None) -> DataFrame:
    """``docs``, each as often as its rate says.  The classifier learns from
    the documents that ``labels`` covers."""
    rows, key = keyed(docs, "mixing")
    domains, m = members(rows, labelled_rows(rows, labels, id_col), F.col(label_col), id_col, text_col, key)
    rates, _ = fit_rates(m, domains, targets)
    copies = fresh(rows, "_copies")
    n = rates.where("copies > 0").select(F.col("rid").alias(key), F.col("copies").alias(copies))
    out = rows.join(n, key).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*docs.columns)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", rows: int = LABELLED_ROWS) -> DataFrame:
    """The documents that ``labels`` covers; of more than ``rows`` ids a share
    of ``rows`` by a hash, so that the ids can be broadcast."""
    ids = labels.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    n = ids.count()
    if n > rows:
        ids = ids.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    return docs.join(F.broadcast(ids), id_col, "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    domains, m = members(docs, labelled_rows(docs, read(spark, sf_dir, "labels")), F.col("lang"))
    rates, _ = fit_rates(m, domains)
    return rates.select(F.col("id").alias("doc_id"), "n_tokens", "domain", "rate", "copies")
