"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training is one pass: each task counts hashed n-grams for each label, the
counts are summed in fixed-size chunks, and the matrix of log probabilities
(labels x ``DIM``) is broadcast.  Scoring reads whole texts and sums the
matrix's entries over a text's n-grams in numpy, without Python per character.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with nothing to learn from every text is; of labels with equal posteriors the
first in order is taken; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refract.llm.common import held_out, read, releasing, text_slices, worker_cache

GRAMS = (1, 2, 3)
DIM_BITS = 16
ALPHA = 0.5
#: Text bytes, and characters, that are worked on at once (a longer text is a
#: slice of its own, and is read block by block).
SLICE, BLOCK = 1 << 18, 1 << 16
#: Counters in one row while counts are summed.
CHUNK = 1 << 10
UNDETERMINED = "und"


def letter_table() -> np.ndarray:
    """For each code point: is it a letter."""
    held = worker_cache("letters")
    if "table" not in held:
        held["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return held["table"]


def feature_blocks(texts: list, letters: np.ndarray, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row and bucket of each n-gram, letters of each row) of one stretch of
    ``size`` characters after the other.  Characters other than letters count
    as one space; n-grams with two of these side by side are left out, so none
    spans two texts; one that spans two stretches belongs to the later one."""
    low = [(t or "").lower() for t in texts]
    cp = np.frombuffer("  ".join(["", *low, ""]).encode("utf-32-le", "replace"), "<u4")
    end = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 2) + 2          # two spaces before each text
    mult = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    for s in range(0, len(cp), size):
        lo = max(0, s - max(GRAMS) + 1)
        part = cp[lo:s + size]
        row = np.minimum(np.searchsorted(end, np.arange(lo, lo + len(part)), "right"), max(0, len(low) - 1))
        is_letter = letters[part]
        c = np.where(is_letter, part, 32).astype(np.uint64)
        gap = ~is_letter[:-1] & ~is_letter[1:]
        rows, buckets = [], []
        h = np.zeros(len(c), np.uint64)
        with np.errstate(over="ignore"):
            for n in GRAMS:
                if len(c) < n:
                    break
                h = h[:len(c) - n + 1] + c[n - 1:] * mult[n - 1]
                if n == 1:
                    ok = is_letter
                else:
                    ok = ~gap if n == 2 else ok[:-1] & ~gap[n - 2:]
                new = ok.copy()
                new[:max(0, s - lo - n + 1)] = False      # the stretch before has them
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n) * mult[0]
                mixed ^= mixed >> np.uint64(32)
                buckets.append(((mixed * mult[1])[new] >> np.uint64(64 - DIM_BITS)).astype(np.int64))
                rows.append(row[n - 1:][new])            # an n-gram belongs to its last character's text
        yield np.concatenate(rows), np.concatenate(buckets), np.bincount(row[s - lo:][is_letter[s - lo:]], minlength=len(low))


def features(texts: list, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of :func:`feature_blocks`, for few and short texts."""
    rows, buckets, n = zip(*feature_blocks(texts, letters))
    return np.concatenate(rows), np.concatenate(buckets), sum(n)


@releasing
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, held, docs = letter_table(), {}, {}
    for b in text_slices(batches, "text", SLICE):
        names = b.column("label").to_pylist()
        kinds = sorted(set(names))
        kind = np.array([kinds.index(x) for x in names], np.int64)
        n = np.zeros(len(kinds) << DIM_BITS, np.int64)
        for row, bucket, _ in feature_blocks(b.column("text").to_pylist(), letters):
            n += np.bincount((kind[row] << DIM_BITS) + bucket, minlength=len(n))
        n = n.reshape(len(kinds), -1)
        for i, k in enumerate(kinds):
            held[k] = held[k] + n[i] if k in held else n[i]
            docs[k] = docs.get(k, 0) + names.count(k)
    out = [(k, -1, np.array([n], "<i8").tobytes()) for k, n in docs.items()]
    out += [(k, i, part.tobytes()) for k, n in held.items() for i, part in enumerate(n.astype("<i8").reshape(-1, CHUNK)) if part.any()]
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                                      pa.array([o[2] for o in out], pa.binary())], ["label", "chunk", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for b in batches:
        for label, chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            part, k = np.frombuffer(blob.as_buffer(), "<i8"), (label, chunk)
            held[k] = held[k] + part if k in held else part.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()),
         pa.array([x.tobytes() for x in held.values()], pa.binary())], ["label", "chunk", "counts"])


def train(docs: DataFrame, text: Column, label: Column, alpha: float = ALPHA) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels in order, log prior of each, log probabilities labels x DIM).
    Rows without text or label teach nothing.  What reaches the driver is one
    row of counters for each label and chunk: bounded by the number of labels."""
    schema = "label string, chunk int, counts binary"
    rows = (docs.select(text.alias("text"), label.cast("string").alias("label")).where("text is not null and label is not null")
            .mapInArrow(_count, schema).repartition("label", "chunk").mapInArrow(_add, schema).collect())
    labels = sorted({r.label for r in rows})
    counts, n = np.zeros((len(labels), 1 << DIM_BITS)), np.ones(len(labels))
    for r in rows:
        i, part = labels.index(r.label), np.frombuffer(r.counts, "<i8")
        if r.chunk < 0:
            n[i] = part[0]
        else:
            counts[i, r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = part
    if not labels:
        return labels, n, counts
    return labels, np.log(n / n.sum()), np.log(counts + alpha) - np.log(counts.sum(axis=1, keepdims=True) + alpha * counts.shape[1])


def posteriors(texts: list, letters: np.ndarray, prior: np.ndarray, logp: np.ndarray, temper: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each label, letters) of each text.  ``temper``: count a
    text's n-grams as at most so many, which keeps posteriors of long texts
    from being all or nothing."""
    n = len(texts)
    s, grams, found = np.zeros((n, len(logp))), np.zeros(n), np.zeros(n, np.int64)
    for row, bucket, k in feature_blocks(texts, letters):
        s += np.stack([np.bincount(row, weights=p[bucket], minlength=n) for p in logp], axis=1)
        grams += np.bincount(row, minlength=n)
        found += k
    if temper:
        s *= np.minimum(1.0, temper / np.maximum(grams, 1))[:, None]
    s += prior
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True), found


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        labels, prior, logp = model.value
        for b in text_slices(batches, "text", SLICE):
            n = b.num_rows
            name, score = [UNDETERMINED] * n, np.zeros(n)
            if labels:
                p, n_letters = posteriors(b.column("text").to_pylist(), letters, prior, logp)
                best = p.argmax(axis=1)
                score = np.where(n_letters > 0, p.max(axis=1), 0.0)
                name = [labels[k] if m else UNDETERMINED for k, m in zip(best.tolist(), n_letters.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("out"), pa.array(name, pa.string()), pa.array(score)],
                                             ["id", "held_out", "lang_pred", "score"])
    return releasing(run)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``lang_pred``, ``score`` of each row."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("out"), F.col(text_col).alias("text"))
    return d.mapInArrow(_score(model), f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))), F.col("text"), F.col("lang"))
    return identify(docs, model).withColumnRenamed("id", "doc_id")

