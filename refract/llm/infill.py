"""Fill-in-middle transformation by content-defined chunks.

A text is cut into chunks where a rolling hash of the last ``WINDOW`` bytes has
``BITS`` leading zeros, so equal passages give equal chunks wherever they
stand.  A chunk's summary (line feeds, code points, whether it holds a marker,
its first and last bytes) is kept in a cache under the chunk's own bytes: a
chunk that documents share is compared by content and summed up once.  A
document's cuts are line ends; the running sums of its chunks' counts lead to
the chunk that holds such an end, and only that one is searched.  Markers that
lie across a chunk's end are found from the bytes at both sides of it.

The cache of a task is bounded in bytes and goes with the task.  Each text is
read once, from Arrow's own buffer; nothing is shuffled.

Defined results: a null text is an empty one, and stays plain; an empty text
has 0 lines; a null id draws as an empty string; repeated rows are changed
alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refract.llm.common import read, text_slices
from refract.llm.vec import mix

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that the rolling hash sees; a chunk ends where so many of its bits are
#: zero, after LEAST bytes at the soonest and MOST at the latest.
WINDOW, BITS, LEAST, MOST = 32, 9, 64, 4096
#: Bytes of chunks that a task remembers.
CACHE_BYTES = 16 << 20

_MARKER = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))).encode())
_EDGE = max(map(len, (PREFIX, SUFFIX, MIDDLE))) - 1
#: Bytes that continue a code point.
_TAILS = bytes(b for b in range(256) if b & 0xC0 == 0x80)

FORM = "id {id}, rid long, n long, form string, prefix_chars long, middle_chars long, output string"


def rolling(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of the ``window`` (a power of two) bytes that end at each place:
    the sum of each byte's number, shifted by its distance."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
        w = 1
        while w < window:
            h[w:] += h[:-w] << np.uint64(w)
            w *= 2
    return h


def chunk_ends(marks: np.ndarray, begin: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the bytes ``begin`` to ``end``.  ``marks``: places
    after which the rolling hash would cut; those whose window begins before
    the text don't count, so that a text's chunks depend on it alone."""
    out, at = [], begin
    lo, hi = np.searchsorted(marks, [begin + max(WINDOW, least) - 1, end - 1])
    for m in (marks[lo:hi] + 1).tolist():
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least:
            at = m
            out.append(at)
    while end - at > most:
        at += most
        out.append(at)
    if end > at:
        out.append(end)
    return out


def code_points(data: bytes) -> int:
    return len(data.translate(None, _TAILS))


class Chunks:
    """Summaries of chunks by their content; at most ``limit`` bytes of them."""

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.limit, self.size, self.held = limit, 0, {}
        self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bytes, bytes]:
        """(line feeds, code points, holds a marker, first bytes, last bytes)."""
        found = self.held.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        self.misses += 1
        found = chunk.count(b"\n"), code_points(chunk), _MARKER.search(chunk) is not None, chunk[:_EDGE], chunk[-_EDGE:]
        if len(chunk) <= self.limit:
            self.size += len(chunk)
            if self.size > self.limit:
                self.held, self.size = {}, len(chunk)
            self.held[chunk] = found
        return found


class Text:
    """A text as its chunks: counts of lines, and places of their ends."""

    def __init__(self, data: bytes, ends: list[int], cache: Chunks) -> None:
        self.data, self.ends = data, [0, *ends]
        parts = [cache.summary(data[a:b]) for a, b in zip(self.ends, ends)]
        self.feeds = [0, *accumulate(p[0] for p in parts)]
        self.chars = [0, *accumulate(p[1] for p in parts)]
        self.lines = self.feeds[-1] + (bool(data) and data[-1] != 10)
        self.marked = any(p[2] for p in parts)
        before = b""
        for p in parts:
            if self.marked:
                break
            self.marked = _MARKER.search(before + p[3]) is not None
            before = (before + p[4])[-_EDGE:]

    def end_of(self, lines: int) -> tuple[int, int]:
        """(bytes, code points) of the first so many lines."""
        if lines == 0:
            return 0, 0
        if lines > self.feeds[-1]:                       # the last line has no end of its own
            return len(self.data), self.chars[-1]
        i = bisect_left(self.feeds, lines) - 1           # the chunk that holds that line feed
        at = self.ends[i]
        for _ in range(lines - self.feeds[i]):
            at = self.data.index(b"\n", at) + 1
        return at, self.chars[i] + code_points(self.data[self.ends[i]:at])


def draws(seed: int, id_: str | None) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{id_ or ''}".encode()).digest()[:16])


def rearrange(text: Text, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of prefix and middle, output)."""
    if not text.data or text.marked or h[2] % 100 >= rate:
        return "plain", None, None, text.data
    first, second = sorted(x % (text.lines + 1) for x in h[:2])
    (a, a_chars), (b, b_chars) = text.end_of(first), text.end_of(second)
    p, m, s = PREFIX.encode() + text.data[:a], MIDDLE.encode() + text.data[a:b], SUFFIX.encode() + text.data[b:]
    if h[3] % 100 < spm:
        return "spm", a_chars, b_chars - a_chars, s + p + m
    return "psm", a_chars, b_chars - a_chars, p + s + m


def _forms(seed: int, rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chunks()
        for b in text_slices(batches, "text"):
            texts = pc.fill_null(b.column("text"), "").cast(pa.large_string())
            off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
            buf = texts.buffers()[2]
            raw = memoryview(buf) if buf is not None else memoryview(b"")
            first, last = int(off[0]), int(off[-1])
            marks = []
            for at in range(first, last, 1 << 20):       # a long text's hashes need not be held at once
                low = max(first, at - WINDOW + 1)
                h = rolling(np.frombuffer(raw[low:min(last, at + (1 << 20))], np.uint8))[at - low:]
                marks.append(np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + at)
            marks = np.concatenate(marks) if marks else np.zeros(0, np.int64)
            out = []
            for i, key in enumerate(b.column("key").to_pylist()):
                s, e = int(off[i]), int(off[i + 1])
                t = Text(bytes(raw[s:e]), [x - s for x in chunk_ends(marks, s, e)], cache)
                out.append((t.lines, *rearrange(t, draws(seed, key), rate, spm)))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("rid"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
                 pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64()),
                 pa.array([o[4] for o in out], pa.binary()).cast(pa.string())],
                ["id", "rid", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None, seed: int = SEED,
                   rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per input row: ``id``, ``rid`` (``key``, or a number made here),
    ``n`` (lines), ``form`` (plain, psm or spm), ``prefix_chars``,
    ``middle_chars`` (null if plain), ``output``.  Of 100 texts ``rate`` are
    rearranged, of 100 of these ``spm`` with the suffix first."""
    d = docs.select(F.col(id_col).alias("id"), (F.col(key) if key else F.monotonically_increasing_id()).alias("rid"),
                    F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return d.mapInArrow(_forms(seed, rate, spm), FORM.format(id=docs.schema[id_col].dataType.simpleString()))


def restore(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made.  A text with a marker of its own
    is plain, so the first ones in an output are those that were put in."""
    def parts(second: str):
        body = F.substr(output, F.lit(len(PREFIX) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + F.lit(len(MIDDLE) + 1))

    psm, spm = parts(SUFFIX), parts(PREFIX)
    return (F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output))


_H = "('0x' || substr(h, {}, 8))::BIGINT"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
                  sha256('{SEED}:' || doc_id) AS h FROM documents),
c AS (SELECT *, len(u) AS n, least({_H.format(1)} % (len(u) + 1), {_H.format(9)} % (len(u) + 1)) AS a,
             greatest({_H.format(1)} % (len(u) + 1), {_H.format(9)} % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                       OR {_H.format(17)} % 100 >= {RATE} THEN 'plain'
                  WHEN {_H.format(25)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


def query(spark, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
