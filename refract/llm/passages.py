"""Substring dedup by hashing lines, and runs of neighbouring units of lines.

A text is cut at line ends.  A line is cut into units where a sentence ends,
and before a capital letter that follows a word without a sentence end, because
a passage pasted into the middle of a sentence begins there.  What is hashed
(lower case, one space between words) are

* whole lines of fewer than ``LEAST`` words, and
* in longer lines, the shortest runs of neighbouring units with ``LEAST`` words
  or more that begin, and that end, with each unit.

So lines of any length are compared as a whole, and parts of lines where a run
of ``LEAST`` words is shared; a shorter sentence inside a line is no passage by
itself, and stays.  Digests are grouped over all documents, the earliest
occurrence (smallest id, then smallest place) stays, and every other one is
removed.  Offsets are code points of the original text.

Every text that goes stays somewhere: an occurrence is only removed where an
earlier one stands, and of one that overlaps the occurrence that stays only the
part behind it is.

Only 16-byte digests and places are shuffled.  Digests that more than one
``HEAVY``-th of all rows hold are found by a Misra-Gries pass (at most twice as
many); their winners are aggregated before the shuffle, broadcast, and settle
those rows where they are read.  The others take a shuffle and a join that the
engine can split.

Not caught: a passage that is pasted behind a word without a sentence end and
itself begins with a small letter keeps the words up to its first unit's end.

Defined results: null and empty texts have nothing to compare; null ids come
after all others; repeated rows count as occurrences in the order of their row
numbers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refract.llm.common import fresh, keyed, read, text_slices
from refract.llm.exact_dedup import heavy_digests
from refract.session import materialize

#: Words that a run has at least.
LEAST = 8
#: Digests of more than one HEAVY-th of all rows are settled by broadcast.
HEAVY = 4096
#: Where a unit ends inside a line: behind the signs that end a sentence, unless
#: a letter or digit follows; behind the blank before a capital letter.
END = re.compile("[.!?]++(?!\\w)|(?<=[^\\s.!?])[^\\S\\n]+(?=[A-ZÀ-ÖØ-ÞΑ-ΩА-Я])")
LINE = re.compile(r"[^\n]+")

SPAN = "start long, end long, keep_id {id}, keep_start long"


def _digest(kind: bytes, words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16, person=kind).digest()


def units_of(line: str, at: int = 0) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of a line's units; ``at`` is where it begins."""
    out, s = [], 0
    for e in [*(m.end() for m in END.finditer(line)), len(line)]:
        body = line[s:e]
        if words := body.lower().split():
            out.append((at + s + len(body) - len(body.lstrip()), at + s + len(body.rstrip()), words))
        s = e
    return out


def hashed(text: str, least: int = LEAST) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of all that is compared."""
    out = []
    for m in LINE.finditer(text):
        units = units_of(m.group(), m.start())
        size = [len(u[2]) for u in units]
        total = sum(size)
        if not units:
            continue
        if total < least:
            out.append((units[0][0], units[-1][1], _digest(b"line", [w for u in units for w in u[2]])))
            continue
        runs, j, n = set(), 0, 0                           # units i to j - 1 hold n words
        for i in range(len(units)):
            while n < least and j < len(units):
                n += size[j]
                j += 1
            if n < least:
                break
            runs.add((i, j))
            n -= size[i]
        i = n = 0                                          # units i to j hold n words
        for j in range(len(units)):
            n += size[j]
            while n - size[i] >= least:
                n -= size[i]
                i += 1
            if n >= least:
                runs.add((i, j + 1))
        for i, j in sorted(runs):
            out.append((units[i][0], units[j - 1][1], _digest(b"run", units[i][2] if j == i + 1 else [w for u in units[i:j] for w in u[2]])))
    return out


def _hashed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            row, found = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                u = [(None, None, None), *(hashed(t, least) if t else [])]            # first the row itself
                row += [i] * len(u)
                found += u
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), b.column("rid").take(take), pa.array([u[0] for u in found], pa.int64()),
                 pa.array([u[1] for u in found], pa.int64()), pa.array([u[2] for u in found], pa.binary())],
                ["id", "rid", "start", "end", "digest"])
    return run


def stored_units(docs: DataFrame, id_col: str, text_col: str, key: str | None = None, least: int = LEAST) -> DataFrame:
    """``id``, ``rid`` (``key``, or a number made here), ``start``, ``end``,
    ``digest`` of all that is compared, and one row without a digest for each
    document row, stored."""
    d = docs.select(F.col(id_col).alias("id"), (F.col(key) if key else F.monotonically_increasing_id()).alias("rid"),
                    F.col(text_col).alias("text"))
    return materialize(d.mapInArrow(_hashed(least), f"id {docs.schema[id_col].dataType.simpleString()}, rid long, "
                                                    "start long, end long, digest binary"), "units")


def _settled(winners):
    """The rows whose digest is a frequent one that repeats, each with the
    place that stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = winners.value
        names = t.column("digest").combine_chunks().cast(pa.binary())
        places = t.column("f").combine_chunks()
        for b in batches:
            at = pc.index_in(b.column("digest").cast(pa.binary()), value_set=names)
            some = at.is_valid()
            b = b.filter(some)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "rid", "start", "end")], places.take(at.filter(some))],
                                             ["id", "rid", "start", "end", "f"])
    return run


def repeats(stored: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """:func:`repeated_runs` of :func:`stored_units`."""
    u = stored.where(F.col("digest").isNotNull())
    place = F.struct(F.col("id").isNull().alias("o"), F.col("id").alias("i"), F.col("rid").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))

    def earliest(rows):
        return rows.groupBy("digest").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "f")

    digests = [bytes(r.digest) for r in heavy_digests(u, heavy).collect()]             # at most 2 * heavy
    if digests:
        often = F.col("digest").isin([F.lit(x) for x in digests])
        winners = earliest(u.where(often)).toArrow()                                   # at most as many
        kind = f"{u.select('id', 'rid', 'start', 'end').schema.simpleString()[7:-1].replace(':', ' ')}, f {earliest(u).schema['f'].dataType.simpleString()}"
        settled = u.where(often).mapInArrow(_settled(u.sparkSession.sparkContext.broadcast(winners)), kind)
        rest = u.where(~often)
    else:
        settled, rest = None, u
    found = rest.join(earliest(rest), "digest").select("id", "rid", "start", "end", "f")
    found = found if settled is None else settled.unionByName(found)
    same = F.col("rid") == F.col("f.r")
    return (found.where(~same | (F.col("start") != F.col("f.s")))
            .select("id", "rid", F.when(same, F.greatest("start", "f.e")).otherwise(F.col("start")).alias("start"), "end",
                    F.col("f.i").alias("keep_id"), F.col("f.s").alias("keep_start")).where("start < end"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None,
                  least: int = LEAST) -> DataFrame:
    """One row for each line or run to remove: ``id``, ``rid`` (``key``, or a
    number made here), ``start``, ``end``, ``keep_id``, ``keep_start`` (the
    occurrence that stays).  Runs of one text overlap."""
    return repeats(stored_units(docs, id_col, text_col, key, least))


def merged(runs: list[tuple]) -> list[tuple]:
    """Spans that don't overlap; each has the place that its first run has."""
    out: list = []
    for s, e, *keep in sorted(runs, key=lambda x: (x[0], -x[1])):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, *out[-1][2:])
        else:
            out.append((s, e, *keep))
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kind = b.schema.field("runs").type
        spans = [merged([tuple(x.values()) for x in runs]) for runs in b.column("runs").to_pylist()]
        names = [f.name for f in kind.value_type]
        yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([[dict(zip(names, s)) for s in x] for x in spans], kind)], ["rid", "spans"])


def _of_rows(runs: DataFrame) -> DataFrame:
    """``rid``, ``spans``: what goes of each document row with something to
    remove, in order."""
    kind = runs.schema["id"].dataType.simpleString()
    lists = runs.groupBy("rid").agg(F.collect_list(F.struct("start", "end", "keep_id", "keep_start")).alias("runs"))     # of one text
    return lists.mapInArrow(_spans, f"rid long, spans array<struct<{', '.join(x.replace(' ', ':') for x in SPAN.format(id=kind).split(', '))}>>")


def _cut(text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            for i, spans in enumerate(b.column(out).to_pylist()):
                if spans:
                    at = [0, *[x for s in spans for x in (s["start"], s["end"])], len(texts[i])]
                    texts[i] = "".join(texts[i][s:e] for s, e in zip(at[::2], at[1::2]))
            yield b.set_column(b.schema.get_field_index(text), b.schema.field(text), pa.array(texts, b.schema.field(text).type))
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                   spans: str = "removed") -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and a new column
    (its name is made different from the others) with the original offsets of
    what was cut: array<struct<start, end, keep_id, keep_start>>."""
    rows, key = keyed(docs, "passages")
    spans = fresh(docs, spans)
    gone = _of_rows(repeated_runs(rows, id_col, text_col, key, least)).select(F.col("rid").alias(key), F.col("spans").alias(spans))
    out = rows.join(gone, key, "left").drop(key)
    return out.mapInArrow(_cut(text_col, spans), out.schema)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``id``, ``n_removed``, ``chars_removed``, ``removed`` (null where there
    is nothing) of each row of ``docs``, also where ids are null or repeat."""
    stored = stored_units(docs, id_col, text_col, least=least)
    gone = _of_rows(repeats(stored)).select("rid", F.col("spans").alias("removed"))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    none = F.lit(0).cast("long")
    return stored.where(F.col("digest").isNull()).select("id", "rid").join(gone, "rid", "left").select(
        "id", F.when(F.col("removed").isNull(), none).otherwise(F.size("removed").cast("long")).alias("n_removed"),
        F.coalesce(chars, none).alias("chars_removed"), "removed")


def query(spark, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
