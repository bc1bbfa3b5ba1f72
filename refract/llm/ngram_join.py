"""N-gram Jaccard join: groups of documents whose sets of word shingles are
alike, by rare-first prefix filtering.

1. One scan gives each document's set size and set hash (128 bits), and a
   sketch of how often each shingle occurs: ``2 ** SKETCH_BITS`` counters whose
   sums are kept as one byte each on a scale of logarithms (``STEPS`` to a
   doubling), so that the broadcast is of fixed size and no counter fills up.
   Documents with one and the same set are one class from here on; a class is
   named by 64 bits of its hash, or by the other 64 where two classes share
   those, which is looked for.
2. A second scan orders each class's shingles by (sketched count, hash), rare
   ones first, and emits the prefix that any partner must meet.  The order is
   total and the same everywhere, so the sketch's error costs time only.  Rows
   are narrow: shingle, class, and size, place and rank in two numbers.
3. One shuffle by shingle: repetitions of a class go, and so do rows without a
   neighbour of a size that could link.  Each row that stays is compared with
   pivots of its shingle (the class whose prefix is the most common: of a group
   of near copies the one with the fewest changes; one by hash) and with the
   next smaller class.  Pairs that share enough of their prefixes are verified
   and linked; components follow.  Then every pair of classes that share a
   prefix shingle and still lie in different components passes the filters
   below, or not, and is verified.  A pair inside one component changes nothing,
   so no link between components is lost, and a group of n near copies costs
   about n verifications, not n * n.
   A shingle whose counter stands far above the others is dealt over parts, by
   its count, while repetitions are dropped and pivots compared.
4. Filters of a pair, at each common prefix shingle: length; positional (the
   first common shingle leaves room for the needed overlap on both sides, so a
   linked pair passes there); prefix overlap (all common shingles of the
   prefix that ends first are common prefix shingles, of which there are at
   most as many as either class has shared ones).
5. Verification: the suffix filter (an upper bound of the overlap from counts
   in 16 ranges of the hash), then the exact intersection.  Only the sets of
   classes in pairs that passed are made again, found by a fixed-size bitmap
   whose false positives the joins drop.

Shingles are 64-bit hashes.

Defined results: null, empty and wordless texts have an empty set, link with
nothing and are their own component; texts with fewer words than a shingle
have their whole sequence as the only one; repeated rows and ids are rows like
any other; ids that are null are passed over by the smallest id of a component
that has another; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refract.llm.common import LOWER, UPPER, content_keyed, keep_rows, read, releasing, text_slices
from refract.llm.components import connected_components
from refract.llm.vec import Words, distinct, mix, shingles
from refract.session import materialize

WORDS, PERCENT = 5, 75
#: Counters of the sketch of counts, and bits of the bitmap of classes.
SKETCH_BITS, BITMAP_BITS = 25, 24
#: Counters in one row while the sketch is summed, and steps of a summed
#: counter's scale to each doubling.
CHUNK, STEPS = 1 << 15, 8
#: A shingle with this many times the mean count of a counter is dealt over
#: parts of about so many rows.
ABOVE, PART_ROWS, MOST_PARTS = 32, 1 << 15, 1 << 15
#: Class names that two classes may share, at most.
MAX_SHARED = 1 << 20
RANGES = 16


def _sets(batch: pa.RecordBatch, words: Words, k: int):
    """Distinct (row, shingle) of a slice, with set sizes and the two halves of
    the set hashes."""
    n = batch.num_rows
    row, h = distinct(*shingles(*words.split(batch.column("text")), k))
    size = np.bincount(row, minlength=n).astype(np.int64)
    end, halves = np.cumsum(size), []
    with np.errstate(over="ignore"):
        for salt in (1, 0x9E3779B97F4A7C15):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)])
            halves.append(mix(total[end] - total[end - size] + size.astype(np.uint64)).view(np.int64))
    return row, h, size, *halves


def _names(low: np.ndarray, high: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The classes' names; ``shared``: lower halves of several classes."""
    return np.where(np.isin(low, shared), high, low) if len(shared) else low


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _scan(k: int):
    most = np.iinfo(np.uint16).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(1 << SKETCH_BITS, np.uint16)
        schema = None
        for b in text_slices(batches, "text"):
            _, h, size, low, high = _sets(b, words, k)
            at, n = np.unique(_bucket(h, SKETCH_BITS), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, most)          # of one task's documents
            none = pa.nulls(b.num_rows, pa.binary())
            out = pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("rid"), pa.array(size), pa.array(low), pa.array(high),
                 pa.nulls(b.num_rows, pa.int32()), none], ["id", "rid", "n", "low", "high", "chunk", "counts"])
            schema = out.schema
            yield out
        if schema is not None:
            parts = counts.reshape(-1, CHUNK)
            some = np.flatnonzero(parts.any(axis=1))
            none = [pa.nulls(len(some), schema.field(c).type) for c in ("id", "rid", "n", "low", "high")]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(some.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())],
                schema=schema)
    return releasing(run)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, blob in zip(b.column(0).to_pylist(), b.column(1)):
            part = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint16)
            if chunk in held:
                held[chunk] += part
            else:
                held[chunk] = part.astype(np.int64)
    steps = [np.minimum(np.rint(STEPS * np.log2(1.0 + x)), 255).astype(np.uint8) for x in held.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in steps], pa.binary()),
         pa.array([int(x.sum()) for x in held.values()], pa.int64())], ["chunk", "steps", "total"])


def parts_of(steps: np.ndarray, mean: float) -> np.ndarray:
    """Over how many parts a shingle's rows are dealt, by its counter."""
    count = np.exp2(np.arange(256) / STEPS)
    parts = np.where(count > ABOVE * max(mean, 1.0), np.ceil(count / PART_ROWS), 1)
    return np.minimum(parts, MOST_PARTS).astype(np.uint64)[steps]


def _prefixes(k: int, percent: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        counts, mean, shared = model.value
        for b in text_slices(batches, "text"):
            row, h, size, low, high = _sets(b, words, k)
            cls = _names(low, high, shared)
            # a class once for each partition
            first = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):
                if c not in seen:
                    seen.add(c)
                    first[i] = True
            keep = first[row]
            row, h = row[keep], h[keep]
            size = np.where(first, size, 0)
            df = counts[_bucket(h, SKETCH_BITS)]
            o = np.argsort(df, kind="stable")              # by hash already
            o = o[np.argsort(row[o], kind="stable")]
            row, h, df = row[o], h[o], df[o]
            pos = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            prefix = size - (percent * size + 99) // 100 + 1
            keep = pos < prefix[row]
            row, pos, h, df = row[keep], pos[keep], h[keep], df[keep]
            common = np.bincount(row, weights=df, minlength=len(size)) * 100 // np.maximum(prefix, 1)
            parts = parts_of(df, mean)
            with np.errstate(over="ignore"):
                salt = np.where(parts > 1, mix(h + cls[row].view(np.uint64)) % parts + np.uint64(1), np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(cls[row]), pa.array((size[row] << 32) + pos),
                 pa.array((salt.astype(np.int64) << 32) + common[row].astype(np.int64))], ["token", "cls", "np", "rank"])
    return releasing(run)


def _full_sets(k: int, bitmap, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, bits, shared = Words(), set(), bitmap.value, model.value[2]
        for b in text_slices(batches, "text"):
            row, h, size, low, high = _sets(b, words, k)
            cls = _names(low, high, shared)
            slot = cls.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
            hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            end = np.cumsum(size)
            out = []
            for i in np.flatnonzero((hit == 1) & (size > 0)).tolist():
                if (c := int(cls[i])) not in seen:
                    seen.add(c)
                    s = h[end[i] - size[i]:end[i]]
                    out.append((c, int(size[i]), np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=RANGES), s.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                 pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.list_(pa.int64()))],
                ["cls", "n", "ranges", "tokens"])
    return releasing(run)


def _model(scan: DataFrame):
    """(steps of the summed sketch, mean count of a counter, lower halves that
    several classes share), broadcast."""
    parts = (scan.where("chunk is not null").select("chunk", "counts")
             .repartition(64, "chunk").mapInArrow(_add_chunks, "chunk int, steps binary, total long"))
    counts, total = np.zeros(1 << SKETCH_BITS, np.uint8), 0
    for r in parts.toLocalIterator():              # 2 ** SKETCH_BITS bytes, whatever the data
        counts[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.steps), np.uint8)
        total += r.total
    # of D classes about D * D / 2 ** 64 share their lower half: 70 of 5e10
    shared = (scan.where("n > 0").groupBy("low").agg(F.min("high").alias("a"), F.max("high").alias("b")).where("a <> b")
              .select("low", "a", "b").limit(MAX_SHARED + 1).collect())
    if len(shared) > MAX_SHARED:
        raise RuntimeError(f"more than {MAX_SHARED} class names are shared")
    shared = np.array(sorted(r.low for r in shared), np.int64)
    return scan.sparkSession.sparkContext.broadcast((counts, total / len(counts), shared))


def _named(scan: DataFrame, model) -> DataFrame:
    """``scan``'s documents with their class's name."""
    shared = model.value[2].tolist()
    name = F.when(F.col("low").isin(shared), F.col("high")).otherwise(F.col("low")) if shared else F.col("low")
    return scan.where("chunk is null").select("id", "rid", "n", name.alias("cls"))


def _bitmap(spark, classes: DataFrame):
    """A fixed-size bitmap of class hashes, broadcast."""
    slot = F.shiftrightunsigned("cls", 64 - BITMAP_BITS)
    words = (classes.select(F.shiftright(slot, 6).alias("w"),
                            F.expr(f"shiftleft(1L, cast(shiftrightunsigned(cls, {64 - BITMAP_BITS}) & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    bits = np.zeros((1 << BITMAP_BITS) // 64, np.int64)
    for batch in words.toArrow().to_batches():     # at most 2 ** (BITMAP_BITS - 6) rows
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def _overlap(percent: int, a: str, b: str) -> str:
    """The least overlap of two linked sets of sizes ``a`` and ``b``, in SQL."""
    return f"((cast({percent} as bigint) * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _prefix_bound(percent: int, c: str = "c") -> str:
    """Length and prefix-overlap filters of a pair of sizes ``m <= n`` with at
    most ``c`` common prefix shingles, in SQL."""
    rest = lambda x: f"(({percent}L * {x} + 99) div 100 - 1)"
    return f"100L * m >= {percent}L * n and {c} + greatest({rest('m')}, {rest('n')}) >= {_overlap(percent, 'm', 'n')}"


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, model) -> DataFrame:
    """The pairs (a, b) that link; ``docs`` has the texts."""
    pairs = materialize(pairs, "pairs")
    if not pairs.take(1):
        return pairs
    bitmap = _bitmap(docs.sparkSession, pairs.select(F.explode(F.array("a", "b")).alias("cls")))
    sets = materialize(docs.mapInArrow(_full_sets(k, bitmap, model), "cls long, n int, ranges array<long>, tokens array<long>")
                       .dropDuplicates(["cls"]), "fullsets")
    side = lambda s: sets.select(F.col("cls").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "ranges", "tokens")])
    need = F.expr(_overlap(percent, "a_n", "b_n"))
    bound = F.aggregate(F.zip_with("a_ranges", "b_ranges", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(bound >= need)
                       .where(F.size(F.array_intersect("a_tokens", "b_tokens")) >= need).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None,
                       k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id``, ``rid`` (``key``, or a number made
    here), ``n_shingles``, ``component_id`` (smallest id reachable by links
    with 100 * intersection >= percent * union), ``kept`` (true for one row of
    each component, one with its smallest id)."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    spark = docs.sparkSession
    text = F.col(text_col).alias("text")
    d = docs.select(F.col(id_col).alias("id"),
                    (F.col(key) if key else F.monotonically_increasing_id()).alias("rid"), text)
    types = [f"{c} {d.schema[c].dataType.simpleString()}" for c in ("id", "rid")]
    scan = materialize(d.mapInArrow(_scan(k), f"{', '.join(types)}, n long, low long, high long, chunk int, counts binary"), "sets")
    model = _model(scan)
    of = _named(scan, model)

    texts = docs.select(text)
    t = texts.mapInArrow(_prefixes(k, percent, model), "token long, cls long, np long, rank long")
    t = t.withColumns({"salt": F.shiftright("rank", 32), "n": F.shiftright("np", 32)})
    # one row a class, of those that have a neighbour of a size that could
    # link, or rows in other parts
    part = Window.partitionBy("token", "salt")
    by_size = part.orderBy("np", "cls")
    t = t.withColumn("same", F.lag("cls").over(by_size)).where("same is null or same <> cls")
    t = t.withColumns({"before": F.lag("n").over(by_size), "after": F.lead("n").over(by_size)})
    t = t.where(f"salt > 0 or 100L * before >= {percent}L * n or 100L * n >= {percent}L * after")
    # pivots: the class whose prefix is the most common, one by hash, and the
    # one before
    one = F.struct("cls", "n")
    pivots = {"p0": F.max(F.struct(F.col("rank").alias("h"), "cls", "n")).over(part),
              "p1": F.max(F.struct(F.xxhash64("cls").alias("h"), "cls", "n")).over(part), "p2": F.lag(one).over(by_size)}
    t = t.withColumns(pivots).withColumns({p: F.struct(f"{p}.cls", f"{p}.n") for p in ("p0", "p1")})
    t = materialize(t.select("token", "cls", "n", F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"), *pivots), "prefixes")

    near = t.select("cls", "n", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("p"))
    near = near.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b"), F.least("n", "p.n").alias("m"),
                       F.greatest("n", "p.n").alias("n"), (F.col("p.cls") < F.col("cls")).cast("int").alias("d"))
    near = (near.where(f"a <> b and 100L * m >= {percent}L * n")
            .groupBy("a", "b").agg(F.greatest(F.sum("d"), F.sum(1 - F.col("d"))).alias("c"), F.min("m").alias("m"), F.min("n").alias("n"))
            .where(_prefix_bound(percent)).select("a", "b"))
    links = _verified(texts, near, k, percent, model)
    comp = connected_components(links, "a", "b")

    # all that share a prefix shingle and aren't in one component yet
    of_cls = t.groupBy("cls").agg(F.count(F.lit(1)).alias("s")).join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    left = t.select("token", "cls", "n", "pos").join(of_cls, "cls")
    left = materialize(left.withColumn("root", F.coalesce("root", "cls")), "rooted")
    mixed = left.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("token")
    left = left.join(mixed, "token", "left_semi")
    one = left.select("token", F.col("cls").alias("a"), F.col("n").alias("m"), F.col("pos").alias("a_pos"), F.col("s").alias("a_s"), F.col("root").alias("a_root"))
    two = left.select("token", F.col("cls").alias("b"), "n", "pos", "s", "root")
    rest = (one.join(two, "token").where("a_root <> root and (m < n or (m = n and a < b))")
            .where(_prefix_bound(percent, "least(a_s, s)")).where(f"least(m - a_pos, n - pos) >= {_overlap(percent, 'm', 'n')}")
            .select("a", "b").distinct())
    more = _verified(texts, rest, k, percent, model)
    if more.take(1):
        stars = comp.select(F.col("node").alias("a"), F.col("root").alias("b"))
        comp = connected_components(stars.unionByName(more), "a", "b")

    # classes without words stay apart: their rows are their own components
    of = of.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
        "id", "rid", "n", F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("root"))
    some = materialize(of.where("n > 0"), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("o"), F.col("id").alias("i"), F.col("rid").alias("r")))
    # stored, so that the join can split a root with very many rows
    low = materialize(some.groupBy("root").agg(first.alias("f"))
                      .select("root", F.col("f.i").alias("component_id"), F.col("f.r").alias("keep_rid")), "smallest")
    some = some.join(low, "root").select("id", "rid", F.col("n").alias("n_shingles"), "component_id",
                                         (F.col("rid") == F.col("keep_rid")).alias("kept"))
    return some.unionByName(scan.where("chunk is null and n = 0").select(
        "id", "rid", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns."""
    rows, key = content_keyed(docs, id_col, text_col)
    return keep_rows(rows, key, jaccard_components(rows, id_col, text_col, key).where("kept").select(F.col("rid").alias(key)))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM w),
y AS (SELECT doc_id, k, i, {" || ' ' || ".join(["t", *[f"lead(t, {j}) OVER o" for j in range(1, WORDS)]])} AS h FROM x
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT DISTINCT doc_id, h FROM y WHERE h IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {WORDS - 1}),
u AS (SELECT doc_id, h, count(*) OVER (PARTITION BY doc_id) AS n FROM v),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n
  FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (m + n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(any_value(u.n), 0)::BIGINT AS n_shingles, any_value(c.b) AS component_id
FROM w LEFT JOIN u USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) c ON c.a = w.doc_id GROUP BY w.doc_id"""


def query(spark, sf_dir: str) -> DataFrame:
    return (jaccard_components(read(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "n_shingles", "component_id"))
