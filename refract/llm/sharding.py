"""Sharding by a hierarchical weighted hash tree.

A shard lies in a rack, a rack in a region; a node weighs what its shards
weigh together.  A row's key descends from the root: at each level every child
draws ``-ln(u) / weight``, with ``u`` from a hash of key and child, and the
least draw wins, so that a child gets keys in proportion to its weight.  Draws
of children whose weights stay the same don't change: raising a weight moves
rows only into the subtrees that hold it, at each level, and a new child moves
rows only into itself.  A tree of ``BASE`` shards is fixed; each shard beyond is
a region of its own, so one more shard takes rows only into itself, whatever
their number.

All of it is column expressions; the tree is a literal, as large as the number
of shards.  Slots (gapless places in a shard) come from one range sort of narrow
rows (shard, id, row number): it cuts a shard, and also an id with very many
rows, over many tasks.

Defined results: the key alone decides, so equal ids share a shard and equal
texts of different ids need not (give ``key`` a digest of the text for that); a
null id is the key ''; a null text has no bytes and the crc32 of none; repeated
rows each have a slot of their own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refract.llm.common import fresh, read
from refract.session import materialize
from refract.sources.tables import index_rows

SHARDS = 40
#: Shards of the fixed tree, a region's racks, and a rack's shards.
BASE, RACKS, RACK = 40, 4, 5
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Bits of a draw: hexadecimal digits of the hash, and what a double holds.
DIGITS = 13
ROOT = "/"


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = BASE, racks: int = RACKS, rack: int = RACK) -> list[Shard]:
    """Shards 0 to ``shards - 1`` of weight 1: the first ``base`` in order over
    racks and regions, each further one in a region of its own."""
    if shards < 1:
        raise ValueError("a tree has one shard or more")
    regions = -(-base // (racks * rack))
    return [Shard(i // (racks * rack), i // rack, i) if i < base else
            Shard(regions + i - base, regions * racks + i - base, i) for i in range(shards)]


def children(tree: Iterable[Shard]) -> dict[str, list[tuple[str, float]]]:
    """parent -> (child, weight) of the three levels, in order; nodes without
    weight are left out."""
    found: dict[str, dict[str, float]] = {}
    shards: set[int] = set()
    for s in tree:
        if s.weight < 0 or s.shard in shards:
            raise ValueError(f"a shard stands twice or weighs less than nothing: {s}")
        shards.add(s.shard)
        if s.weight:
            path = [ROOT, f"region {s.region}", f"rack {s.rack}", f"shard {s.shard}"]
            for up, down in zip(path, path[1:]):
                level = found.setdefault(up, {})
                level[down] = level.get(down, 0.0) + s.weight
    if ROOT not in found:
        raise ValueError("no shard has any weight")
    return {up: sorted(level.items()) for up, level in found.items()}


def draw(key: Column, node: Column, weight: Column) -> Column:
    """A child's draw: exponential, with the weight as its rate."""
    u = F.conv(F.substring(F.md5(F.concat(node, F.lit(":"), key).cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return -F.log((u + 1) / F.lit(float(16 ** DIGITS))) / weight


def place(key: Column, tree: Iterable[Shard]) -> Column:
    """struct<region, rack, shard> of a key."""
    level = {up: F.array(*[F.struct(F.lit(c).alias("node"), F.lit(float(w)).alias("weight")) for c, w in down])
             for up, down in children(tree).items()}
    key = F.coalesce(key.cast("string"), F.lit(""))

    def step(options: Column) -> Column:
        return F.array_min(F.transform(options, lambda c: F.struct(draw(key, c["node"], c["weight"]).alias("d"), c["node"].alias("node"))))["node"]

    def below(node: Column, kind: str) -> Column:
        pairs = [x for up, down in level.items() if up.startswith(kind) for x in (F.lit(up), down)]
        return F.element_at(F.create_map(*pairs), node)

    # each level in an array of one, so that its result is computed once
    def then(node: Column, f) -> Column:
        return F.transform(F.array(node), f)[0]

    def number(node: Column) -> Column:
        return F.element_at(F.split(node, " "), 2).cast("int")

    return then(step(level[ROOT]), lambda region: then(
        step(below(region, "region ")), lambda rack: F.struct(
            number(region).alias("region"), number(rack).alias("rack"), number(step(below(rack, "rack "))).alias("shard"))))


def assign(docs: DataFrame, tree: Iterable[Shard], grown: Iterable[Shard] | None = None, id_col: str = "doc_id",
           text_col: str = "text", key: Column | None = None) -> DataFrame:
    """One row per input row: ``id``, ``size`` (bytes), ``text_crc32``,
    ``region``, ``rack``, ``shard``, ``slot``, ``grown_shard`` (the shard in the
    tree ``grown``; null without one).  ``key``: what decides; the id if none."""
    tree = list(tree)
    key = F.col(id_col) if key is None else key
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), place(key, tree).alias("at"),
        (place(key, grown)["shard"] if grown is not None else F.lit(None).cast("int")).alias("grown_shard"))
    rows = materialize(rows.select("id", "size", "text_crc32", "at.region", "at.rack", "at.shard", "grown_shard",
                                   F.monotonically_increasing_id().alias("rid")), "shards")
    placed = index_rows(rows, ["shard", "id", "rid"], "position")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))          # as many rows as there are shards
    return placed.join(F.broadcast(first), "shard").select(
        "id", "size", "text_crc32", "region", "rack", "shard", (F.col("position") - F.col("first")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, tree: Iterable[Shard], path: str, id_col: str = "doc_id", rows_per_file: int = 1 << 18) -> None:
    """``docs`` as Parquet with a folder for each shard (``shard=N``).  A
    shard's rows are dealt over files of about ``rows_per_file`` rows."""
    tree = list(tree)
    if fresh(docs, "shard") != "shard":
        raise ValueError("docs has a column named shard")
    part = fresh(docs, "_part")
    files = max(1, -(-docs.count() // (rows_per_file * len(tree))))
    rows = docs.withColumns({"shard": place(F.col(id_col), tree)["shard"], part: F.pmod(F.xxhash64(*docs.columns), F.lit(files))})
    rows.repartition("shard", part).drop(part).write.partitionBy("shard").parquet(path)


def _sql(name: str, tree: list[Shard]) -> str:
    """CTEs of DuckDB that give ``{name}(doc_id, region, rack, shard)``."""
    nodes = ", ".join(f"('{up}', '{c}', {w!r})" for up, down in children(tree).items() for c, w in down)
    u = f"('0x' || substr(md5(child || ':' || doc_id), 1, {DIGITS}))::BIGINT::DOUBLE"
    least = f"arg_min(child, -ln(({u} + 1) / {float(16 ** DIGITS)!r}) / weight)"
    number = "split_part({}, ' ', 2)::INT"
    return f"""{name}_n(parent, child, weight) AS (VALUES {nodes}),
{name}_1 AS (SELECT doc_id, {least} AS region FROM documents JOIN {name}_n ON parent = '{ROOT}' GROUP BY doc_id),
{name}_2 AS (SELECT doc_id, any_value(region) AS region, {least} AS rack FROM {name}_1 JOIN {name}_n ON parent = region GROUP BY doc_id),
{name}_3 AS (SELECT doc_id, any_value(region) AS region, any_value(rack) AS rack, {least} AS shard FROM {name}_2 JOIN {name}_n ON parent = rack
  GROUP BY doc_id),
{name} AS (SELECT doc_id, {number.format('region')} AS region, {number.format('rack')} AS rack, {number.format('shard')} AS shard FROM {name}_3)"""


#: DuckDB has no crc32; its table of 256 entries follows from the polynomial.
_CRC = """crc_t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
crc AS (SELECT doc_id, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(h, '..'),
  lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), crc_t)"""

ORACLE = f"""
WITH {_sql('now', layout(SHARDS))},
{_sql('more', layout(SHARDS + 1))},
{_CRC}
SELECT d.doc_id, strlen(coalesce(d.text, '')) + {ROW_BYTES} AS size, crc.text_crc32, 'key' AS law, now.shard,
       row_number() OVER (PARTITION BY now.shard ORDER BY d.doc_id) - 1 AS slot, more.shard AS grown_shard, now.region, now.rack
FROM documents d JOIN now USING (doc_id) JOIN more USING (doc_id) JOIN crc USING (doc_id)"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return assign(docs, layout(SHARDS), layout(SHARDS + 1)).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
