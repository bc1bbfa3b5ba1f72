"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds; between rounds the edges are
stored in the shared checkpoint folder.  Each partition is first contracted by
itself (a union-find over its own edges), which changes no component and makes
long paths short.  Nothing is collected but one row that says whether a round
more is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refract.session import materialize

EDGE = "node long, root long"


def forest(edges) -> dict[int, int]:
    """node -> smallest node of its component, over an iterable of pairs."""
    parent: dict[int, int] = {}

    def find(x):
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())
    found = [(n, r) for n, r in forest(pairs()).items() if n != r]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                      pa.array([x[1] for x in found], pa.int64())], ["node", "root"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is
    the smallest node of its component.  Loops and repeated edges are fine;
    rows with a null end are ignored; no edges give no rows."""
    e = (edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
         .where("x is not null and y is not null and x <> y")
         .select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("root")))
    while True:
        e = e.mapInArrow(_contract, EDGE)
        both = e.unionByName(e.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("m"))
        large = (both.join(low, "node").where("root > node")
                 .select(F.col("root").alias("node"), F.least("m", "node").alias("root")))
        e = materialize(large.distinct(), "cc")
        low = e.groupBy("node").agg(F.min("root").alias("m"))
        small = e.join(low, "node")
        e = materialize(
            small.where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
            .unionByName(small.select("node", F.col("m").alias("root"))).distinct(), "cc")
        # done when no node has two roots and no root is a node itself
        seen = (e.select("node", F.lit(1).alias("n"), F.lit(0).alias("r"))
                .unionByName(e.select(F.col("root").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("r"))))
        open_ = seen.groupBy("node").agg(F.sum("n").alias("n"), F.max("r").alias("r")).where("n > 1 or (n > 0 and r > 0)")
        if not open_.take(1):
            return e
