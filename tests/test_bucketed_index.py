"""The bucketed index against a dictionary; what an upsert writes."""

import os
import random

import pytest

from refract.operators import bucketed_index as B
from refract.streaming import index_stream

SCHEMA = "index_name string, namespace string, id string, embedding array<double>, metadata struct<label:int>, batch_ord int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, v, label=0, ns="n", batch=0):
    return ("x", ns, i, [float(v), 1.0], (label,), batch)


def held(ix):
    rows = B.read(ix).collect()
    out = {(r.index_name, r.namespace, r.id): (r.embedding[0], r.metadata.label, r.batch_ord) for r in rows}
    assert len(out) == len(rows)
    return out


def sizes(base):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}


def test_upserts_like_a_dictionary(spark, tmp_path):
    r = random.Random(1)
    base, want = str(tmp_path / "ix"), {}
    ix = B.open_index(spark, base, frame(spark, []).schema, buckets=8)
    assert B.read(ix).collect() == [] and B.versions(spark, base) == []
    for step in range(6):
        rows = [row(r.choice([None, *map(str, range(60))]), r.random(), step, r.choice(["n", "m"]), r.randint(0, 2)) for _ in range(r.choice([0, 5, 40, 90]) if step else 70)]
        for x in sorted(enumerate(rows), key=lambda x: (x[1][5], x[0])):
            want[x[1][:3]] = (x[1][3][0], x[1][4][0], x[1][5])
        ix = B.upsert(ix, frame(spark, rows).coalesce(1))
        assert held(ix) == want and ix.version == B.versions(spark, base)[-1]
        if step in (2, 4):
            before = ix
            ix = B.compact(ix, 0.1)
            assert held(ix) == held(before) == want
            assert sum(x.n for x in ix.manifest if not x.base) <= 0.1 * sum(x.n for x in ix.manifest if x.base) + 1
            assert B.compact(ix, 0.1) == ix
    assert held(B.open_index(spark, base, ix.schema, buckets=8)) == want
    assert held(B.open_index(spark, base, ix.schema, 1, buckets=8)) != want               # old versions stay


def test_a_small_upsert_writes_little(spark, tmp_path):
    base, r = str(tmp_path / "ix"), random.Random(2)
    vec = lambda: [r.random() for _ in range(64)]
    ix = B.upsert(B.open_index(spark, base, frame(spark, []).schema), frame(spark, [("x", "n", str(i), vec(), (0,), 0) for i in range(20_000)]))
    before = sizes(base)
    ix = B.upsert(ix, frame(spark, [("x", "n", str(i * 100), vec(), (1,), 1) for i in range(200)]))
    after = sizes(base)
    assert all(after[f] == n for f, n in before.items())                                   # nothing is rewritten
    assert sum(n for f, n in after.items() if f not in before) < 0.05 * sum(before.values())
    got = held(ix)
    assert len(got) == 20_000 and sum(x[1] for x in got.values()) == 200
    assert B.compact(ix) == ix                                                             # one row in a hundred: not due
    ix = B.upsert(ix, frame(spark, [("x", "n", str(i), vec(), (2,), 1) for i in range(20_000) if B_of(spark, ix, i)]))
    done = B.compact(ix)
    rewritten = {x.bucket for x in done.manifest if x.commit == done.version}
    assert rewritten == {3} and held(done) == held(ix)


def B_of(spark, ix, i, cache={}):
    if not cache:
        df = spark.range(20_000).selectExpr("'x' AS index_name", "'n' AS namespace", "cast(id AS string) AS id")
        cache.update({int(x.id): x.bucket for x in df.select("id", B._bucket(ix.buckets)).collect()})
    return cache[i] == 3


def test_an_unfinished_commit_is_not_read_and_a_replay_is_the_same(spark, tmp_path):
    base = str(tmp_path / "ix")
    first, second = frame(spark, [row("a", 1), row("b", 2)]), frame(spark, [row("b", 3, batch=0), row("c", 4)])
    index_stream.upsert_bucketed(first, 0, base)
    ix = B.open_index(spark, base, first.schema)
    B._commit(ix, second.withColumn("_row", B.F.lit(0).cast("long")).select("*", B._bucket(ix.buckets)), False, 2)      # fails before its manifest
    assert {k[2]: v[0] for k, v in held(B.open_index(spark, base, first.schema)).items()} == {"a": 1.0, "b": 2.0}
    for _ in range(2):
        index_stream.upsert_bucketed(second, 1, base)
        assert {k[2]: v[0] for k, v in held(B.open_index(spark, base, first.schema)).items()} == {"a": 1.0, "b": 3.0, "c": 4.0}
    assert B.versions(spark, base) == [1, 2]


def test_a_stream_of_files(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "ix")
    frame(spark, [row("a", 1), row("b", 2)]).write.parquet(src)
    stream = spark.readStream.schema(frame(spark, []).schema).parquet(src)
    for new in ([], [row("b", 5), row("c", 6)]):
        if new:
            frame(spark, new).write.mode("append").parquet(src)
        q = index_stream.start_bucketed_upsert(stream, base, str(tmp_path / "cp"))
        assert q.awaitTermination(120) in (True, None)
    assert {k[2]: v[0] for k, v in held(B.open_index(spark, base, frame(spark, []).schema)).items()} == {"a": 1.0, "b": 5.0, "c": 6.0}


@pytest.mark.parametrize("name", ["index_bucketed_upsert"])
def test_registered(name):
    from refract.plans import catalog
    catalog.load_all()
    assert name in catalog.QUERIES and name in catalog.ORACLE
