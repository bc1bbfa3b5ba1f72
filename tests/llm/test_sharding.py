"""The weighted hash tree: against plain Python, movement, slots, odd input."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from refract.llm import sharding
from refract.llm.sharding import Shard

SCHEMA = "doc_id long, text string, shard int, rid string, size string, position long"


def plain_place(key, tree):
    """The draws of a key, level by level, in plain Python."""
    at, node = sharding.children(tree), sharding.ROOT
    path = []
    while node in at:
        def draw(c):
            u = (int(hashlib.md5(f"{c[0]}:{key}".encode()).hexdigest()[:13], 16) + 1) / 16 ** 13
            return -math.log(u) / c[1]
        node = min(at[node], key=draw)[0]
        path.append(int(node.split()[1]))
    return tuple(path)


def placed(spark, tree, n=4000):
    rows = spark.range(n).select("id", sharding.place(F.col("id"), tree).alias("p")).collect()
    return {r.id: tuple(r.p) for r in rows}


TREE = [Shard(0, 0, 0, 1.0), Shard(0, 0, 1, 3.0), Shard(0, 1, 2, 2.0), Shard(1, 2, 3, 2.0), Shard(1, 3, 4, 1.0), Shard(1, 3, 5, 0.0)]


def test_place_is_the_plain_descent_and_follows_weights(spark):
    got = placed(spark, TREE)
    assert got == {i: plain_place(i, TREE) for i in got}
    n = Counter(p[2] for p in got.values())
    assert set(n) == {0, 1, 2, 3, 4}
    for s in TREE[:5]:
        want = 4000 * s.weight / 9
        assert abs(n[s.shard] - want) < 5 * math.sqrt(want)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (40, 41, 47):
        old, new = placed(spark, sharding.layout(n)), placed(spark, sharding.layout(n + 1))
        moved = [i for i in old if old[i] != new[i]]
        assert moved and {new[i][2] for i in moved} == {n}
        assert abs(len(moved) - 4000 / (n + 1)) < 5 * math.sqrt(4000 / n)


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    old = placed(spark, TREE)
    new = placed(spark, [s._replace(weight=6.0) if s.shard == 1 else s for s in TREE])
    moved = [i for i in old if old[i] != new[i]]
    assert moved and {new[i][0] for i in moved} == {0}                         # only into the heavier region
    inside = [i for i in moved if old[i][0] == 0]
    assert inside and {new[i][1] for i in inside} == {0}                       # there only into the heavier rack
    assert {new[i][2] for i in inside if old[i][1] == 0} == {1}                # and there only into the shard
    gone = placed(spark, [s._replace(weight=0.0) if s.shard == 1 else s for s in TREE])
    assert all(old[i] == gone[i] for i in old if old[i][0] == 1 and gone[i][0] == 1)


def test_bad_trees():
    for tree in ([Shard(0, 0, 0, -1.0)], [Shard(0, 0, 0), Shard(1, 1, 0)], [Shard(0, 0, 0, 0.0)], []):
        with pytest.raises(ValueError):
            sharding.children(tree)
    with pytest.raises(ValueError):
        sharding.layout(0)


def test_odd_rows_and_slots(spark):
    rows = [(1, "a", None, None, None, None), (1, "a", None, None, None, None), (None, "ß", 7, "x", "y", 1), (2, None, None, None, None, None),
            (3, "", None, None, None, None), (None, None, None, None, None, None)] + [(5, "same", 1, "", "", 2)] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.assign(df, sharding.layout(7, 4, 1, 2), sharding.layout(8, 4, 1, 2)).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        text = {1: "a", 2: "", 3: "", 5: "same"}.get(r.id)
        if text is not None:
            assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
        assert (r.region, r.rack, r.shard) == plain_place("" if r.id is None else r.id, sharding.layout(7, 4, 1, 2))
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.id == 5}) == 1
    assert sharding.assign(df.limit(0), sharding.layout(3)).collect() == []
    assert {r.grown_shard for r in sharding.assign(df, sharding.layout(3)).collect()} == {None}


def test_equal_texts_stay_together_with_a_key_of_the_text(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", None, None, None, None) for i in range(70)], SCHEMA)
    got = sharding.assign(df, sharding.layout(40), key=F.sha2(F.col("text").cast("binary"), 256)).collect()
    where = defaultdict(set)
    for r in got:
        where[r.id % 7].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, sharding.layout(5, 5, 1, 5), str(tmp_path / "out"), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, f"text {i}") for i in range(200)} and len(back) == 200
    assert all(r.shard == plain_place(r.doc_id, sharding.layout(5, 5, 1, 5))[2] for r in back)
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("shard", F.lit(1)), sharding.layout(2), str(tmp_path / "no"))
