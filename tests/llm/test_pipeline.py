"""The pipeline and the registered queries of the folder."""

import math
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as entry
from refract.llm import exact_dedup, mixing, ngram_join, queries, toxicity
from refract.session import materialize

from test_pairs import shingle_set, union_find

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in cur.fetchall())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen, frames = [docs], {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, seen[-1], SF), "test")
        frames[name] = out
        if name != "best-fit packing":
            assert out.columns == docs.columns
        seen.append(out)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    # toxicity: exactly the rows that score below the threshold
    score = {r.id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    left = sorted(i for i, s in score.items() if s < toxicity.THRESHOLD)
    assert ids(seen[1]) == left
    # exact copies: the largest id of each lower-cased text
    text = {r.doc_id: r.text for r in seen[1].collect()}
    best = {}
    for i, t in sorted(text.items()):
        best[t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))] = i
    assert ids(seen[2]) == sorted(best.values())
    # near copies: the smallest id of each group
    text = {r.doc_id: shingle_set(r.text) for r in seen[2].collect()}
    pairs = [(a, b) for a in text for b in text if a < b and text[a] and 100 * len(text[a] & text[b]) >= 75 * len(text[a] | text[b])]
    root = union_find(text, pairs)
    assert ids(seen[3]) == sorted(i for i in root if root[i] == i)
    # mixing: each document as often as its rate says
    domains, m = mixing.members(seen[3], mixing.labelled_rows(seen[3], labels), seen[3].lang)
    copies = {r.id: r.copies for r in mixing.fit_rates(m, domains)[0].collect()}
    assert Counter(ids(seen[4])) == Counter({i: n for i, n in copies.items() if n})
    # packing: every document whole, no gaps, nearly no waste
    rows = seen[5].collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(ids(seen[4]))
    used = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert used[r.sequence_id] == r.offset
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= math.ceil(sum(used.values()) / 4096) + 2


def folder(spark, path, docs, labels, extra=""):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + extra
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, None, None), (None, 0, 1), (3, 0, 1), (3, 0, 0)]])
def test_pipeline_on_odd_rows(spark, tmp_path, labels):
    long = " ".join(f"w{i}" for i in range(3000))
    texts = [(1, "One text of some words that is kept here."), (2, "ONE text of some words that is kept here."), (3, None), (4, ""), (None, "no id but a text of its own"),
             (5, long), (6, long + " more"), (7, "b \t\n"), (8, "again and again"), (8, "again and again"), (None, None)]
    docs = [(i, t, None if k % 3 else "en", "s", None, "x", 1) for k, (i, t) in enumerate(texts)]
    out = corpus_pipeline.run(spark, folder(spark, tmp_path / "odd", docs, labels, ", rid string, _key int"))
    rows = out.collect()
    got = Counter(r.doc_id for r in rows if r.piece == 0)
    assert set(got) <= {2, 4, None, 5, 7, 8} and {2, 5, 8} <= set(got)                   # copies gone, nothing else
    assert "text" not in out.columns and all(0 < r.length <= 4096 for r in rows)


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [], [])).collect() == []


def test_packing_remembers_the_frequent_words_and_stays_right(monkeypatch):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from refract.llm import packing
    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    packing.worker_cache("words").clear()
    plain, enc, r = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path()), random.Random(1)
    word = lambda: "".join(r.choice(["a", "Bc", "é", "don't", "x.y", "漢", "3", ",", "ß", "'s", "Ünï"]) for _ in range(r.randint(1, 3)))
    for _ in range(200):
        texts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(5)] + [None, ""]
        assert [x.tolist() for x in enc.encode(pa.array(texts, pa.string()))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(enc.held["words"]) <= 300 + 150
