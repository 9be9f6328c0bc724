"""Stored indexes, codes, order statistics and pages of histories against plain versions."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import lexical_index, retrieval, windows
from quillmill.operators.order_statistics import order_statistics

WORDS = [f"w{k}" for k in range(60)]


def chunks(spark, ids, rnd):
    rows = [(k, " ".join(rnd.choice(WORDS[: rnd.choice([5, 60])]) for _ in range(rnd.choice([2, 10, 40])))) for k in ids]
    return spark.createDataFrame([*rows, (10_000 + ids[0], None), (20_000 + ids[0], "")], "chunk_id long, text string")


def top(df):
    return sorted((r["qid"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 8)
    rnd = random.Random(1)
    a, b = chunks(spark, range(400), rnd), chunks(spark, range(400, 520), rnd)
    lexical_index.append_to_index(a, str(tmp_path), "a")
    return a, b, str(tmp_path)


def test_stored_index_equals_the_scan(spark, index):
    a, b, path = index
    q = spark.createDataFrame([(1, "w1 w50 w59"), (2, "w3"), (3, "nothing here"), (4, None), (5, " ".join(WORDS))], "qid long, text string")
    assert top(lexical_index.indexed_top_k(spark, path, q, 10)) == top(retrieval.lexical_top_k(q, a, 10))
    before = {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    lexical_index.append_to_index(b, path, "b")
    after = {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert before.items() <= after.items()
    both = top(retrieval.lexical_top_k(q, a.union(b), 10))
    assert top(lexical_index.indexed_top_k(spark, path, q, 10)) == both
    lexical_index.append_to_index(b, path, "b")  # the same batch replaces itself
    assert top(lexical_index.indexed_top_k(spark, path, q, 10)) == both


def test_only_blocks_that_can_win_are_read(spark, index):
    a, _, path = index
    q = spark.createDataFrame([(1, "w55"), (2, "w1"), (3, "w40 w41")], "qid long, text string")
    search = lexical_index.Search(spark, path, q, 3)
    assert top(search.top()) == top(retrieval.lexical_top_k(q, a, 3))
    assert search.read.count() < 0.4 * search.heads.count()
    least = search.needs.collect()
    bounds = {r.term: r.need for r in least}
    assert all(h.bound >= bounds[h.term] for h in search.read.collect())


def test_empty_index(spark, tmp_path):
    lexical_index.append_to_index(spark.createDataFrame([], "chunk_id long, text string"), str(tmp_path), 0)
    q = spark.createDataFrame([(1, "w1")], "qid long, text string")
    assert lexical_index.indexed_top_k(spark, str(tmp_path), q, 3).collect() == []


def test_codes_miss_nothing_and_spare_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3000, 32))
    m[5], m[6], m[7] = m[4], m[4] * 3, 0
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(9999, None)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(6)
    q = v.filter("chunk_id % 100 = 4 OR chunk_id = 7").withColumnRenamed("chunk_id", "qid")
    retrieval.vector_codes(v).write.parquet(f"{tmp_path}/codes")
    codes = spark.read.parquet(f"{tmp_path}/codes")
    rows = lambda df: sorted((r["qid"], r["rank"], r["chunk_id"], round(r["distance"], 8)) for r in df.collect())
    plain = q.filter("qid <> 7")
    assert rows(retrieval.coded_top_k(plain, codes, v, 10)) == rows(retrieval.dense_top_k(plain, v, 10, most=None))
    assert retrieval.coded_candidates(plain, codes, 10).count() < 0.05 * plain.count() * 3000
    zero = q.filter("qid = 7")  # all are as far from it
    assert rows(retrieval.coded_top_k(zero, codes, v, 10)) == rows(retrieval.dense_top_k(zero, v, 10, most=None))
    assert retrieval.coded_top_k(q.limit(0), codes, v, 10).collect() == []


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(300)], "chunk_id long, embedding array<double>")
    q = v.filter("chunk_id < 50").withColumnRenamed("chunk_id", "qid")
    whole = sorted(map(tuple, retrieval.dense_top_k(q, v, 4).collect()))
    codes = retrieval.vector_codes(v).cache()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    cut = retrieval.dense_top_k(q, v, 4)
    assert sorted(map(tuple, cut.collect())) == whole == sorted(map(tuple, retrieval.coded_top_k(q, codes, v, 4).select(cut.columns).collect()))
    assert "MapInPandas" not in cut._jdf.queryExecution().executedPlan().toString()  # written block by block


def test_order_statistics(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), rnd.choice([0.5, 0.5, rnd.random(), None])) for _ in range(3000)] + [("one", 7.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    at = spark.createDataFrame([(g, p) for g in ("a", "b", "c", "one", "no") for p in (0, 1, 400, 700, 5000)], "g string, place long")
    want = set()
    for g in ("a", "b", "c", "one"):
        values = sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v or 0))
        want |= {(g, p, values[p]) for p in (0, 1, 400, 700, 5000) if p < len(values)}
    assert {tuple(r) for r in order_statistics(df, "g", "v", at).collect()} == want


def test_histories_from_pages(spark):
    turns = spark.createDataFrame([(c, t, "user", f"{c}-{t}") for c, n in ((1, 11), (2, 1), (3, 4)) for t in range(n)], "conv_id long, turn long, role string, text string")
    pages = windows.conversation_pages(turns, 4)
    assert pages.agg(F.sum(F.size("turns"))).first()[0] == turns.count() and pages.agg(F.max(F.size("turns"))).first()[0] == 4
    got = {(r.conv_id, r.turn): [tuple(t) for t in r.history] for r in windows.history_of(windows.prefix_lengths(turns), pages).collect()}
    assert got == {(r.conv_id, r.turn): [tuple(t) for t in r.history] for r in windows.history_before(turns).collect()}
