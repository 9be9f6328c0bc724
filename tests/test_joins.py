"""Ground-truth joins and routed vectors on small tables, with odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quillmill.operators import joins
from quillmill.operators.retrieval import dense_top_k

from .conftest import rows_of


def test_page_runs(spark):
    hints = spark.createDataFrame([(1, "a", 7, 9), (2, "a", 3, 2), (3, None, 1, 1), (4, "b", 0, 40), (5, "a", None, 2)], "qid int, file string, first int, last int")
    chunks = spark.createDataFrame([("a", 7, "a7"), ("a", 8, "a8"), ("a", 10, "a10"), ("a", None, "none"), ("b", 0, "b0"), ("b", 40, "b40"), ("b", 41, "b41"), (None, 1, "x")], "source_file string, page_start int, chunk_id string")
    assert rows_of(joins.gt_page_match(hints, chunks)) == sorted([("a7", 1), ("a8", 1), ("b0", 4), ("b40", 4)], key=repr)


def test_titles(spark):
    hints = spark.createDataFrame([(1, "a", "RED widget of twenty signs and more"), (2, "a", "red"), (3, "a", ""), (4, "a", None), (5, "b", "red")], "qid int, file string, title string")
    chunks = spark.createDataFrame([("a", "A red Widget of twenty", "c1"), ("a", "Red", "c2"), ("a", None, "c3"), ("b", "green", "c4")], "source_file string, content string, chunk_id string")
    assert rows_of(joins.gt_section_match(hints, chunks)) == sorted([("c1", 1), ("c1", 2), ("c2", 2), ("c1", 3), ("c2", 3)], key=repr)
    assert joins.gt_section_match(hints.limit(0), chunks).count() == 0


def test_vectors_against_brute_force(spark):
    """Ties go by id, also where the k-th distance is shared, and over several batches."""
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.integers(-1, 2, 3)], f"b{i % 3}" if i % 10 else None) for i in range(400)]
    df = spark.createDataFrame(v, "chunk_id int, embedding array<float>, book_id string").repartition(3)
    queries = df.filter("chunk_id % 20 = 0 OR chunk_id % 20 = 7").withColumnRenamed("chunk_id", "qid")

    def near(q, by):
        unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
        own = [x for x in v if not by or (q[2] is not None and x[2] == q[2])]
        return sorted((round(1 - float(unit(q[1]) @ unit(x[1])), 6) + 0.0, x[0]) for x in own)[:7]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        for by in (None, "book_id"):
            got = dense_top_k(queries, df, 7, by=by).withColumn("distance", F.round("distance", 6) + 0.0).collect()
            want = {(q[0], c, d, r) for q in v if q[0] % 20 in (0, 7) for r, (d, c) in enumerate(near(q, by), 1)}
            assert {(r.qid, r.chunk_id, r.distance + 0.0, r["rank"]) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_truth_by_classes_equals_its_pairs(spark):
    from quillmill.operators import aggregates, joins, windows

    chunks = spark.createDataFrame([(i, i % 4 if i != 12 else None) for i in range(30)] + [(99, 9)], "chunk_id long, label int")
    asked = chunks.filter("chunk_id % 5 = 4 OR chunk_id = 12").withColumnRenamed("chunk_id", "qid")
    pairs = asked.join(chunks, "label").filter("qid <> chunk_id").select("qid", "chunk_id")
    rng = np.random.default_rng(3)
    ranked = [(int(q), int(c), r + 1, p) for q in (4, 9, 12, 14, 99) for p in "ab" for r, c in enumerate(rng.permutation(30)[:6])]
    ranked = spark.createDataFrame(ranked, "qid long, chunk_id long, rank int, pool string")
    some, sizes = joins.truth_among(ranked, asked, chunks, "label"), joins.truth_sizes(asked, chunks, "label")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sizes) == rows(pairs.groupBy("qid").count()) and some.count() < pairs.count()
    assert rows(joins.hits(some, ranked, 3, sizes)) == rows(joins.hits(pairs, ranked, 3))
    assert rows(aggregates.recall_at_depths(some, ranked, sizes=sizes)) == rows(aggregates.recall_at_depths(pairs, ranked))
    assert rows(windows.pool_overlap(some, ranked, 4, sizes)) == rows(windows.pool_overlap(pairs, ranked, 4))
    assert rows(windows.rank_of_truth(some, ranked)) == rows(windows.rank_of_truth(pairs, ranked))
