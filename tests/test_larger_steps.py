"""Steps whose work or memory must not grow with one key, one batch or one task."""

import numpy as np
import pyarrow as pa

from quillmill import registry
from quillmill.operators import elements, html, joins, lexical_index, retrieval, tokens, windows
from quillmill.operators.retrieval import lexical_top_k
from quillmill.plans import ingest

from .conftest import SF, rows_of


def test_tokens_are_counted_in_portions(monkeypatch):
    monkeypatch.setattr(tokens, "BYTES", 10)
    seen = []
    texts = ["abcd", "efgh", "ij", "k", "x" * 30, "", "é" * 5, "l"]
    assert tokens.in_portions(pa.array(texts), lambda some: seen.append(some) or [len(t) for t in some]) == [len(t) for t in texts]
    assert all(len(some) == 1 or sum(len(t.encode()) for t in some) <= 10 for some in seen) and max(map(len, seen)) > 1
    assert sum(seen, []) == texts and tokens.in_portions(pa.array([], pa.string()), len) == []


def test_many_hints_of_one_title_stay_where_they_are(spark):
    hints = spark.createDataFrame([(k, "a", "Red Widget") for k in range(50)] + [(90, "b", ""), (91, "c", "no")], "qid int, file string, title string")
    chunks = spark.createDataFrame([("a", "a red widget", "1"), ("a", "blue", "2"), ("b", "red widget", "3"), ("d", "red widget", "4"), ("a", None, "5")], "source_file string, content string, chunk_id string")
    found = joins.gt_section_match(hints, chunks)
    assert rows_of(found, ["qid", "chunk_id"]) == sorted([("1", k) for k in range(50)] + [("3", 90)], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "strategy=merge" not in plan


def test_pairs_of_pages_need_no_distinct(spark):
    """Repetitions go before the join; pairs come once although hints overlap, chunks are copied and ids stand in several places."""
    hints = [(q, f, float(a), float(a + n)) for q in range(12) for f, a, n in ((f"f{q % 3}", q, 9), (f"f{q % 3}", q + 2, 0.5 * q), ("f1", -3, q), ("f1", -3, q), ("f2", q + 0.3, 0.4), (None, 1, 2), ("f0", 5, -2))]
    chunks = [(f"f{k % 3}", k % 25 - 5, f"c{k % 40}") for k in range(150)] + [("f1", 4, None), ("f2", 4, None), ("f1", None, "x"), (None, 4, "y"), ("f1", 4, "one"), ("f1", 4, "one")]
    found = joins.gt_page_match(spark.createDataFrame(hints, "qid int, file string, first double, last double"), spark.createDataFrame(chunks, "source_file string, page_start int, chunk_id string"))
    want = {(c, q) for q, f, a, b in hints for g, p, c in chunks if f and f == g and p is not None and a <= p <= b}
    assert rows_of(found) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_pages_of_a_small_table_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(html, "PAGES_OF_A_TASK", 20)
    assert registry.queries()["s04_nested_pages"](spark, SF).rdd.getNumPartitions() == 10


def test_tasks_of_an_index_grow_with_its_words(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lexical_index, "WORDS_OF_A_TASK", 4)
    chunks = spark.createDataFrame([(k, f"one w{k} three w{k % 3} one") for k in range(12)] + [(20, None)], "chunk_id int, text string")
    lexical_index.append_to_index(chunks, f"{tmp_path}/i", 0)
    assert len(list((tmp_path / "i/blocks/batch=0").glob("*.parquet"))) > 4
    asked = spark.createDataFrame([(1, "one w2"), (2, "w1 three")], "qid int, text string")
    assert rows_of(lexical_index.indexed_top_k(spark, f"{tmp_path}/i", asked, 5)) == rows_of(lexical_top_k(asked, chunks, 5))


def test_a_chunk_has_its_postings_in_one_shard(spark, monkeypatch, tmp_path):
    """No posting is shuffled when an index is written; a search goes shard by shard, in portions, with queries in blocks."""
    monkeypatch.setattr(lexical_index, "WORDS_OF_A_TASK", 20)
    texts = [" ".join(f"w{k * j % 17}" for j in range(k % 13)) or None for k in range(90)] + ["w1 " * 70, "", " -Ä1 w1,ß "]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    lexical_index.append_to_index(chunks, f"{tmp_path}/i", 0)
    rows = spark.read.parquet(f"{tmp_path}/i/blocks").collect()
    of = {(i, r.batch, r.shard) for r in rows if r.term for i in r.ids}
    assert len(of) == sum(1 for t in texts if t) and len({s for _, _, s in of}) > 5
    sizes = [r for r in rows if r.term is None]
    words = len(" ".join(t or "" for t in texts).replace("w1,ß", "w1 ß").split())
    assert (sum(r.chunks for r in sizes), sum(r.words for r in sizes)) == (len(texts), words) and all(r.words <= 40 or r.chunks == 1 for r in sizes)
    asked = spark.createDataFrame([(k, f"w{k % 17} w{k % 5} ß") for k in range(9)], "qid int, text string")
    want = rows_of(lexical_top_k(asked, chunks, 5))
    assert rows_of(lexical_index.indexed_top_k(spark, f"{tmp_path}/i", asked, 5)) == want
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 2)
    assert rows_of(lexical_index.indexed_top_k(spark, f"{tmp_path}/i", asked, 5)) == want


def test_scores_of_a_shard_come_in_portions(monkeypatch):
    queries = retrieval.TermBlock([(7, "", [("a", 1, 2), ("b", 1, 3)]), (8, "", [("b", 1, 3)])], {"": (6, 2.0)})
    shard = pa.table({"shard": [1, 1, 1], "term": ["a", "b", "c"], "ids": [["x", "y"], ["z", "y", "v"], ["x"]], "tfs": pa.array([[1, 2], [1, 1, 3], [1]], pa.list_(pa.int32())), "lens": pa.array([[2, 3], [1, 3, 3], [2]], pa.list_(pa.int32()))})
    whole = [(n.tolist(), s) for n, s in lexical_index.shard_scores(shard, queries, 2.0)]
    monkeypatch.setattr(lexical_index, "PRODUCTS", 1)
    cut = [(n.tolist(), s) for n, s in lexical_index.shard_scores(shard, queries, 2.0)]
    assert len(whole) == 1 and len(cut) == 4 and sum((n for n, _ in cut), []) == whole[0][0]
    idf = lambda df: np.log(1 + (6 - df + 0.5) / (df + 0.5))
    weight = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2))
    scores = {n: s[:, 0].tolist() for (n,), s in cut}
    assert np.allclose(scores["y"], [idf(2) * weight(2, 3) + idf(3) * weight(1, 3), idf(3) * weight(1, 3)]) and np.allclose(scores["x"], [idf(2) * weight(1, 2), 0])
    assert all(np.allclose(whole[0][1][:, k], s[:, 0]) for k, (_, s) in enumerate(cut))


def test_only_names_that_several_have_pass_a_window(spark, tmp_path):
    plain = [("b", f"f{k}.pdf", f"{k}") for k in range(40)]
    files = spark.createDataFrame([*plain, ("b", "f1.pdf", "x"), ("b", "f1(1).pdf", "y"), ("c", "f1.pdf", "z"), ("b", "g", "1"), ("b", "old.pdf", "2")], "book_id string, filename string, arrival string")
    manifest = spark.createDataFrame([("b", "s", "old.pdf"), ("b", "t", "old(1).pdf"), ("c", "u", "g")], "book_id string, sha256 string, source_file string")
    found = windows.resolve_source_names(files, manifest, f"{tmp_path}/names")
    assert rows_of(spark.read.parquet(f"{tmp_path}/names")) == [("b", "f1.pdf"), ("b", "old.pdf")]
    want = [(a, b, f, f) for b, f, a in plain] + [("x", "b", "f1.pdf", "f1(2).pdf"), ("y", "b", "f1(1).pdf", "f1(1).pdf"), ("z", "c", "f1.pdf", "f1.pdf"), ("1", "b", "g", "g"), ("2", "b", "old.pdf", "old(2).pdf")]
    assert rows_of(found) == sorted(want, key=repr)


def test_elements_of_pages_need_no_shuffle(spark):
    pages = spark.createDataFrame([("k", p, f"# a{p}\n\nb\n\n```\nc\n\nd\n```") for p in (2, 1, 11)] + [("l", 1, "x"), ("l", 2, "")], "key string, page_num int, content string")
    dense, gaps = (elements.markdown_elements(pages, "key", dense=d) for d in (True, False))
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    order = lambda df: [(r.key, r.type, r.content, r.page_num) for r in sorted(df.collect(), key=lambda r: (r.key, r.elem_idx))]
    assert order(dense) == order(gaps) and len({(r.key, r.elem_idx) for r in gaps.collect()}) == gaps.count() == 10


def test_a_batch_keeps_one_step_at_a_time(spark, tmp_path, monkeypatch):
    """Tables that a step has used are gone before the next one shuffles; portions give what one pass gives."""
    seen, files = {}, spark.createDataFrame([(f"b{k % 3}", f"{k % 50}.pdf", f"{ingest.PAGE}# Title {k}\n\nText {k}.\n\n# More\n\n|a|\n|---|\n|{k}|{ingest.PAGE}End of {k}.") for k in range(60)], "book_id string, filename string, markdown string")

    def spied(name):
        f = getattr(ingest, name)
        monkeypatch.setattr(ingest, name, lambda *a, **k: seen.setdefault(name, []).append({p.name for p in tmp_path.glob("cut/*") if p.name != "store" and list(p.rglob("*.parquet"))}) or f(*a, **k))

    stored = lambda root: rows_of(ingest.read_store(spark, f"{root}/store"))
    ingest.ingest_files(files, f"{tmp_path}/whole", 0)
    for name in ("file_elements", "chunk_elements", "write_chunks"):
        spied(name)
    monkeypatch.setattr(ingest, "PORTION", 1)
    ingest.ingest_files(files, f"{tmp_path}/cut", 0)
    assert seen["file_elements"] == [{"known", "good", "speech"}] and seen["chunk_elements"] == [{"elements", "speech", "status"}]
    assert seen["write_chunks"] == [{"chunks", "counts", "status"}] * 8
    assert stored(f"{tmp_path}/cut") == stored(f"{tmp_path}/whole") and len(stored(f"{tmp_path}/cut")) > 60
