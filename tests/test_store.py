"""Deletion on disk, rollback, the breaker of describers, early stops, and files that aren't read."""

import os
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.operators import elements as el
from quillmill.operators.joins import delete_by_source, skip_ingested
from quillmill.plans import ingest
from quillmill.plans.ingest import PAGE, delete_files, ingest_files, read_store
from quillmill.sources import files as io
from quillmill.sources import store

CHUNKS = [("a", "x.pdf", 3), ("a", "y.pdf", 2), ("b", "x.pdf", 4), (None, "x.pdf", 2), (None, None, 1), ("c d/é", "only.pdf", 2)]


def a_store(spark, path):
    rows = [(f"{b}-{f}-{k}", b, f, "text") for b, f, n in CHUNKS for k in range(n)]
    chunks = spark.createDataFrame(rows, "chunk_id string, book_id string, source_file string, content string")
    io.write_chunks(spark.createDataFrame([], io.STORE_SCHEMA).unionByName(chunks, allowMissingColumns=True), path)
    return path


def names(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def counts(spark, path):
    return {(r[0], r[1]): r[2] for r in read_store(spark, path).groupBy("book_id", "source_file").count().collect()}


def gone(spark, *rows):
    return spark.createDataFrame(rows, "book_id string, source_file string")


def test_only_touched_books_are_rewritten(spark, tmp_path):
    path = a_store(spark, f"{tmp_path}/store")
    before = names(path)
    assert delete_by_source(spark, path, gone(spark, ("a", "y.pdf"), ("a", "none.pdf"), ("zz", "x.pdf"))) == 1
    after = names(path)
    assert counts(spark, path) == {("a", "x.pdf"): 3, ("b", "x.pdf"): 4, ("", "x.pdf"): 2, ("", None): 1, ("c d/é", "only.pdf"): 2}
    assert {n for n in before if not n.startswith("book_id=a/")} == {n for n in after if not n.startswith("book_id=a/")}
    assert delete_by_source(spark, path, gone(spark, ("a", "y.pdf"))) == 0 and names(path) == after
    # an empty name and none are the same, a book of which nothing stays has no folder
    assert delete_by_source(spark, path, gone(spark, ("", "x.pdf"), (None, None), ("c d/é", "only.pdf"))) == 2
    assert counts(spark, path) == {("a", "x.pdf"): 3, ("b", "x.pdf"): 4}
    assert sorted(d for d in os.listdir(path) if d.startswith("book_id")) == ["book_id=a", "book_id=b"]
    assert not os.path.exists(f"{path}.rewrite")


def test_no_store_and_nothing_to_delete(spark, tmp_path):
    assert delete_by_source(spark, f"{tmp_path}/none", gone(spark, ("a", "x"))) == 0
    path = a_store(spark, f"{tmp_path}/store")
    before = names(path)
    assert delete_by_source(spark, path, gone(spark).limit(0)) == 0 and names(path) == before


@pytest.mark.parametrize("cut", ["before the rest is whole", "after"])
def test_a_deletion_that_was_cut_short(spark, tmp_path, cut, monkeypatch):
    path = a_store(spark, f"{tmp_path}/store")
    done = store.finish_deletion
    calls = []

    def stop(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("the driver is gone")
        done(*args)

    monkeypatch.setattr(store, "finish_deletion", stop)
    with pytest.raises(RuntimeError):
        delete_by_source(spark, path, gone(spark, ("a", "y.pdf"), ("b", "x.pdf")))
    monkeypatch.undo()
    if cut.startswith("before"):
        os.remove(f"{path}.rewrite/rest/_SUCCESS")
        assert counts(spark, path)[("a", "y.pdf")] == 2
        assert delete_by_source(spark, path, gone(spark, ("a", "y.pdf"), ("b", "x.pdf"))) == 2
    else:
        store.finish_deletion(spark, path, "book_id")
    assert ("a", "y.pdf") not in counts(spark, path) and ("b", "x.pdf") not in counts(spark, path)
    assert counts(spark, path)[("a", "x.pdf")] == 3 and not os.path.exists(f"{path}.rewrite")


def pages(spark, n=4, book="bk"):
    return spark.createDataFrame([(book, f"f{k}.pdf", f"{PAGE}Text number {k}.") for k in range(n)], "book_id string, filename string, markdown string")


def test_a_batch_that_fails_is_rolled_back(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    ingest_files(pages(spark, 2), root, 0)
    before = names(f"{root}/store")

    def fail(*_):
        raise OSError("no manifest today")

    monkeypatch.setattr(ingest, "commit_manifest", fail)
    with pytest.raises(OSError, match="no manifest"):
        ingest_files(pages(spark, 4).union(pages(spark, 1, "other")), root, 1)
    monkeypatch.undo()
    assert {f for _, f in counts(spark, f"{root}/store")} == {"f0.pdf", "f1.pdf"}
    assert len(before) == len(names(f"{root}/store"))
    assert ingest_files(pages(spark, 4), root, 1).count() == 2
    assert len(counts(spark, f"{root}/store")) == 4 == io.read_manifest(spark, f"{root}/manifest").count()


def test_deleted_files_can_be_ingested_again(spark, tmp_path):
    root = str(tmp_path)
    ingest_files(pages(spark), root, 0)
    delete_files(spark, root, gone(spark, ("bk", "f1.pdf")))
    assert {f for _, f in counts(spark, f"{root}/store")} == {"f0.pdf", "f2.pdf", "f3.pdf"} == {r.source_file for r in io.read_manifest(spark, f"{root}/manifest").collect()}
    again = ingest_files(pages(spark), root, 1).collect()
    assert [(r.file, r.status, r.n_chunks) for r in again] == [("f1.pdf", "stored", 1)]


def images(spark, n, slices=1):
    rows = [("bk", "book.epub", k, "figure", f"![p]({k}.png)", 1, bytearray(f"image {k}".encode())) for k in range(n)]
    return spark.createDataFrame(rows, "book_id string, source_file string, elem_idx int, type string, content string, page_num int, image_bytes binary").repartition(slices)


def calling(path, fails):
    def describe(some: pd.Series) -> pd.Series:
        for b in some:
            with open(path, "a") as f:
                f.write(f"{bytes(b).decode()}\n")
        if fails(some):
            raise ConnectionError("the model is down")
        return some.map(lambda b: f"{len(b)} bytes")

    return describe


CACHE = "image_sha256 string, description string"


def test_breaker_spares_calls(spark, tmp_path):
    log, none = f"{tmp_path}/calls", spark.createDataFrame([], CACHE)
    down = calling(log, lambda _: True)
    got = el.fresh_descriptions(images(spark, 60), none, down, max_failures=3).coalesce(1).collect()
    assert len(got) == 60 and sum(r.called for r in got) == 3 == len(Path(log).read_text().split("\n")) - 1
    os.remove(log)
    el.fresh_descriptions(images(spark, 10), none, down, max_failures=2, retries=4).coalesce(1).collect()
    assert Path(log).read_text().count("\n") == 10
    os.remove(log)
    got = el.fresh_descriptions(images(spark, 10), none, down, max_failures=0).coalesce(1).collect()
    assert all(r.called and r.description is None for r in got) and Path(log).read_text().count("\n") == 10


def test_a_success_ends_a_run_of_failures(spark, tmp_path):
    log, none = f"{tmp_path}/calls", spark.createDataFrame([], CACHE)
    odd = calling(log, lambda some: int(bytes(some.iloc[0]).split()[1]) % 2 == 1)
    got = el.fresh_descriptions(images(spark, 40), none, odd, max_failures=30).collect()
    assert all(r.called for r in got) and sum(r.description is None for r in got) == 20
    known = spark.createDataFrame([(r.image_sha256, r.description) for r in got if r.description], CACHE)
    os.remove(log)
    el.fresh_descriptions(images(spark, 40), known, odd, max_failures=0).collect()
    assert Path(log).read_text().count("\n") == 20  # only those that the cache lacks


def test_describer_is_loaded_once_for_a_task(spark, tmp_path):
    def load():
        with open(f"{tmp_path}/loads", "a") as f:
            f.write("x")
        return lambda some: some.map(lambda b: "seen")

    got = el.fresh_descriptions(images(spark, 50), spark.createDataFrame([], CACHE), load, at_once=7, load=True).coalesce(1).collect()
    assert {r.description for r in got} == {"seen"} and len(Path(f"{tmp_path}/loads").read_text()) == 1


def test_ingest_spares_a_model_that_is_down(spark, tmp_path):
    rows = [("b", f"i{k:02}.png", bytearray(f"picture {k}".encode())) for k in range(40)]
    files = spark.createDataFrame(rows, "book_id string, filename string, content binary")
    report = ingest_files(files, f"{tmp_path}/r", 0, describer=calling(f"{tmp_path}/calls", lambda _: True), describer_failures=2)
    assert {(r.status, r.reason) for r in report.collect()} == {("failed", "image not described")}
    assert Path(f"{tmp_path}/calls").read_text().count("\n") <= 2 * 4  # two for each of the tasks
    assert spark.read.json(f"{tmp_path}/r/failures/batch=0").filter("aborted_early").count() == 0


def test_files_stop_after_failures_in_a_row(spark, tmp_path):
    ok = lambda n: (n, PAGE + n)
    files = [("b", *ok("a.pdf")), ("b", "b.exe", None), ("b", *ok("c.pdf")), ("b", "d.exe", None), ("b", "e.pdf", None), ("b", *ok("f.pdf")), ("b", "g.exe", None), ("o", *ok("z.pdf")), (None, *ok("n.pdf")), ("b", None, "no name")]
    df = spark.createDataFrame(files, "book_id string, filename string, markdown string")
    report = {r.file: r.status for r in ingest_files(df, f"{tmp_path}/r", 0, max_failures=2).collect()}
    assert report == {"": "failed", "a.pdf": "stored", "b.exe": "failed", "c.pdf": "stored", "d.exe": "failed", "e.pdf": "failed", "f.pdf": "not attempted", "g.exe": "not attempted", "z.pdf": "stored", "n.pdf": "stored"}
    failures = spark.read.json(f"{tmp_path}/r/failures/batch=0").collect()
    assert {r.file for r in failures if not r.attempted} == {"f.pdf", "g.exe"} and all(r.aborted_early for r in failures)
    assert ("", "n.pdf") in counts(spark, f"{tmp_path}/r/store")
    again = {r.file: r.status for r in ingest_files(df.filter("filename = 'f.pdf'"), f"{tmp_path}/r", 1, max_failures=2).collect()}
    assert again == {"f.pdf": "stored"}


def test_skip_ingested_keeps_nulls(spark):
    files = spark.createDataFrame([(None, "1", "a"), ("b", "1", None), ("b", "2", None), ("b", "2", "x"), (None, None, None), (None, "3", "c")], "book_id string, sha256 string, filename string")
    known = spark.createDataFrame([(None, "3"), ("b", "9")], "book_id string, sha256 string")
    assert sorted(map(tuple, skip_ingested(files, known).collect()), key=repr) == sorted([(None, "1", "a"), ("b", "1", None), ("b", "2", "x"), (None, None, None)], key=repr)


def test_other_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one")
    (tmp_path / "b.Mp3").write_bytes(b"three")
    (tmp_path / "film.mkv").write_bytes(b"x" * 1000)
    with open(tmp_path / "huge.wav", "wb") as f:
        f.truncate(3 * 2**30)  # no blocks on disk
    files = io.read_corpus_files(spark, [str(tmp_path)])
    assert {(r.filename, bytes(r.content)) for r in files.collect()} == {("a.PDF", b"one"), ("b.Mp3", b"three")}
    plan = files._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length" in plan and "Sort" not in plan
    assert files._jdf.queryExecution().executedPlan().toString().count("mkv") == 0
    assert sorted(Path(f).name for f in files.inputFiles()) == ["a.PDF", "b.Mp3", "huge.wav"]  # the film isn't even listed
    assert [(r.filename, r.length) for r in io.list_corpus_files(spark, [str(tmp_path)]).collect()] == [("a.PDF", 3), ("b.Mp3", 5), ("huge.wav", 3 * 2**30)]
    failed = io.oversize_failures(spark, [str(tmp_path)])
    report = io.write_failures(failed, failed.select("file").limit(0), False, f"{tmp_path}/report")
    assert [(r.file, r.error_type, r.attempted) for r in report.collect()] == [("huge.wav", "oversize", True)]
    assert [r.file for r in io.oversize_failures(spark, [str(tmp_path)], ["pdf", "mp3"], 4).collect()] == ["b.Mp3"]
