"""Each operator on odd and on empty tables, and on tables whose other columns have the names that it adds."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from quillmill.llm import bpe, decontam, divergence, langid, licenses, ngram_join, quality_zstd, queries, secrets, sharding, urlfilter

from ..conftest import SF
from .helpers import empty, odd

GOOD = quality_zstd.fit_texts([("Some calm words. They go on and on.", 1), ("Other words follow here.", 1), ("A | B | C ###", 0), ("!! !! X X X", 0)] * 5)
LANG = langid.fit_texts([("the house and the garden", "en"), ("das haus und der garten", "de")], langid.pieces_of(queries.PIECES)[:8000], 1)
CLASH = ["score", "predicted", "secret_spans", "n_tokens", "token_ids", "lang_pred", "leaks", "slot", "shard", "n_words", "kept", "_doc", "hash", "node", "key", "decoded", "char_classes", "common_words", "held_out", "decoded_sha256", "turns", "part", "score", "terms"]


def operators(spark):
    ranks = bpe.load_ranks(queries.RANKS)
    bench = spark.createDataFrame([(1, "same words here and there"), (2, None), (3, "")], "item_id long, text string")
    rules = urlfilter.rules_frame(spark)
    return {
        "quality": lambda d: quality_zstd.score(d, GOOD), "secrets": secrets.digests, "redact": secrets.redact, "licenses": licenses.scan, "bpe": lambda d: bpe.decode(bpe.encode(d, ranks, public_tokenizers.PATTERN), ranks),
        "digests": lambda d: bpe.round_trip_digests(d, ranks, public_tokenizers.PATTERN), "divergence": divergence.judge, "sharding": lambda d: sharding.assign(d, ["a", "b", "c"], size=101),
        "langid": lambda d: langid.predict(d, LANG), "urls": lambda d: urlfilter.judge(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), rules), "decontam": lambda d: decontam.find(d, bench), "ngram": ngram_join.similar_groups,
    }


EMPTY = hashlib.sha256(b"").hexdigest()
#: What an operator says of a null text (1), an empty one (2), blank ones (3, 9) and six words (7).
VALUES = {
    "quality": lambda r, t: 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7),
    "secrets": lambda r, t: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == (0, 0, 0, EMPTY, ""),
    "redact": lambda r, t: (r["text"] or "") == t,
    "bpe": lambda r, t: bytes(r["decoded"]).decode() == t and len(r["token_ids"]) == r["n_tokens"],
    "digests": lambda r, t: r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest(),
    "divergence": lambda r, t: (r["n_words"], r["base_failed"], r["kept"]) == (len(t.split()), True, False),
    "langid": lambda r, t: (r["lang_pred"] == "und") == (not t.strip()),
    "urls": lambda r, t: (r["host"], r["path"], r["rule"]) == ("", "", None),
    "decontam": lambda r, t: [x["item_id"] for x in r["leaks"]] == ([1] if t.strip() else []),
    "ngram": lambda r, t: (r["n_shingles"], r["component_id"]) == ((2, 7) if t.strip() else (0, r["doc_id"])),
}

NAMES = ("quality", "secrets", "redact", "licenses", "bpe", "digests", "divergence", "sharding", "langid", "urls", "decontam", "ngram")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, spark):
    rows = operators(spark)[name](odd(spark)).collect()
    if name not in ("licenses",):
        assert len(rows) == odd(spark).count()
    check = VALUES.get(name)
    if check:
        by = {(r["doc_id"] if "doc_id" in r else r["page_id"]): r for r in rows}
        assert all(check(by[i], texts) for i, texts in ((1, ""), (2, ""), (3, " \n\t "), (7, "same words here and there again"), (9, "\n\n\n"))), name


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, spark):
    assert operators(spark)[name](empty(spark)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(name, spark):
    d = odd(spark).withColumns({c: F.lit("mine") for c in CLASH})
    out = operators(spark)[name](d)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    out.collect()


def test_empty_labels_and_languages(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_zstd.score(odd(spark), quality_zstd.fit(odd(spark), none)).filter("score <> 0.5").count() == 0
    strange = spark.createDataFrame([(1, 1), (2, None), (None, 0), (6, 5), (7, 0), (7, 0)], "doc_id long, quality int")
    assert quality_zstd.score(odd(spark), quality_zstd.fit(odd(spark), strange)).count() == odd(spark).count()
    none = langid.fit(empty(spark), ["a"])
    assert {r["lang_pred"] for r in langid.predict(odd(spark), none).collect()} == {"und"}
    assert decontam.find(odd(spark), spark.createDataFrame([], "item_id long, text string")).filter("size(leaks) > 0").count() == 0


def test_a_benchmark_item_without_id(spark):
    d = spark.createDataFrame([(1, "of all the words that stand here none is new to anyone"), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "words that stand here none is new"), (5, "nothing of it")], "item_id long, text string")
    assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.find(d, bench).collect()} == {1: [None], 2: []}


def test_only_long_licence_texts(spark):
    d = spark.createDataFrame([(1, f"before\n{licenses.TEXTS[0][1]}\nafter"), (2, "nothing of that")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(d, templates={}, long_texts=licenses.TEXTS[:1]).collect()] == [(1, licenses.TEXTS[0][0])]
    assert licenses.scan(d, templates={}, long_texts=()).collect() == []


def test_one_row_of_each_group(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, "a text of no one"), (None, "a text of no one"), (None, "another"), (None, None), (None, None)]
    d = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], empty(spark).schema)
    out = corpus_pipeline.keep_one_of_each_group(spark, d, "")
    assert out.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([rows[0], rows[3], rows[5], rows[6]], key=str)


@pytest.mark.parametrize("table", ["odd", "empty", "clash"])
def test_stages_of_the_pipeline(table, spark):
    d = {"odd": odd(spark), "empty": empty(spark), "clash": odd(spark).withColumns({c: F.lit("mine") for c in CLASH})}[table]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        out.collect()
