"""Common words of op5 are those of all documents."""

from quillmill.llm import divergence


def test_common_words_count_all_documents(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COMMON_WORDS", 1)
    rows = [(i, f"{'odd' if i % 5 < 3 else 'even'} w{i}", "x") for i in range(3000)] + [(i, "none, none", None) for i in range(3000, 3003)]
    rows += [(i, "rare", "x") for i in range(4000, 4003)] + [(5000, None, "x"), (5001, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert divergence.common_words(docs, "doc_id", "text", "lang") == {"x": [b"odd"], None: [b"none"]}
    # Words of few documents that the least hashes would have chosen decide nothing: 1,400 of one word against 1,300 of another.
    rows = [(i, "more" if i < 1400 else "less", "x") for i in range(2700)]
    monkeypatch.setattr(divergence, "MOST_HELD", 1)
    monkeypatch.setattr(divergence, "COMMON_WORDS", 3)
    counted = divergence.common_words(spark.createDataFrame([*rows, (9000, "single", "x")], "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert counted == {"x": [b"more", b"less", b"single"]}
