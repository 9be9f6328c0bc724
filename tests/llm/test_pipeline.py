"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
import numpy as np
import tiktoken

import public_tokenizers
from quillmill.llm import bpe, decontam, queries

from ..conftest import SF
from .test_operators import brute_groups, brute_spans


def redacted(text):
    out, at = "", 0
    for start, _, end, _ in brute_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "byte-level BPE"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        rows = {r["doc_id"]: r for r in docs.collect()}
        kept[name] = rows
        if name == "quality classifier":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
            assert len(bad & set(rows)) <= 0.3 * len(bad) and len(rows) > 0.75 * len(before)
        if name == "n-gram Jaccard join":
            assert set(rows) == {d for d, (_, c) in brute_groups(before.items()).items() if c == d}
        if name == "benchmark decontamination":
            items = [b" ".join(decontam.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            holds = {d for d, t in before.items() if any(b" " + i + b" " in b" " + b" ".join(decontam.words_of(t)) + b" " for i in items)}
            assert holds and not holds & set(rows) and len(rows) >= len(before) - 2 * len(holds)
        if name == "secret scans":
            assert {d: r["text"] for d, r in rows.items()} == {d: redacted(t) for d, t in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "byte-level BPE":
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})
            assert all(np.array_equal(r["token_ids"], library.encode_ordinary(before[d])) for d, r in rows.items()) and set(rows) == set(before)
    run = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {d: r["token_ids"] for d, r in kept["byte-level BPE"].items()}
