"""Counts and chunks by a public BPE vocabulary against the library."""

import base64
import random
import re

import public_tokenizers
import pytest
import tiktoken

from quillmill.operators.tokens import chunk_texts_counted, with_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def count():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(encoding.encode_ordinary(t))


def test_counts_of_texts_and_arrays(spark, count):
    rows = [(1, ["one", None, "", "deux mots é中😀"], "a text"), (2, [], ""), (3, None, None), (4, ["<|endoftext|>"], "x" * 5000)]
    df = spark.createDataFrame(rows, "k int, items array<string>, t string").repartition(3)
    got = {r.k: (r.counts, r.n) for r in with_counts(with_counts(df, "items", PATH, PATTERN), "t", PATH, PATTERN, "n").collect()}
    assert got == {k: (None if a is None else [None if x is None else count(x) for x in a], None if t is None else count(t)) for k, a, t in rows}
    assert with_counts(df.limit(0), "items", PATH, PATTERN).collect() == []


def plain_pack(items, most, count):
    out, now, size = [], [], 0
    for x in items:
        n = count(x)
        if now and size + n > most:
            out.append(now)
            now, size = [], 0
        now.append(x)
        size += n
    return [*out, now] if now else out


def test_chunks(spark, count):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeéö中") for _ in range(rnd.choice([3, 6, 60])))
    texts = [" ".join(" ".join(word() for _ in range(rnd.choice([2, 9, 40]))).capitalize() + "." for _ in range(12)) for _ in range(20)] + ["", None, " \n", "One. Two."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in chunk_texts_counted(df, "k", "text", 40, PATH, PATTERN).orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append((r.content, r.token_count))
    for k, text in enumerate(texts):
        want = []
        for pack in plain_pack([s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z]|\d)|(?<=[。！？])", text or "") if s.strip()], 40, count):
            if len(pack) > 1 or count(pack[0]) <= 40:
                want.append(" ".join(pack))
            else:
                pieces = [w[i : i + 10] for w in pack[0].split() for i in range(0, len(w), 10)]
                want += [" ".join(p) for p in plain_pack(pieces, 40, count)]
        assert got.get(k, []) == [(c, count(c)) for c in want], k
