"""C01 by a real vocabulary: counts of byte-level BPE tokens as columns, made in Arrow batches, and packs that take them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import greedy_pack, joined, sentences

#: Signs of a piece of a word that has more tokens than a chunk may have, for each token: a sign has up to four bytes, each a token at most.
BYTES_OF_A_SIGN = 4
#: Texts, and bytes of them, that a task counts at a time; one longer text goes alone.
TEXTS, BYTES = 10_000, 1 << 20


@lru_cache(2)
def bpe_counter(path: str, pattern: str) -> Callable[[list[str]], list[int]]:
    """A function of texts that gives their token counts; path: a rank file in tiktoken's format. Special tokens are ordinary text."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda many: [len(x) for x in encoding.encode_ordinary_batch(many, num_threads=1)]


def in_portions(texts: pa.Array, count: Callable[[list[str]], list[int]]) -> list[int]:
    """The counts of texts without nulls; count gets at most TEXTS and BYTES of them at a time, so the ids of a batch are never held whole."""
    ends, n = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), []
    while (at := len(n)) < len(texts):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        n += count(texts.slice(at, min(max(upto - at, 1), TEXTS)).to_pylist())
    return n


def with_counts(df: DataFrame, items: str, path: str, pattern: str, out: str = "counts") -> DataFrame:
    """Adds out: for an array of texts the array of their counts, for a text its count; null for null, and for null items. The
    vocabulary is loaded once for each Python worker; rows stay where they are. A column of the name is replaced."""
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    many = isinstance(df.schema[items].dataType, T.ArrayType)
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()) if many else T.IntegerType())])
    names = [f.name for f in schema.fields]

    def counted(values: pa.Array) -> pa.Array:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        found = np.zeros(len(values), np.int32)
        found[there] = in_portions(values.drop_null(), bpe_counter(path, pattern))
        return pa.array(found, pa.int32(), mask=~there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(items))
            if many:
                sizes = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()])
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[~column.is_valid().to_numpy(zero_copy_only=False), False])
                new = pa.ListArray.from_arrays(offsets, counted(column.flatten()))
            else:
                new = counted(column)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names[:-1]), new], names=names)

    return df.select(names[:-1] if items in names[:-1] else [*names[:-1], items]).mapInArrow(run, schema)


def chunk_texts_counted(docs: DataFrame, key: str, text: str, most: int, path: str, pattern: str) -> DataFrame:
    """C03, C04 and C13 for files that are one text each, by a real vocabulary: (key, seq, content, token_count).

    Sentences are packed to at most `most` tokens by their own counts; one over the limit is packed by its words, and a word over
    it is cut into pieces of so few signs that none is. token_count is that of the chunk, in which blanks may join tokens. A
    text without sentence, a null one too, has no chunk."""
    parts = with_counts(docs.select(key, sentences(F.col(text)).alias("_items")), "_items", path, pattern, "_n")
    packs = parts.select(key, "_items", "_n", F.posexplode(greedy_pack(F.col("_n"), most)).alias("_at", "_p"))
    whole = (F.col("_p.last") > F.col("_p.first")) | (F.get("_n", F.col("_p.first")) <= most)
    packs = packs.select(key, "_at", F.when(whole, joined(F.col("_items"), F.col("_p"))).alias("_fits"), F.when(~whole, F.get("_items", F.col("_p.first"))).alias("_long"))
    size = max(1, most // BYTES_OF_A_SIGN)
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / size).cast("int")), lambda k: F.substring(w, k * size + 1, F.lit(size)))
    words = F.filter(F.split("_long", r"(?U)\s+"), lambda w: w != "")
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > size, pieces(w)).otherwise(F.array(w))))
    again = with_counts(packs.withColumn("_items", cut), "_items", path, pattern, "_n")
    inner = F.when(F.col("_fits").isNotNull(), F.array("_fits")).otherwise(F.transform(greedy_pack(F.col("_n"), most), lambda p: joined(F.col("_items"), p)))
    out = again.select(key, "_at", F.posexplode(inner).alias("_k", "content"))
    out = out.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_k", "content"))).alias("_c"))  # the chunks of one text
    out = out.select(key, F.posexplode(F.transform("_c", lambda c: c["content"])).alias("seq", "content"))
    return with_counts(out, "content", path, pattern, "token_count")
