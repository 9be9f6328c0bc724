"""Quality rules by distribution divergence.

Base rules count words, symbols, repeated lines and repeated three-word windows. The method compares a document's
histograms of character classes and of common words with those of its language, by Jensen-Shannon distance. The common words
of a language are those that stand in the most of its documents, all of which are counted; a null language is one too. The references are sums over all documents that pass the base rules, taken twice: the second time without the documents
far from the first references, which junk has drawn towards itself. Short documents, whose histograms say little, are guarded:
with fewer than LEAST_WORDS words none is rejected by its distances, and above that the limits fall towards their values.
After the common words, counting runs once over the texts, inside the tasks that hold them; what is left is one row of small counts for each document,
written to the shared folder, from which references and distances follow natively.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_arrow, texts

#: Common words of a language: the histogram has a bin for each and one for all other words. Words that a task sums up at a time.
COMMON_WORDS, MOST_HELD = 30, 200_000
#: The bins of the histogram of character classes.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "symbol", "other")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 50, 0.17, 0.40
#: Guard of short documents: a histogram of n words scatters by about 1 / sqrt(n), so the limits rise by this over sqrt(n);
#: below the least number of words distances decide nothing. It is above MIN_WORDS, which the base rules ask for.
SCATTER, LEAST_WORDS = 0.35, 60
#: Documents farther than this from the first reference don't enter the second one.
TRIM_DISTANCE = 0.25

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_windows(words: list) -> int:
    """Words inside windows of three that occur twice or more in the list."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == n:
        return 0
    hit = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    inside = np.zeros(n + 2, bool)
    inside[:n] |= hit
    inside[1 : n + 1] |= hit
    inside[2:] |= hit
    return int(inside.sum())


def bare(word: bytes) -> bytes:
    """A word without the stops at its ends; only A-Z are lower-cased."""
    return word.lower().strip(b".,;:!?")


def common_words(docs: DataFrame, key: str, text: str, lang: str) -> dict[str | None, list[bytes]]:
    """For each value of lang, null too, the words that most of its documents hold, ties by the word. All documents count; tasks sum
    up the words they hold, MOST_HELD at a time."""

    def held(batches):
        seen: Counter = Counter()

        def cut():
            pairs, n = list(seen), list(seen.values())
            seen.clear()
            for at in range(0, len(pairs), 10_000):
                some = pairs[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in some], pa.string()), pa.array([p[1] for p in some], pa.binary()), pa.array(n[at : at + 10_000], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for t, own in zip(texts(batch, "_text"), batch.column(1).to_pylist(), strict=True):
                seen.update((own, w) for w in {bare(w) for w in set((t or "").encode("utf-8", "surrogatepass").split())} if w)
                if len(seen) >= MOST_HELD:
                    yield from cut()
        yield from cut()

    counts = docs.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).mapInArrow(held, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # tasks leave no more than COMMON_WORDS of a language to it
    out: dict[str | None, list[bytes]] = {}
    for r in counts.withColumn("k", F.row_number().over(most)).filter(F.col("k") <= COMMON_WORDS).orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(bytes(r["word"]))
    return out


def counter(words_of: dict[str | None, list[bytes]]):
    """A function of a text and its language that gives the base counts and the two histograms."""
    common_of = {lang: {w: k for k, w in enumerate(words)} for lang, words in words_of.items()}
    ascii_class = np.full(128, CLASSES.index("other"))
    for name, signs in (("blank", "\t\x0b\x0c\r "), ("newline", "\n"), ("stop", ".,;:!?'\"()-"), ("symbol", SYMBOLS + "@^_`~{}[]\\/=+")):
        ascii_class[[ord(c) for c in signs]] = CLASSES.index(name)
    ascii_class[48:58], ascii_class[65:91], ascii_class[97:123] = CLASSES.index("digit"), CLASSES.index("upper"), CLASSES.index("lower")
    upper, lower, other = CLASSES.index("upper"), CLASSES.index("lower"), CLASSES.index("other")

    def of(text: str | None, lang: str | None) -> tuple[list[int], list[int], list[int]]:
        text, common = text or "", common_of.get(lang, {})
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # bytes split at ASCII white space only
        octets = np.frombuffer(data, np.uint8)
        by_octet = np.bincount(octets, minlength=256)
        signs = int(by_octet[:128].sum() + by_octet[192:].sum())
        blanks = int(by_octet[[9, 10, 11, 12, 13, 32]].sum())
        dup = 0
        if by_octet[10]:
            lines = Counter(line for line in data.split(b"\n") if line.strip())
            dup = sum(lines.values()) - len(lines)
        classes = np.bincount(ascii_class, weights=by_octet[:128], minlength=len(CLASSES)).astype(int)
        if signs > int(by_octet[:128].sum()):
            for c, k in Counter(c for c in text if c > "\x7f").items():
                classes[lower if c.islower() else upper if c.isupper() else lower if c.isalpha() else other] += k
        hits = [0] * (COMMON_WORDS + 1)
        for word, k in Counter(words).items():
            hits[common.get(bare(word), -1)] += k
        base = [len(words), signs - blanks, int(by_octet[[ord(c) for c in SYMBOLS]].sum()), dup, repeated_windows(words)]
        return base, classes.tolist(), hits

    return of


def count(docs: DataFrame, words_of: dict[str | None, list[bytes]], text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """Adds the base counts (long), char_classes and common_words (arrays of long), one row for each row of docs.

    Null and empty texts count as no words; columns of these names are replaced."""

    def make():
        of = counter(words_of)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            own = (None if x is None else str(x) for x in batch.column(batch.schema.get_field_index(lang)).to_pylist())
            rows = [of(t, x) for t, x in zip(texts(batch, text), own, strict=True)]
            return [*(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(COUNTS))), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2))]

        return run

    arrays = T.ArrayType(T.LongType())
    fields = [*(T.StructField(c, T.LongType(), False) for c in COUNTS), T.StructField("char_classes", arrays, False), T.StructField("common_words", arrays, False)]
    return append_arrow(docs, fields, make, () if keep_text else (text,))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def js_distance(a: Column, b: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of two histograms of equal length; null if one sums to 0."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + x)
    # The total stands in an array of one, else it would be summed anew for each bin.
    share = lambda h: F.transform(F.array(F.nullif(total(h), F.lit(0.0))), lambda t: F.transform(h, lambda x: x / t))[0]
    p, q = share(a), share(b)
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts) / 2)))


def references(counted: DataFrame, lang: str = "lang") -> DataFrame:
    """For each language (null is one too) the summed histograms of its documents: a row each."""
    long = counted.select(
        F.col(lang).alias("_lang"),
        F.explode(F.array(F.struct(F.lit("char_classes").alias("kind"), F.col("char_classes").alias("h")), F.struct(F.lit("common_words").alias("kind"), F.col("common_words").alias("h")))).alias("x"),
    )
    bins = long.select("_lang", "x.kind", F.posexplode("x.h").alias("bin", "n"))
    sums = bins.groupBy("_lang", "kind", "bin").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("_lang", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"]).alias("h"))  # as many as there are bins
    return packed.groupBy("_lang").agg(F.max(F.when(F.col("kind") == "char_classes", F.col("h"))).alias("ref_classes"), F.max(F.when(F.col("kind") == "common_words", F.col("h"))).alias("ref_words"))


def distances(counted: DataFrame, refs: DataFrame, n_refs: int) -> DataFrame:
    """Adds class_distance and word_distance to the language's reference; null without one."""
    refs = refs.withColumnRenamed("_lang", "_ref_lang")
    side = F.broadcast(refs) if n_refs <= 10_000 else refs.hint("merge")  # some kB a row
    joined = counted.join(side, counted["_lang"].eqNullSafe(refs["_ref_lang"]), "left")
    named = {"class_distance": js_distance(F.col("char_classes"), F.col("ref_classes")), "word_distance": js_distance(F.col("common_words"), F.col("ref_words"))}
    return joined.withColumns(named).drop("_ref_lang", "ref_classes", "ref_words")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, the base counts, base_failed, class_distance, word_distance and kept, one row for each row of docs.

    kept is false if base_failed; else true unless the document has LEAST_WORDS words or more and one of its distances to
    its language's reference is beyond the limit, which rises for short documents. A language without reference (all its
    documents fail) decides nothing. Repeated rows are documents of their own; very long texts are read whole.
    The references have one row for each language; they are broadcast up to 10,000 languages, else joined by a sort-merge."""
    scratch = Scratch(docs.sparkSession, "divergence")
    source = docs.select(F.col(key), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    words_of = common_words(source, key, "_text", "_lang")  # COMMON_WORDS for each language
    counted = scratch.write(count(source, words_of, "_text", "_lang", keep_text=False), "counted")
    passed = counted.filter(~base_failed())
    first = scratch.write(references(passed, "_lang"), "first")
    n = first.count()
    near = distances(passed, first, n).filter((F.col("class_distance") <= TRIM_DISTANCE) & (F.col("word_distance") <= TRIM_DISTANCE))
    second = references(near.drop("class_distance", "word_distance"), "_lang")
    missing = first.join(second.select(F.col("_lang").alias("_l")).hint("merge"), F.col("_lang").eqNullSafe(F.col("_l")), "left_anti")
    refs = scratch.write(second.unionByName(missing), "refs")  # a language without near documents keeps its first reference
    out = distances(counted, refs, n).withColumn("base_failed", base_failed())
    rise = SCATTER / F.sqrt(F.greatest("n_words", F.lit(1)))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE + rise) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE + rise)
    far = far & (F.col("n_words") >= LEAST_WORDS)
    return out.select(key, *COUNTS, "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")
