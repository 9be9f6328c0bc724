"""Quality classifier: two zstandard dictionaries, one of good and one of bad labelled text; the normalised difference
of the sizes to which they compress a text becomes a calibrated score.

Texts are normalised first: runs of letters and digits become one sign for their shape and a word that stands one or two
words before becomes "=". So the dictionaries hold the make-up of good and bad text, not its vocabulary.

Fitting takes a bounded sample of labelled rows (max_docs of each label), whose whole texts stay in the tasks: the driver gets
pieces of each, from places that a hash of the text chooses anywhere in it, for the dictionaries, and one number for each that
calibrates. Pieces are as long as leaves room for all texts of the sample. Scoring reads every whole
text, in blocks, with one compressor for each dictionary per task. Memory: two dictionaries and a batch.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_arrow, bounded_sample, texts, without

#: Parameters of the sample and of the model.
MAX_DOCS, DICT_BYTES, PIECE, BLOCK_BYTES, LEVEL = 2000, 65_536, 256, 128, 9
#: The least bytes of a piece, some ten words' shapes; of DICT_BYTES / LEAST_PIECE texts none is left out of a dictionary.
LEAST_PIECE = 32
#: Bytes that any frame has, and how many words' shapes a task remembers.
FRAME_BYTES, REMEMBERED = 2, 200_000
RUN = re.compile(r"[^\W\d_]+|\d+")


@dataclass(frozen=True)
class ZstdQuality:
    """Plain values only, so that it pickles; constant_prior is the score when one label had no texts to learn from."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    constant_prior: float | None = None

    def scorer(self):
        if self.constant_prior is not None:
            return lambda text: self.constant_prior
        by_good, by_bad, normalise = compressor(self.good), compressor(self.bad), normaliser()

        def score(text: str | None) -> float:
            return logistic(self.slope * difference(normalise(text), by_good, by_bad) + self.intercept)

        return score


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(dictionary), source_size=2 * BLOCK_BYTES, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


def sign(run: re.Match) -> str:
    s = run.group()
    return "0" if s[0].isdecimal() or s.isnumeric() else "a" if s.islower() else "A" if len(s) > 1 and s.isupper() else "B"


def normaliser():
    """A function of a text; it remembers a bounded number of words' shapes."""
    shapes: dict[str, str] = {}

    def shape(word: str) -> str:
        if (known := shapes.get(word)) is None:
            if len(shapes) >= REMEMBERED:
                shapes.clear()
            known = shapes[word] = RUN.sub(sign, word)
        return known

    def normalise(text: str | None) -> bytes:
        out: list[str] = []
        for line in (text or "").split("\n"):
            last = before = None
            for word in line.split():
                out.append("=" if word == last or word == before else shape(word))
                before, last = last, word
            out.append("\n")
        return " ".join(out).encode("utf-8", "surrogatepass")

    return normalise


def difference(data: bytes, by_good, by_bad) -> float:
    """(size by bad - size by good) / (their sum) over the blocks of a normalised text; 0 for an empty one.

    Blocks are so short that the dictionary, not the text's own past, decides the size."""
    good = bad = 0
    for i in range(0, len(data), BLOCK_BYTES):
        block = data[i : i + BLOCK_BYTES]
        good += len(by_good.compress(block)) - FRAME_BYTES
        bad += len(by_bad.compress(block)) - FRAME_BYTES
    return (bad - good) / (bad + good) if bad + good > 0 else 0.0


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def for_dictionary(place: int, count: int) -> bool:
    """Of a label's texts two of three fill the dictionary, every third calibrates; of fewer than three all do both."""
    return place % 3 > 0 or count < 3


def pieces(data: bytes, count: int) -> bytes:
    """What a normalised text, one of so many of its label, gives to its dictionary: pieces that begin at places which its hash
    chooses. All texts together give no more than DICT_BYTES, as long as LEAST_PIECE bytes of each do."""
    texts = sum(for_dictionary(k, count) for k in range(count)) or 1
    size = max(LEAST_PIECE, min(PIECE, DICT_BYTES // texts))
    n = min(max(1, DICT_BYTES // (texts * size)), -(-len(data) // size))
    last = max(0, len(data) - size)
    at = sorted(xxhash.xxh3_64_intdigest(data, seed=k) % (last + 1) for k in range(n))
    return b"".join(data[i : i + size] for i in at)


def calibrate(values: list[float], labels: list[int]) -> tuple[float, float]:
    """Logistic regression of the label on one value, by Newton steps with a small ridge."""
    scale = max((abs(v) for v in values), default=0) or 1.0
    a, b = 0.0, 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = -1e-3 * a, 0.0, 1e-3, 0.0, 1e-9
        for v, y in zip(values, labels, strict=True):
            x = v / scale
            p = logistic(a * x + b)
            w = p * (1 - p)
            ga, gb = ga + (y - p) * x, gb + (y - p)
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + max(-5, min(5, da)), b + max(-5, min(5, db))
        if abs(da) + abs(db) < 1e-6:
            break
    return a / scale, b


def fit_texts(rows: list[tuple[str, int]]) -> ZstdQuality:
    """rows: (text, label 0 or 1) in a fixed order; of each label two of three texts fill the dictionary, every third calibrates."""
    normalise = normaliser()
    by = {y: [normalise(t) for t, label in rows if label == y and t] for y in (0, 1)}
    return fit_pieces({y: [pieces(t, len(ts)) for t in ts] for y, ts in by.items()}, lambda good, bad, wanted: [difference(by[y][k], compressor(good), compressor(bad)) for y, k in wanted])


def fit_pieces(by: dict[int, list[bytes]], differences) -> ZstdQuality:
    """by: for each label the pieces of its texts; differences(good, bad, wanted) measures the wanted (label, place) ones."""
    count = {y: len(ts) for y, ts in by.items()}
    if not count[0] or not count[1]:
        return ZstdQuality(b"", b"", 0.0, 0.0, (count[1] + 0.5) / (count[0] + count[1] + 1))
    good, bad = (b"".join(piece for i, piece in enumerate(by[y]) if for_dictionary(i, count[y])) or b" " * 8 for y in (1, 0))
    # Of the longer one its end, which the compressor finds as near as the end of the other.
    size = min(len(good), len(bad))
    good, bad = good[-size:], bad[-size:]
    wanted = [(y, k) for y in (0, 1) for k in range(0, count[y], 3)]
    return ZstdQuality(good, bad, *calibrate(differences(good, bad, wanted), [y for y, _ in wanted]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_docs: int = MAX_DOCS) -> ZstdQuality:
    """docs and labels meet by key; rows with a null key or another label than 0 and 1, and null and empty texts, aren't learned
    from; of several texts of one id the least is, of several labels the greater.

    Twice max_docs ids of each label are sampled first, as some may have no text, so the texts are found by one scan with a
    broadcast of at most 4 * max_docs ids. The sample is written to the shared folder and read for pieces and for differences."""
    spark = docs.sparkSession
    rows = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_key").isNotNull())
    ids = bounded_sample(rows, "_label", F.col("_key"), 2 * max_docs).groupBy("_key").agg(F.max("_label").alias("_label"))
    found = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    found = found.join(F.broadcast(ids), F.col("_doc") == F.col("_key")).groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    place = Window.partitionBy("_label").orderBy(F.xxhash64("_key"), "_key")  # at most 2 * max_docs rows
    sample = found.withColumn("_place", F.row_number().over(place).cast("long") - 1).filter(F.col("_place") < max_docs).select("_label", "_place", "_text")
    sample = Scratch(spark, "quality").write(sample, "sample")
    count = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}

    def make_pieces():
        normalise = normaliser()
        return lambda batch: [pa.array([pieces(normalise(t), count[y.as_py()]) for t, y in zip(texts(batch, "_text"), batch.column(batch.schema.get_field_index("_label")), strict=True)], pa.binary())]

    cut = append_arrow(sample, [T.StructField("_piece", T.BinaryType(), False)], make_pieces, ("_text",)).orderBy("_label", "_place").collect()

    def differences(good: bytes, bad: bytes, wanted) -> list[float]:
        def make():
            normalise, by_good, by_bad = normaliser(), compressor(good), compressor(bad)
            return lambda batch: [pa.array([difference(normalise(t), by_good, by_bad) for t in texts(batch, "_text")], pa.float64())]

        rows = append_arrow(sample.filter(F.col("_place") % 3 == 0), [T.StructField("_difference", T.DoubleType(), False)], make, ("_text",)).collect()
        of = {(r["_label"], r["_place"]): r["_difference"] for r in rows}
        return [of[x] for x in wanted]

    return fit_pieces({y: [bytes(r["_piece"]) for r in cut if r["_label"] == y] for y in (0, 1)}, differences)


def score(docs: DataFrame, model: ZstdQuality, text: str = "text", threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold, else 0) to every row; columns of these names are replaced.

    Null and empty texts have a difference of 0. Equal texts have equal scores; row order and partitioning don't matter."""

    def make():
        of = model.scorer()

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([of(t) for t in texts(batch, text)], pa.float64())]

        return run

    scored = append_arrow(without(docs, "predicted"), [T.StructField("score", T.DoubleType(), False)], make, () if keep_text else (text,))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
