"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces (forward algorithm); a text's is the product over its words, as no piece spans two words.
The probabilities are learned by expectation maximisation on all words of a bounded sample of rows of each language: words and
their counts stay in a table, tasks sum the expected counts of pieces in each round, and the driver gets these sums, as many
as there are pieces and languages. A sign that the vocabulary lacks and the sample has is a piece of its own, so words with
such signs are learned from, and the languages that write them told apart. Words are runs of letters of any length. Prediction reads whole texts; a task remembers the vectors of a bounded number of words, so frequent words are summed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_arrow, bounded_sample, portions, texts, without

#: Parameters of the sample and of the model.
MAX_DOCS, ROUNDS, SMOOTH = 250, 3, 0.1
#: Signs from which on a word's lattice is summed in logarithms.
LONG = 64
#: Words that a task remembers, and signs of the texts that it takes at a time.
REMEMBERED, AT_A_TIME = 600_000, 2_000_000
#: Probability, in any language, of a sign that neither the vocabulary nor the sample has.
UNKNOWN = 1e-6
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece model without its control and byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    return [p.id_to_piece(i) for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


def words(text: str | None) -> Counter:
    """Runs of letters, with the marks upon them, in lower case, with their counts."""
    return Counter(LETTERS.findall((text or "").lower()))


@dataclass(frozen=True)
class LanguageModel:
    """languages in order; probs: for each piece one probability by language."""

    languages: tuple[str, ...]
    probs: dict[str, tuple[float, ...]]

    def scorer(self):
        """A function of many texts that gives (language, score) of each; what it remembers is bounded."""
        n = len(self.languages)
        if not n:
            return lambda many: [("und", 0.0) for _ in many]
        forward = Forward(self.probs, n)
        row: dict[str, int] = {}
        memory = np.zeros((REMEMBERED, n))

        def learn(new: list[str]) -> None:
            nonlocal memory
            if len(row) + len(new) > len(memory):
                memory = np.vstack([memory, np.zeros((len(row) + len(new) - len(memory), n))])
            at = len(row)
            memory[at : at + len(new)] = forward.logs(new)
            row.update(zip(new, range(at, at + len(new)), strict=True))

        def score(many: list[str | None]) -> list[tuple[str, float]]:
            nonlocal memory
            counts = [words(t) for t in many]
            if len(row) > REMEMBERED // 2:
                row.clear()
                memory = memory[:REMEMBERED]
            learn(list(set().union(*counts).difference(row)))
            out = []
            for c in counts:
                if not c:
                    out.append(("und", 0.0))
                    continue
                total = np.fromiter(c.values(), float, len(c)) @ memory[np.fromiter(map(row.__getitem__, c), int, len(c))]
                best = int(total.argmax())
                out.append((self.languages[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
            return out

        return score


class Forward:
    """The forward algorithm for many words at once: words of one length share the steps; pieces are found by the rolling
    hashes of their signs and confirmed by a 64-bit equality among the vocabulary's own distinct hashes."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, probs: dict[str, tuple[float, ...]], n: int):
        self.probs, self.n = probs, n
        self.longest = max(map(len, probs), default=1)
        names = list(probs)
        hashes = np.array([self.prefix_hashes(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in names], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        #: The last row is that of no piece.
        self.table = np.vstack([np.array([probs[names[i]] for i in order]).reshape(-1, n), np.zeros(n)])
        assert len(np.unique(self.hashes)) == len(names)
        self.powers = [np.uint64(pow(int(self.BASE), k, 1 << 64)) for k in range(self.longest + 1)]

    def prefix_hashes(self, signs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(signs), signs.shape[1] + 1), np.uint64)
        for j in range(signs.shape[1]):
            out[:, j + 1] = out[:, j] * self.BASE + signs[:, j] + np.uint64(1)
        return out

    def logs(self, new: list[str]) -> np.ndarray:
        out = np.zeros((len(new), self.n))
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(new):
            by_length.setdefault(len(word) + 1, []).append(k)
        for length, which in by_length.items():
            if length > 200:
                for k in which:
                    out[k] = self.one(new[k])
                continue
            for part in (which[i : i + 20_000] for i in range(0, len(which), 20_000)):
                signs = np.frombuffer("".join(START + new[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.uint64)
                out[part] = self.group(self.prefix_hashes(signs))
        return out

    def group(self, prefix: np.ndarray) -> np.ndarray:
        rows, length = len(prefix), prefix.shape[1] - 1
        alpha = np.zeros((length + 1, rows, self.n))
        alpha[0] = 1
        logs = np.zeros((rows, self.n))
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                h = prefix[:, j] - prefix[:, i] * self.powers[j - i]
                at = np.searchsorted(self.hashes, h)
                at[at == len(self.hashes)] = 0
                hit = self.hashes[at] == h
                if i == j - 1:
                    p = self.table[np.where(hit, at, -1)]
                    p[~hit] = UNKNOWN
                    alpha[j] += alpha[i] * p
                elif hit.any():
                    which = np.flatnonzero(hit)
                    alpha[j, which] += alpha[i, which] * self.table[at[which]]
            if j % 16 == 0:
                window = alpha[max(0, j + 1 - self.longest) : j + 1]
                top = window.max(axis=0)
                window /= top
                logs += np.log(top)
        return logs + np.log(np.maximum(alpha[length], 1e-300))

    def one(self, word: str) -> list[float]:
        """The same for one long word, with the last columns only."""
        s, alpha, logs = START + word, [np.ones(self.n)], np.zeros(self.n)
        unknown = np.full(self.n, UNKNOWN)
        for j in range(1, len(s) + 1):
            first = j - len(alpha)
            total = np.zeros(self.n)
            for i in range(first, j):
                p = self.probs.get(s[i:j])
                if p is not None or i == j - 1:
                    total += alpha[i - first] * (unknown if p is None else p)
            alpha = [*alpha[-(self.longest - 1) :], total] if self.longest > 1 else [total]
            if j % 16 == 0:
                top = np.max(alpha, axis=0)
                alpha = [a / top for a in alpha]
                logs += np.log(top)
        return list(logs + np.log(np.maximum(alpha[-1], 1e-300)))


def expect(n: int, edges: list[tuple[int, int, int]], p: list[float], c: float, expected: list[float]) -> None:
    """Adds to expected the count of each piece over all segmentations of a word of n signs that occurs c times."""
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, k in edges:
        alpha[j] += alpha[i] * p[k]
    if alpha[n] <= 0:
        return
    for i, j, k in reversed(edges):
        beta[i] += beta[j] * p[k]
    for i, j, k in edges:
        expected[k] += c * alpha[i] * p[k] * beta[j] / alpha[n]


def expect_in_logs(n: int, edges: list[tuple[int, int, int]], p: list[float], c: float, expected: list[float]) -> None:
    """The same for a long word, whose probability is too small for a float."""
    low = -math.inf
    alpha, beta = [0.0] + [low] * n, [low] * n + [0.0]

    def plus(x: float, y: float) -> float:
        top = max(x, y)
        return top if top == low else top + math.log(math.exp(x - top) + math.exp(y - top))

    logs = {k: math.log(p[k]) for _, _, k in edges}
    for i, j, k in edges:
        alpha[j] = plus(alpha[j], alpha[i] + logs[k])
    if alpha[n] == low:
        return
    for i, j, k in reversed(edges):
        beta[i] = plus(beta[i], beta[j] + logs[k])
    for i, j, k in edges:
        expected[k] += c * math.exp(alpha[i] + logs[k] + beta[j] - alpha[n])


def lattice(word: str, vocabulary: dict[str, int], longest: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Length and edges of a word; edges come by their ends, so their starts are summed before them."""
    s = START + word
    return len(s), [(i, j, k) for j in range(1, len(s) + 1) for i in range(max(0, j - longest), j) if (k := vocabulary.get(s[i:j])) is not None]


def with_signs(pieces: list[str], signs: Iterable[str]) -> dict[str, int]:
    """The pieces and, after them, the signs that they lack, with their numbers."""
    known = dict.fromkeys(pieces)
    return {p: i for i, p in enumerate([*known, *sorted({*signs, START} - known.keys())])}


def maximised(expected: list[float]) -> list[float]:
    """Probabilities from expected counts, cut off where the order of summation would show."""
    total = sum(expected) + SMOOTH * len(expected)
    return [float(f"{(e + SMOOTH) / total:.9e}") for e in expected]


def model_of(vocabulary: dict[str, int], probs: dict[str, list[float]]) -> LanguageModel:
    languages = tuple(sorted(probs))
    return LanguageModel(languages, {piece: tuple(probs[lang][i] for lang in languages) for piece, i in vocabulary.items()} if languages else {})


def add_expected(rows: Iterable[tuple[str, str, int]], vocabulary: dict[str, int], probs: dict[str, list[float]]) -> dict[str, list[float]]:
    """rows: (language, word, count). Expected piece counts over all segmentations, forward and backward, of each language."""
    longest = max(map(len, vocabulary))
    expected: dict[str, list[float]] = {}
    for lang, word, c in rows:
        n, edges = lattice(word, vocabulary, longest)
        (expect if n <= LONG else expect_in_logs)(n, edges, probs[lang], c, expected.setdefault(lang, [0.0] * len(vocabulary)))
    return expected


def fit_counts(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> LanguageModel:
    """counts: of each language its words. The plain version of fit()."""
    vocabulary = with_signs(pieces, (c for words in counts.values() for w in words for c in w))
    probs = {lang: [1.0 / len(vocabulary)] * len(vocabulary) for lang in counts}
    for _ in range(rounds):
        expected = add_expected(((lang, w, c) for lang in sorted(counts) for w, c in sorted(counts[lang].items())), vocabulary, probs)
        probs = {lang: maximised(expected.get(lang, [0.0] * len(vocabulary))) for lang in counts}
    return model_of(vocabulary, probs)


def fit_texts(rows: list[tuple[str, str]], pieces: list[str], rounds: int = ROUNDS) -> LanguageModel:
    """rows: (text, language)."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(words(text))
    return fit_counts(counts, pieces, rounds)


def fit(docs: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Learns from all words of max_docs rows of each non-null lang.

    Languages are taken as a small set of values, as any such column has; rows without text or lang are not learned from.
    Ids and languages are sampled first; the texts are then found by one scan with a broadcast of the sampled ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).filter("_lang IS NOT NULL AND length(_text) > 0")
    chosen = bounded_sample(rows.select("_key", "_lang"), "_lang", F.col("_key"), max_docs).distinct()
    one = rows.join(F.broadcast(chosen), ["_key", "_lang"]).groupBy("_key", "_lang").agg(F.min("_text").alias("_text"))

    def count(batches):
        for batch in batches:
            for own, language in zip(texts(batch, "_text"), batch.column(batch.schema.get_field_index("_lang")).to_pylist(), strict=True):
                c = words(own)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    sums = one.select(F.col("_lang").cast("string").alias("_lang"), "_text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = Scratch(spark, "langid").write(sums.repartition("lang", "word"), "words")
    signs = [r[0] for r in sums.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()]  # letters and marks
    vocabulary = with_signs(pieces, signs)
    probs = {r[0]: [1.0 / len(vocabulary)] * len(vocabulary) for r in sums.select("lang").distinct().collect()}
    for _ in range(rounds if probs else 0):
        sent = spark.sparkContext.broadcast((vocabulary, probs))  # the size of the vocabulary times the languages

        def expected_counts(batches, sent=sent):
            vocabulary, probs = sent.value
            found = add_expected((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), vocabulary, probs)
            for language, values in found.items():
                hit = [k for k, v in enumerate(values) if v]
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array([values[k] for k in hit], pa.float64())], names=["lang", "piece", "e"])

        expected = {language: [0.0] * len(vocabulary) for language in probs}
        for r in sums.mapInArrow(expected_counts, "lang string, piece int, e double").groupBy("lang", "piece").agg(F.sum("e").alias("e")).collect():
            expected[r["lang"]][r["piece"]] = r["e"]
        sent.destroy()
        probs = {language: maximised(e) for language, e in expected.items()}
    return model_of(vocabulary, probs)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred (a learned value, or `und` if the text is null or has no letter) and score, its posterior share.

    Ties go to the language that sorts first; columns of these names are replaced; rows, repeated ones too, are kept one for one,
    and very long texts are read whole."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the vocabulary times the languages

    def make():
        of = shared.value.scorer()

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [x for some in portions(texts(batch, text), AT_A_TIME) for x in of(some)]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]

        return run

    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    return append_arrow(without(docs, "lang_pred", "score"), fields, make, () if keep_text else (text,))
