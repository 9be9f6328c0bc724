"""Encoding and decoding with the pieces of a sentencepiece model of kind BPE, by a table over prefixes.

Merging always takes the best pair at hand, the leftmost of equal ones, so what happens on one side of a border that no merge
crosses doesn't depend on the other side. Hence a row of pieces is the encoding of its text if and only if each piece is that
of its own text and each two neighbours are that of theirs, and the encoding of a prefix ends in one piece only. The table
stores it for each prefix: an automaton names the pieces that end at a place, and the one stays whose pair with the last
piece of the prefix before it is compatible, that is, encodes as these two. From the end backwards the table gives all ids.

A sign that no piece holds stands alone and becomes its bytes. If no piece goes on into a blank, as is usual, a text is cut
before its runs of blanks, and each distinct word of a portion of texts is done once; else texts are done whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, portions, texts

BLANK = "▁"
#: Bytes that are no UTF-8 are read as one U+FFFD each.
BY_BYTE = "quillmill.by_byte"
codecs.register_error(BY_BYTE, lambda e: ("\ufffd", e.start + 1))
#: Words and pairs that a task remembers, the most signs of a remembered word, and signs of texts that are taken at a time.
REMEMBERED, PAIRS, REMEMBERED_SIGNS, AT_A_TIME = 500_000, 2_000_000, 100, 4_000_000


@dataclass(frozen=True)
class Model:
    """scores: of the pieces that merges make; ids of these; ids of the 256 bytes; prefix: a blank is put before each text."""

    scores: dict[str, float]
    ids: dict[str, int]
    bytes: tuple[int, ...]
    prefix: bool


def load_model(path: str) -> Model:
    """A model file: of kind BPE, with byte fallback, plain normalisation, and no pieces that a user has defined."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind = type(proto.pieces[0])
    spec, trained = proto.normalizer_spec, proto.trainer_spec
    if trained.model_type != type(trained).BPE or not trained.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("only plainly normalised models of kind BPE with byte fallback are known")
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
        raise ValueError("pieces that are unused or defined by a user are not known")
    normal = {p.piece: (k, p.score) for k, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
    byte = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kind.BYTE}
    return Model({p: s for p, (_, s) in normal.items()}, {p: k for p, (k, _) in normal.items()}, tuple(byte[f"<0x{b:02X}>"] for b in range(256)), spec.add_dummy_prefix)


def merged(signs: Iterable[str], scores: dict[str, float]) -> list[str]:
    """Merge by merge: the pair of the highest score first, the leftmost of equal ones. For pairs and tests."""
    part = list(signs)
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-scores[x], k, x) for k in range(n - 1) if (x := part[k] + part[k + 1]) in scores]
    heapq.heapify(heap)
    while heap:
        _, k, x = heapq.heappop(heap)
        nxt = after[k]
        if not part[k] or nxt >= n or part[k] + part[nxt] != x:
            continue
        part[k], part[nxt] = x, ""
        right = after[k] = after[nxt]
        if right < n:
            before[right] = k
        for a, b in ((before[k], k), (k, right)):
            if a >= 0 and b < n and (y := part[a] + part[b]) in scores:
                heapq.heappush(heap, (-scores[y], a, y))
    return [p for p in part if p]


class PrefixTable:
    def __init__(self, model: Model):
        import ahocorasick

        self.scores, self.ids, self.bytes = model.scores, model.ids, model.bytes
        self.automaton = ahocorasick.Automaton()
        # A piece that other merges break up ends no encoding; a single sign always stands for itself.
        for piece in model.scores:
            if len(piece) == 1 or merged(piece, model.scores) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = merged(a + b, self.scores) == [a, b]
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose blanks are escaped; signs that are in no piece stand alone."""
        last: list[str | None] = [None] * (len(text) + 1)
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            start = end - len(piece)
            # Nothing merges with a sign outside the pieces, so after it, as at the beginning, any piece may stand.
            if start == 0 or (before := last[start]) is None and text[start - 1] not in self.scores or before is not None and self.compatible(before, piece):
                last[end] = piece
        out, end = [], len(text)
        while end:
            piece = last[end] or text[end - 1]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in ((self.ids[p],) if p in self.ids else [self.bytes[b] for b in p.encode("utf-8", "replace")])]


class Encoder:
    """Texts to ids, packed as little-endian 32-bit integers."""

    def __init__(self, model: Model):
        self.table, self.prefix = PrefixTable(model), model.prefix
        crossing = re.compile(f"[^{BLANK}]{BLANK}")
        whole = any(crossing.search(p) for p in model.scores)
        self.split = (lambda t: [t]) if whole else re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
        self.known: dict[str, bytes] = {}

    def words(self, text: str | None) -> list[str]:
        return self.split((BLANK if self.prefix else "") + text.replace(" ", BLANK)) if text else []

    def encode(self, many: Iterable[str | None]) -> list[bytes]:
        known, split = self.known, [self.words(t) for t in many]
        if len(known) > REMEMBERED:
            known.clear()
        long = []
        for w in set().union(*split):
            if w not in known:
                known[w] = np.array(self.table.encode(w), "<u4").tobytes()
                if len(w) > REMEMBERED_SIGNS:
                    long.append(w)
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for w in long:
            del known[w]
        return out


class Decoder:
    """Ids to text, as the library's decode() has it: pieces joined, one blank of the prefix taken away, bytes read as UTF-8."""

    def __init__(self, model: Model):
        self.texts = {k: p.replace(BLANK, " ").encode("utf-8") for p, k in model.ids.items()} | {k: bytes([b]) for b, k in enumerate(model.bytes)}
        self.prefix, self.blanks = model.prefix, {k for p, k in model.ids.items() if p.startswith(BLANK)}

    def decode(self, ids: Sequence[int]) -> str:
        """An id without text is an error; bytes that are no UTF-8 are read as U+FFFD each."""
        raw = b"".join(map(self.texts.__getitem__, ids))
        if self.prefix and len(ids) and ids[0] in self.blanks:
            raw = raw[1:]
        return raw.decode("utf-8", BY_BYTE)


def _shared(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast(model)  # the size of the vocabulary, whatever the corpus


def encode(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds n_tokens (long) and token_ids (array of ints): each whole text's ids, without begin and end. Null and empty texts
    have none. Rows are kept one for one, with their other columns; columns of the two names are replaced."""
    sent = _shared(docs, model)

    def make():
        encoder = Encoder(sent.value)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = [x for some in portions(texts(batch, text), AT_A_TIME) for x in encoder.encode(some)]
            counts = [len(x) // 4 for x in ids]
            ends = np.cumsum([0, *counts]).astype(np.int32)
            return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))]

        return run

    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("token_ids", T.ArrayType(T.IntegerType()), False)]
    return append_arrow(docs, fields, make, () if keep_text else (text,))


def decode(encoded: DataFrame, model: Model, ids: str = "token_ids", keep_ids: bool = True) -> DataFrame:
    """Adds decoded (string), the text of each row's ids; null for null ids, an error for an id without text."""
    sent = _shared(encoded, model)

    def make():
        decoder = Decoder(sent.value)
        return lambda batch: [pa.array([decoder.decode(x.as_py()) if x.is_valid else None for x in batch.column(batch.schema.get_field_index(ids))], pa.string())]

    return append_arrow(encoded, [T.StructField("decoded", T.StringType(), True)], make, () if keep_ids else (ids,))


def round_trip_digests(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of every row: each text is encoded, and its
    ids are decoded again, in one Python node, so that neither ids nor decoded texts leave the task."""
    sent = _shared(docs, model)

    def make():
        encoder, decoder = Encoder(sent.value), Decoder(sent.value)

        def digests(some: list[str | None]) -> list[tuple[int, str, str]]:
            out = []
            for packed in encoder.encode(some):
                ids = np.frombuffer(packed, "<u4").tolist()
                decoded = decoder.decode(ids).encode("utf-8")
                out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            return out

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [x for some in portions(texts(batch, text), AT_A_TIME) for x in digests(some)]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

        return run

    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    return append_arrow(docs.select(F.col(key), F.col(text)), fields, make, (text,))
