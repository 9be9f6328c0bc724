"""Byte-level BPE encoding and decoding by merge replay.

The pre-tokens ("words") of a portion of the corpus that a task hasn't met yet are laid out in one array of symbols. An
inverted index leads from the rank that a token pair merges to, to the positions where the pair stands; a heap of ranks
applies every merge in rank order to all its positions and updates only the pairs beside each merged symbol. So a merge
is looked up once for all words that hold it. Texts are then put together from the ids of their words.

The replay runs over the distinct words of each portion inside the tasks that hold the texts. Moving the words of all
texts to one global index and back would shuffle several times the corpus; a word's ids don't depend on other words,
so the results are the same. A task remembers the ids of a bounded number of words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, portions, texts

#: Words that a task remembers, the most signs of one of them, and signs of the texts that it takes at a time.
REMEMBERED, REMEMBERED_SIGNS, AT_A_TIME = 500_000, 100, 4_000_000
#: New words laid out in one array: more of them no longer fit the processor's caches and take over twice the time.
LAID_OUT = 2_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line the base64 of a token and its rank; every byte must be a token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing}")
    return ranks


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: The rank of each pair of tokens that together are a token.
        self.pairs = {a * self.base + b: rank for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None}
        self.keys = np.array(sorted(self.pairs) or [-1], np.int64)
        self.key_ranks = np.array([self.pairs.get(int(k), -1) for k in self.keys], np.int64)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word; a word that is itself a token is one id."""
        whole = [self.ranks.get(w) for w in words]
        which = [k for k, (w, rank) in enumerate(zip(words, whole, strict=True)) if w and rank is None]
        out = [b"" if rank is None else np.uint32(rank).tobytes() for rank in whole]
        if not which:
            return out
        # A sign that nothing merges across stands before each word and after the last.
        lengths = np.array([len(words[k]) + 1 for k in which])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        symbols = np.full(starts[-1] + 1, -1, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[starts] = False
        symbols[inside] = self.byte[np.frombuffer(b"".join(words[k] for k in which), np.uint8)]
        symbols, odd = self.replay(symbols)
        bad = {int(n) for n in np.searchsorted(starts, odd, side="right") - 1}
        kept = symbols >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[starts] * 4
        data = symbols[kept].astype("<u4").tobytes()
        for n, (k, i, j) in enumerate(zip(which, ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            out[k] = np.array(self.one(words[k]), "<u4").tobytes() if n in bad else data[i:j]
        return out

    def replay(self, start: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """All merges, in rank order; merged-away symbols become -2. The second result has positions in words where a
        merge gave rise to a pair of lower rank, which must come before the rest of this rank: one() does those words."""
        keys = start[:-1] * self.base + start[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hits = np.flatnonzero((self.keys[at] == keys) & (start[:-1] >= 0) & (start[1:] >= 0))
        ranks = self.key_ranks[at[hits]]
        order = np.argsort(ranks, kind="stable")
        distinct, first = np.unique(ranks[order], return_index=True)
        bounds = [*first.tolist(), len(hits)]
        positions = hits[order].tolist()
        index = {rank: positions[i:j] for rank, i, j in zip(distinct.tolist(), bounds, bounds[1:], strict=False)}
        symbols, n = start.tolist(), len(start)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, base, odd, heap = self.pairs.get, self.base, [], list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            here = index.pop(rank)
            here.sort()
            for p in here:
                nxt = after[p]
                if get(symbols[p] * base + symbols[nxt]) != rank:
                    continue  # a neighbour's merge took one of the two; keys with a sign below 0 are in no pair
                symbols[p], symbols[nxt] = rank, -2
                right = after[p] = after[nxt]
                before[right] = p
                left = before[p]
                for key, place in ((rank * base + symbols[right], p), (symbols[left] * base + rank, left)):
                    if (new := get(key)) is not None:
                        if new in index:
                            index[new].append(place)
                        else:
                            index[new] = [place]
                            heapq.heappush(heap, new)
                        if new < rank:
                            odd.append(p)
        return np.array(symbols), odd

    def one(self, word: bytes) -> list[int]:
        """One word, merge by merge: the leftmost pair of the least rank first. Links and a heap keep long words fast."""
        ids, n = self.byte[list(word)].tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, at) for at in range(n - 1) if (rank := self.pairs.get(ids[at] * self.base + ids[at + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] < 0 or nxt >= n or self.pairs.get(ids[at] * self.base + ids[nxt]) != rank:
                continue
            ids[at], ids[nxt] = rank, -2
            right = after[at] = after[nxt]
            if right < n:
                before[right] = at
            for a, b in ((before[at], at), (at, right)):
                if a >= 0 and b < n and (new := self.pairs.get(ids[a] * self.base + ids[b])) is not None:
                    heapq.heappush(heap, (new, a))
        return [i for i in ids if i >= 0]


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit integers)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = regex.compile(pattern).findall
        self.replay = MergeReplay(ranks)
        self.known: dict[str, bytes] = {}

    def encode(self, many: Iterable[str | None]) -> list[bytes]:
        known, split = self.known, [self.words(t) if t else [] for t in many]
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in set().union(*split) if w not in known]
        for i in range(0, len(new), LAID_OUT):
            part = new[i : i + LAID_OUT]
            known.update(zip(part, self.replay.encode_words([w.encode("utf-8", "replace") for w in part]), strict=True))
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > REMEMBERED_SIGNS:
                del known[w]
        return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", packed: bool = False, keep_text: bool = True) -> DataFrame:
    """Adds n_tokens (long) and token_ids: an array of ints, or with packed their bytes as little-endian 32-bit integers.

    Every whole text is encoded, each match of pattern by itself, without special tokens; null and empty texts have no
    tokens. Rows are kept one for one, with their other columns; columns of the two names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the size of the vocabulary, whatever the corpus

    def make():
        encoder = Encoder(shared.value, pattern)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = [x for some in portions(texts(batch, text), AT_A_TIME) for x in encoder.encode(some)]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            if packed:
                return [counts, pa.array(ids, pa.binary())]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            return [counts, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))]

        return run

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("token_ids", kind, False)]
    return append_arrow(docs, fields, make, () if keep_text else (text,))


def decoder(ranks: dict[bytes, int]):
    """A function of ids that gives the bytes of their tokens; an id without token is an error."""
    token = {rank: t for t, rank in ranks.items()}.__getitem__
    return lambda ids: b"".join(map(token, ids))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", keep_ids: bool = True) -> DataFrame:
    """Adds decoded (binary), the bytes of the tokens of each row; null for null ids, and an error for an id without token.

    ids: an array of ints or packed bytes, as encode() gives them."""
    packed = isinstance(encoded.schema[ids].dataType, T.BinaryType)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def make():
        token = decoder(shared.value)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(ids))
            read = (lambda x: np.frombuffer(x.as_buffer(), "<u4").tolist()) if packed else (lambda x: x.as_py())
            return [pa.array([token(read(x)) if x.is_valid else None for x in column], pa.binary())]

        return run

    return append_arrow(encoded, [T.StructField("decoded", T.BinaryType(), True)], make, () if keep_ids else (ids,))


def round_trip_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row of docs: each text is encoded, and its ids are decoded again.

    Both in one Python node, so that a task holds the vocabulary once and neither ids nor decoded texts leave it."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        encoder, token = Encoder(shared.value, pattern), decoder(shared.value)

        def digests(some: list[str | None]) -> list[tuple[int, str, str]]:
            return [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(token(np.frombuffer(ids, "<u4").tolist())).hexdigest()) for ids in encoder.encode(some)]

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [x for some in portions(texts(batch, text), AT_A_TIME) for x in digests(some)]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

        return run

    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    return append_arrow(docs.select(key, text), fields, make, (text,))
