"""Benchmark decontamination: passages of a benchmark, with edits, are found in whole texts.

Texts and items are sequences of normalised words. The CGK embedding walks through a sequence: at each step it writes the
word it stands on and moves on or stays, as a random function of step and word says; words that an edit shifted soon
fall into step again, so edit distance becomes Hamming distance. Bit sampling makes locality-sensitive keys of it: a few
sampled steps are a key, repeated with fresh walks and samples until the recall is reached. Windows as long as the
items start at every word; where a window's key is an item's, an exact edit distance decides. A long item is cut into
segments, each with keys of its own: of segments that cover the item, one at least has no more than its share of the edits,
wherever they lie. The distance that decides is the whole item's.

Before any walk one bound prunes, without loss: e edits leave all but e of an item's words in the window, of any kind of
words. So a window can't match that has fewer words of the benchmark's vocabulary, or of what few items
hold, or of what one or two hold, than an item of this size has, less e. The benchmark is the stated set of
queries: it is taken in blocks of bounded size, each sent to every task, so texts are neither moved nor joined.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_arrow, portions, texts, without

#: Edits allowed for each hundred words of an item; walks; sampled steps of a key; words of items in a block.
EDITS, REPEATS, SAMPLED, BLOCK_WORDS = 20, 16, 3, 2_000_000
#: Most words of a segment of an item, and signs of the texts taken at a time.
WALKED, AT_A_TIME = 64, 2_000_000
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.LongType())]))


def words_of(text: str | None) -> list[bytes]:
    """Lower case, ASCII punctuation deleted, split at ASCII white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split()


def edits(m: int) -> int:
    return m * EDITS // 100


def segments(m: int) -> list[tuple[int, int]]:
    """Start and end of as few equal segments as cover an item of m words."""
    n = -(-m // WALKED)
    return [(m * k // n, m * (k + 1) // n) for k in range(n)]


def least_distance(item: list[int], window: list[int]) -> tuple[int, int]:
    """The least edit distance of the item to any part of the window, and where that part ends: bit-parallel columns."""
    m = len(item)
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for k, w in enumerate(window):
        eq = places.get(w, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | (full & ~(d0 | plus)), plus & d0
        score += 1 if hp & top else -1 if hn & top else 0
        hp, hn = hp << 1 & full, hn << 1 & full
        plus, minus = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, k + 1
    return best, end


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Some items, ready for search; plain values, so that it pickles."""

    ids: list[int | None]
    items: list[list[int]]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, list[bytes]]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        items = [[vocabulary.setdefault(w, len(vocabulary)) for w in words] for _, words in rows]
        return cls([i for i, _ in rows], items, vocabulary)


class Search:
    def __init__(self, block: Block):
        self.block, self.get = block, block.vocabulary.get
        #: Item, start and end of every segment.
        self.parts = [(k, a, b) for k, item in enumerate(block.items) for a, b in segments(len(item))]
        longest = max(b - a for _, a, b in self.parts)
        edges = [1]
        while edges[-1] <= longest:
            edges.append(max(edges[-1] + 1, edges[-1] * 5 // 4))
        by_class: dict[int, list[int]] = {}
        for p, (_, a, b) in enumerate(self.parts):
            by_class.setdefault(bisect_right(edges, b - a) - 1, []).append(p)
        holders = np.zeros(len(block.vocabulary) + 1)
        for item in block.items:
            holders[list(set(item))] += 1
        #: Kinds of words, by how many items hold them; the last sign is for words from outside the vocabulary.
        self.kinds = [(holders > 0) & (holders <= most) for most in (np.inf, max(3.0, len(block.items) / 20), 2.0)]
        #: For each class of sizes: its shortest segment, and of each kind the words that a window of this size must hold.
        self.classes = []
        for c, which in sorted(by_class.items()):
            own = [block.items[k][a:b] for k, a, b in (self.parts[p] for p in which)]
            low = min(map(len, own))
            # A window of the shortest size may lack the last words of a longer segment.
            need = [min(int(kind[w].sum()) - edits(len(w)) - (len(w) - low) for w in own) for kind in self.kinds]
            need[0] = max(1, need[0])
            self.classes.append((c, low, need, which))
        self.pad = min(longest, max(low for _, low, _, _ in self.classes)) + 1
        rng = np.random.default_rng(20_240_229)
        seeds = rng.integers(1, 1 << 63, REPEATS, dtype=np.uint64)
        #: The moves of each walk at each word, a bit for each step; the last column is for words from outside the vocabulary.
        words = np.arange(len(block.vocabulary) + 1, dtype=np.uint64)
        self.moves = [mix(words + seed) for seed in seeds]
        self.sets = [frozenset(item) for item in block.items]
        # One and a half times as many steps as a segment has words: a step moves on by half a word in the mean, so samples lie
        # in its first three quarters, and few walks leave it.
        self.samples = {c: [np.sort(rng.choice(max(SAMPLED, low + low // 2), SAMPLED, replace=False)) for _ in range(REPEATS)] for c, low, _, _ in self.classes}
        keys, owners = [], []
        for c, _, _, which in self.classes:
            # A walk that leaves its segment goes on in the item, as it does in a text.
            rest = [block.items[k][a : b + self.pad] for k, a, b in (self.parts[p] for p in which)]
            flat = np.concatenate([np.array([*w, *[-1] * self.pad], np.int64) for w in rest])
            starts = np.concatenate([[0], np.cumsum([len(w) + self.pad for w in rest])[:-1]])
            ends = starts + np.array(list(map(len, rest)))
            for r in range(REPEATS):
                key, _ = self.keys(flat, starts, ends, c, r)
                keys.append(key)
                owners.append(np.array(which))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        self.part_keys, self.part_of = key[order], owner[order]

    def keys(self, ids: np.ndarray, at: np.ndarray, ends: np.ndarray, c: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of class c and walk r of the windows that start at the given places; which of them have no word from
        outside the vocabulary in their sample, as a window must to meet an item. Beyond the end of a text is one sign."""
        sample = self.samples[c][r]
        moves = self.moves[r]
        key = np.full(len(at), np.uint64((c << 8) + r + 1))
        inside = np.ones(len(at), bool)
        i = at.copy()
        for j in range(int(sample[-1]) + 1):
            word = ids[i]
            if j in sample:
                inside &= (word >= 0) | (i >= ends)
                key = mix(key ^ mix(word.astype(np.uint64) + np.uint64(j + 7)))
            i = np.minimum(i + ((moves[word] >> np.uint64(j)) & np.uint64(1)).view(np.int64), ends)
        return key, inside

    def find(self, many: list[str | None]) -> list[list[dict]]:
        """For each text the items found in it, each once, where it fits best."""
        found: list[list[dict]] = [[] for _ in many]
        get, parts, starts, lengths, at = self.get, [], [], [], 0
        for text in many:
            own = [get(w, -1) for w in words_of(text)]
            starts.append(at)
            lengths.append(len(own))
            parts.append(np.array(own, np.int64))
            parts.append(np.full(self.pad, -1, np.int64))
            at += len(own) + self.pad
        if not parts:
            return found
        ids = np.concatenate(parts)
        first, length = np.array(starts), np.array(lengths)
        sums = [np.concatenate([np.zeros(1, np.int32), np.cumsum(kind[ids], dtype=np.int32)]) for kind in self.kinds]
        met: set[tuple[int, int, int]] = set()
        for c, low, need, _ in self.classes:
            if len(ids) < low:
                continue
            places = np.flatnonzero(sums[0][low:] - sums[0][:-low] >= need[0])
            for total, least in zip(sums[1:], need[1:], strict=True):
                if least > 0:
                    places = places[total[places + low] - total[places] >= least]
            doc = np.searchsorted(first, places, side="right") - 1
            ends = first[doc] + length[doc]
            ok = places < ends
            places, doc, ends = places[ok], doc[ok], ends[ok]
            if not len(places):
                continue
            for r in range(REPEATS):
                key, inside = self.keys(ids, places, ends, c, r)
                which = np.flatnonzero(inside)
                key = key[which]
                low_at = np.searchsorted(self.part_keys, key)
                hit = np.flatnonzero(self.part_keys[np.minimum(low_at, len(self.part_keys) - 1)] == key)
                high_at = np.searchsorted(self.part_keys, key[hit], side="right")
                for k, i, j in zip(which[hit].tolist(), low_at[hit].tolist(), high_at.tolist(), strict=True):
                    met.update((int(doc[k]), self.parts[p][0], int(places[k]) - self.parts[p][1]) for p in self.part_of[i:j].tolist())
        last: tuple[int, int, int] | None = None
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, k, place in sorted(met):
            item = self.block.items[k]
            e = edits(len(item))
            if best.get((d, k), (1, 0))[0] == 0 or (last and last[:2] == (d, k) and place - last[2] <= e // 2):
                continue
            last = (d, k, place)
            # The edits before a segment shift it, too.
            slack = (2 if len(item) <= WALKED else 3) * e
            begin, end = max(starts[d], place - slack), min(starts[d] + lengths[d], place + len(item) + slack)
            window = ids[begin:end].tolist()
            if sum(map(self.sets[k].__contains__, window)) < len(item) - e:
                continue  # e edits leave as many words
            distance, stop = least_distance(item, window)
            if distance <= e and distance < best.get((d, k), (e + 1, 0))[0]:
                # Read backwards from where the part ends, the same distance is reached where it starts.
                _, back = least_distance(item[::-1], window[:stop][::-1])
                best[d, k] = (distance, begin - starts[d] + stop - back)
        for (d, k), (distance, start) in sorted(best.items()):
            found[d].append({"item_id": self.block.ids[k], "distance": distance, "start": start})
        return found


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of at most so many words, or one longer item; items without words can't be found and are left out."""
    rows: list[tuple[int, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        words = words_of(r["t"])
        if not words:
            continue
        if rows and size + len(words) > most:
            yield Block.of(rows)
            rows, size = [], 0
        rows.append((r["i"], words))
        size += len(words)
    if rows:
        yield Block.of(rows)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds leaks to every row: array of (item_id, distance in words, start word), one for each item within EDITS percent of
    its words; an item without id is named by null. Null and empty texts have none; equal items are all found; an empty
    benchmark finds nothing.

    Rows are kept one for one; a column of this name is replaced. Nothing is shuffled. Memory: a block and a portion; with
    a benchmark of several blocks what one has found is written, with the rows, before the next is read."""
    docs = without(docs, "leaks")
    names: list[str] = []
    shared = None
    for n, block in enumerate(blocks(benchmark, item, item_text)):
        if shared is not None:
            docs = Scratch(docs.sparkSession, "decontam").write(docs, f"block-{n}")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            search = Search(shared.value)

            def run(batch: pa.RecordBatch) -> list[pa.Array]:
                found = [x for some in portions(texts(batch, text), AT_A_TIME) for x in search.find(some)]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64())]))
                return [pa.array(found, kind)]

            return run

        names.append(f"_leaks_{n}")
        docs = append_arrow(docs, [T.StructField(names[-1], LEAKS, False)], make)
    leaks = F.concat(*names) if names else F.array().cast(LEAKS)
    return without(docs.withColumn("leaks", leaks), *names, *(() if keep_text else (text,)))
