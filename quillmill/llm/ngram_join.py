"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles. Sets fall into size bands. In a band the hash space is cut
into K blocks, and the parity (XOR) of a block's hashes is the block's sign; a token that only one of two sets has
changes the sign of one block. Sets of sizes a and b with a Jaccard similarity of t differ in at most
D = (a + b)(1 - t) / (1 + t) tokens, so at least K - D of their K signs agree (pigeonhole). In one fixed order of signs,
the first D + 1 + s of either then have s + 1 in common: these are the keys of the join, and s is its slack. A set also meets
the next lower band if a partner can lie there, so each pair has a band in which both are.

Sets with one key are a group. Every set of it is first held against the smallest one of about its size; if this leaves the
group in several components, either all pairs between its components follow, or, where COMMON sets or more are in it, the key is
common: it may come from a block that holds nothing but a passage which many sets share. A pair of similar sets can
be missed by this only if all its s + 1 keys or more are common. So a set of which at most s keys are common is done, and only
the others, which consist of common passages to a good part, are taken further: to blocks so fine that each has one token. Sets
share 80 of 100 of the tokens of either or more, so again a set is done if fewer of its tokens are common. What remains
are sets that are common passages but for a few tokens. Those with the same common tokens are a class, in which numbers of
tokens decide. Across classes, the set with the fewest rare tokens stands for its class: these firsts, and sets that
aren't similar to theirs, meet in groups of a few of their least common tokens (as few as their number of common tokens leaves
to differ), only where rare tokens leave room, a pair at least one of which is a first, by blocks of a group and only across
components: first by as few pairs as join all that are near by an estimate from finer sketches, then by all such pairs.

Pairs that met are held against a bit sketch: tokens toggle one bit each, so the Hamming distance of two sketches is no
more than the symmetric difference; what is within D is verified exactly on the texts. Copies of one text are one node.
So groups of near copies never make all their pairs, and no link is lost.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEW_ROWS, Scratch, append_arrow, beside, is_few
from .graph import components

#: Words of a shingle, and the least similarity as a fraction.
WORDS, SIMILAR = 5, (80, 100)
#: Members from which on the key of a group in several components is common; members of a block of a group of
#: common tokens, and bytes of their sketches.
COMMON, BLOCK, BLOCK_BYTES = 32, 1024, 1 << 22
#: Possible pairs of firsts and sets up to which all are tried at once, without those of a forest before.
FEW_PAIRS = 1_000_000
#: Ids up to which they are sent to every executor to fetch their texts: below 32 MB.
BROADCAST_IDS = 500_000
PRIME, MIX_1, MIX_2, GOLDEN, ONE = (np.uint64(x) for x in (0x100000001B3, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 1))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a permutation of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, split at ASCII white space; a shorter text is one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * PRIME * GOLDEN + h[k : len(h) - n + 1 + k]
        total ^= total >> np.uint64(29)
    return np.unique(mix(total))


class Bands:
    """Sizes from edges[i] up to before edges[i + 1]; blocks[i] is K of band i."""

    def __init__(self, similar: tuple[int, int] = SIMILAR):
        self.num, self.den = similar
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            e = self.edges[-1]
            self.edges.append(max(e + 1, e * 3 // 2, self.largest(e) + 1))
        self.blocks = []
        for low, high in zip(self.edges, self.edges[1:], strict=False):
            d = self.differ(high - 1, self.largest(high - 1))
            self.blocks.append(d + d // 4 + 8 if d else 1)

    def largest(self, a: int) -> int:
        """The size of the largest set that a set of size a can be similar to."""
        return a * self.den // self.num

    def smallest(self, a: int) -> int:
        """The size of the smallest such set, which is also the least number of tokens that both hold."""
        return -(-a * self.num // self.den)

    def differ(self, a: int, b: int) -> int:
        """The most tokens in which similar sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    @staticmethod
    def slack(d: int) -> int:
        """Keys beyond D + 1. Where sets must be equal the only block is the whole set."""
        return d // 8 + 3 if d else 0

    def homes(self, n: int) -> list[tuple[int, int]]:
        """(band, D) of a set of size n: its own band and, where a smaller partner can be, the one below."""
        band = bisect_right(self.edges, n) - 1
        out = [(band, self.differ(n, self.largest(n)))]
        if band and n <= self.largest(self.edges[band] - 1):
            out.append((band - 1, self.differ(n, self.edges[band] - 1)))
        return out

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, int]:
        """The join keys of a set, their last bit the band's, and its room: how many keys of a home may be common.

        Blocks without tokens tell nothing: they aren't keys, but where signs are too few they count as common ones. The slack of
        the smallest partner is the one that limits the room: a partner's D is no less than that of both their sizes."""
        n, out, lacking = len(hashes), [], 0
        for band, d in self.homes(n) if n else ():
            signs = self.signs(hashes, band)[: d + 1 + self.slack(d)]
            lacking = max(lacking, d + 1 + self.slack(d) - len(signs))
            out.append(signs & ~ONE | np.uint64(band & 1))
        return np.concatenate(out) if out else np.zeros(0, np.uint64), self.slack(self.differ(self.smallest(n), n)) - lacking

    def signs(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """Sorted signs of the blocks with tokens."""
        k = self.blocks[band]
        block = (hashes >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)  # grows with the hash, so a block is a run
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        salt = np.uint64(band) << np.uint64(40)
        return np.sort(mix(np.bitwise_xor.reduceat(hashes, starts) ^ mix(block[starts] + salt + GOLDEN)))


def sketch(hashes: np.ndarray, times: int = 2) -> bytes:
    """Bits toggled by a token each; their number is a power of two, so many times the set's size or more."""
    bits = max(64, 1 << (times * len(hashes) - 1).bit_length())
    at = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").tobytes()


def fold(x: bytes, length: int) -> np.ndarray:
    """A sketch at a shorter length, which keeps the lower bound. Partners of a set are no smaller; a shorter sketch is all zeros."""
    bits = np.frombuffer(x, np.uint8)
    return np.bitwise_xor.reduce(bits.reshape(-1, length), axis=0) if len(bits) >= length else np.zeros(length, np.uint8)


def hamming(x: bytes, y: bytes) -> int:
    """Distance of two sketches, at the length of the shorter one."""
    length = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, length) ^ fold(y, length)).sum())


class Corpus:
    """The rows of a table, its distinct texts and their least ids. ids (id, hash): every row; firsts (hash, node)."""

    def __init__(self, docs: DataFrame, key: str, text: str, scratch: Scratch):
        self.scratch = scratch
        self.rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
        self.ids = scratch.write(self.rows.select("id", F.md5("text").alias("hash")), "ids")
        self.firsts = scratch.write(self.ids.filter("id IS NOT NULL").groupBy("hash").agg(F.min("id").alias("node")), "firsts")

    def first_texts(self, rows: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
        """(node, text, hash) of the rows that have a text's least id. Rows meet firsts by id, not by hash: rows of one text,
        however many, spread over all tasks. firsts: few of them, which go to the rows."""
        side = (self.firsts if firsts is None else firsts).select("node", F.col("hash").alias("first_hash"))
        found = rows.join(side.hint("shuffle_hash" if firsts is None else "broadcast"), F.col("id") == F.col("node")).filter(F.md5("text") == F.col("first_hash"))
        return found.select("node", "text", F.col("first_hash").alias("hash"))

    def all_texts(self) -> DataFrame:
        return self.first_texts(self.rows)

    def texts_of(self, wanted: DataFrame, name: str) -> DataFrame:
        """The same for the ids of wanted (w): up to BROADCAST_IDS of them are sent to the texts, else both are shuffled. Few go with
        their hashes, so no text is shuffled."""
        ids = self.scratch.write(wanted.distinct(), name)
        n = ids.count()
        if n <= FEW_ROWS:
            known = self.scratch.write(self.firsts.join(F.broadcast(ids), F.col("node") == F.col("w"), "left_semi"), f"{name}-firsts")
            if is_few(known):
                return self.first_texts(self.rows, known)
        side = F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("shuffle_hash")
        return self.first_texts(self.rows.join(side, F.col("id") == F.col("w")).select("id", "text"))


def flat(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64)))


def sets(texts: DataFrame, bands: Bands) -> DataFrame:
    """(node, hash, n, sketch, keys, room) of each node."""

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            n, bits, keys, room = [], [], [], []
            for x in batch.column(batch.schema.get_field_index("text")):
                h = shingles(x.as_py())
                n.append(len(h))
                bits.append(sketch(h))
                own, left = bands.keys(h)
                keys.append(own)
                room.append(left)
            return [pa.array(n, pa.int64()), pa.array(bits, pa.binary()), flat(keys), pa.array(room, pa.int64())]

        return run

    kinds = {"n": T.LongType(), "sketch": T.BinaryType(), "keys": T.ArrayType(T.LongType()), "room": T.LongType()}
    return append_arrow(texts, [T.StructField(c, k, False) for c, k in kinds.items()], make, drop=("text",))


def tokens(texts: DataFrame) -> DataFrame:
    """(node, n, sketch, keys) of each node: blocks of one token each, and a finer sketch."""

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            own = [shingles(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            return [pa.array(list(map(len, own)), pa.int64()), pa.array([sketch(x, 8) for x in own], pa.binary()), flat(own)]

        return run

    kinds = {"n": T.LongType(), "sketch": T.BinaryType(), "keys": T.ArrayType(T.LongType())}
    return append_arrow(texts.select("node", "text"), [T.StructField(c, k, False) for c, k in kinds.items()], make, drop=("text",))


def groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Whole groups of equal first columns from sorted batches; several groups at a time."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
        if cut:
            yield [x[:cut] for x in now]
        rest = [x[cut:] for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def meet(rows: DataFrame, bands: Bands) -> DataFrame:
    """rows (key, node, n): (kind, x, y). Kind 0: pairs of a group, each set with the smallest of its class of sizes, and these
    smallest ones with each other in turn. Kind 1: the rows (key, node) of groups of three or more."""
    num, den = bands.num, bands.den

    def run(batches):
        for key, node, n in groups(batches, 3):
            # Classes begin at the least size of a group times powers of the largest ratio.
            start = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(start) - 1
            size = np.bincount(group)
            many = size[group] > 1
            if not many.any():
                continue
            key, node, n, group = key[many], node[many], n[many], group[many]
            order = np.lexsort((node, n, group))
            key, node, n, group = key[order], node[order], n[order], group[order]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            least = n[first][np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1]
            level = np.floor(np.log(n / least) / np.log(den / num) + 1e-9)
            opens = np.concatenate([[True], (group[1:] != group[:-1]) | (level[1:] != level[:-1])])
            centre = np.flatnonzero(opens)
            of = np.where(opens, np.concatenate([[0], centre[:-1]])[np.cumsum(opens) - 1], centre[np.cumsum(opens) - 1])
            pair = (group[of] == group) & (node[of] != node) & (n[of] * den >= n * num)
            more = size[group] > 2
            kind = np.concatenate([np.zeros(pair.sum(), np.int32), np.ones(more.sum(), np.int32)])
            x, y = np.concatenate([np.minimum(node[of], node)[pair], key[more]]), np.concatenate([np.maximum(node[of], node)[pair], node[more]])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y)], names=["kind", "x", "y"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "kind int, x long, y long")


def near(bands: Bands, n: int, bits: bytes, others_n: np.ndarray, others: np.ndarray, lengths: np.ndarray, folded: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of a sketch to those of other sets, at the shorter length of each two, these lengths, and the most tokens in which
    similar sets of such sizes differ. folded remembers the others' sketches by length."""
    at = np.minimum(lengths, len(bits))
    far = np.zeros(len(others), np.int64)
    for length in np.unique(at).tolist():
        if length not in folded:
            folded[length] = np.stack([fold(x, length) for x in others])
        some = at == length
        far[some] = np.bitwise_count(folded[length][some] ^ fold(bits, length)).sum(axis=1, dtype=np.int64)
    return far, at, (others_n + n) * (bands.den - bands.num) // (bands.den + bands.num)


def cross(rows: DataFrame, bands: Bands) -> DataFrame:
    """rows (key, node, n, sketch, component) of small groups: the pairs (a, b) of a group whose components differ, whose sizes
    can be similar and whose sketches are near enough. A pair is a row only once it has passed the sketches."""

    def run(batches):
        for key, *columns in groups(batches, 5):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for i, j in zip(starts, np.append(starts[1:], len(key)), strict=True):
                node, n, bits, component = (c[i:j] for c in columns)
                lengths, folded = np.array([len(x) for x in bits]), {}
                for k in range(len(node) - 1):
                    far, _, most = near(bands, n[k], bits[k], n, bits, lengths, folded)
                    fits = (component != component[k]) & (n * bands.den >= n[k] * bands.num) & (n[k] * bands.den >= n * bands.num) & (far <= most)
                    some = np.flatnonzero(fits[k + 1 :]) + k + 1
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[k], node[some])), pa.array(np.maximum(node[k], node[some]))], names=["a", "b"])

    return rows.select("key", "node", "n", "sketch", "component").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def classes(common: DataFrame, by_token: DataFrame, bands: Bands, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sets that are common tokens but for a few, by what common tokens they have. common: rows (key, node) of the common tokens.

    Two similar sets that share no rare token have all their rare tokens in their difference, so each is still similar to the
    set with the fewest rare tokens among those of the other's class, and these firsts of two classes are similar to each
    other. Hence only pairs with a first are needed: links of a class's first with its own class follow from numbers of
    tokens alone, and sets that aren't similar to their first meet the firsts of other classes only.

    (first, node): links inside a class; (node, class, n, rare, held, first): the firsts, and sets not linked to theirs."""
    held = common.groupBy("node").agg(F.count("*").alias("held"), F.bit_xor("key").alias("c1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("c2"))
    held = held.join(by_token.select("node", "n").hint("merge"), "node").filter(F.col("held") * bands.den >= F.col("n") * bands.num)
    held = held.withColumn("rare", F.col("n") - F.col("held"))
    of = ["held", "c1", "c2"]
    first = held.groupBy(*of).agg(F.min(F.struct("rare", "node")).alias("f")).select(*of, F.col("f.rare").alias("least"), F.col("f.node").alias("first"))
    named = scratch.write(held.join(first.hint("merge"), of).drop("c1", "c2"), "classes-of")
    own = F.col("held") * (bands.den - bands.num) >= (F.col("rare") + F.col("least")) * bands.num
    linked = named.filter(own & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
    return linked, named.filter(~own | (F.col("node") == F.col("first"))).select("node", "n", "rare", "held", (F.col("node") == F.col("first")).alias("first"))


def members(common: DataFrame, left: DataFrame, bands: Bands) -> DataFrame:
    """(key, node, n, rare, first, firsts, size): the sets of `left` in the groups of some of their common tokens.

    Of the common tokens, by size of the group, so many suffice as can differ, and one. A group with one first only, and a set
    with too many rare tokens for the least of a group's firsts, has no pair."""
    order = Window.partitionBy("node").orderBy("size", "key")  # no more rows than the set has tokens
    rows = common.select("key", "node", "size").join(left.hint("merge"), "node").withColumn("k", F.row_number().over(order))
    rows = rows.filter(F.col("k") <= F.col("held") - F.ceil(F.col("n") * bands.num / bands.den) + 1).select("key", "node", "n", "rare", "first")
    firsts = rows.groupBy("key").agg(F.count_if("first").alias("firsts"), F.min(F.when(F.col("first"), F.col("rare"))).alias("least")).filter("firsts > 1")
    differ = F.floor((F.col("n") + F.floor(F.col("n") * bands.den / bands.num)) * (bands.den - bands.num) / (bands.den + bands.num))
    rows = rows.join(firsts.hint("merge"), "key").filter(F.col("rare") + F.col("least") <= differ).drop("firsts", "least")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if("first").alias("firsts")).filter("firsts > 1 OR size > firsts")
    return rows.join(sizes.hint("merge"), "key")


def cells(rows: DataFrame) -> DataFrame:
    """members() with sketches and components, by cell: a block of a group's firsts (centre) and a block of its sets. So a group's
    rows grow with the product of its sets and its firsts, over BLOCK, and a cell has a bounded number of either."""
    cut = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(n) * F.col("bytes") / BLOCK_BYTES)).cast("long")
    bytes_ = rows.groupBy("key").agg(F.ceil(F.avg(F.length("sketch"))).alias("bytes"))
    rows = rows.join(bytes_.hint("merge"), "key").withColumns({"of_sets": cut("size"), "of_firsts": cut("firsts")})
    rows = rows.withColumns({"x": F.pmod(F.xxhash64("node"), "of_sets"), "y": F.pmod(F.xxhash64("node", F.lit(1)), "of_firsts")})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["node", "n", "rare", "sketch", "component", "first"]
    centres = rows.filter("first").withColumn("x", upto("of_sets")).withColumn("centre", F.lit(True))
    others = rows.withColumn("y", upto("of_firsts")).withColumn("centre", F.lit(False))
    cell = F.when((F.col("of_sets") == 1) & (F.col("of_firsts") == 1), F.col("key")).otherwise(F.xxhash64("key", "x", "y")).alias("cell")
    return centres.unionByName(others).select(cell, *columns, "centre")


def cross_classes(rows: DataFrame, bands: Bands, forest: bool) -> DataFrame:
    """cells(): pairs (a, b) of a first and another set of the cell whose components differ, whose sizes and rare tokens allow them to
    be similar and whose sketches are near enough. With forest, only pairs that are similar by an estimate are given, and of
    these no more than join what they join: fewer than a cell has sets."""

    def run(batches):
        for cell, *columns in groups(batches, 8):
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for i, j in zip(starts, np.append(starts[1:], len(cell)), strict=True):
                order = np.argsort(columns[1][i:j], kind="stable")
                node, n, rare, bits, component, first, centre = (c[i:j][order] for c in columns)
                first, centre = first.astype(bool), centre.astype(bool)
                of = np.unique(component, return_inverse=True)[1]
                sets_, lengths, folded = np.flatnonzero(~centre), np.array([len(x) for x in bits]), {}
                low = np.searchsorted(n[sets_], -(-n * bands.num // bands.den))
                high = np.searchsorted(n[sets_], n * bands.den // bands.num, side="right")
                all_bits, all_lengths = bits[sets_], lengths[sets_]
                for k in np.flatnonzero(centre).tolist():
                    some = sets_[low[k] : high[k]]
                    most = (n[some] + n[k]) * (bands.den - bands.num) // (bands.den + bands.num)
                    fits = (of[some] != of[k]) & (rare[some] + rare[k] <= most) & (~first[some] | (node[some] > node[k]))
                    at = np.flatnonzero(fits) + low[k]
                    if not len(at):
                        continue
                    length = np.minimum(all_lengths[at], lengths[k])
                    far = np.zeros(len(at), np.int64)
                    for m in np.unique(length).tolist():
                        if m not in folded:
                            folded[m] = np.stack([fold(x, m) for x in all_bits])
                        far[length == m] = np.bitwise_count(folded[m][at[length == m]] ^ fold(bits[k], m)).sum(axis=1, dtype=np.int64)
                    some, most = sets_[at], most[at - low[k]]
                    if forest:
                        # So many toggled tokens are to be expected where so many bits differ.
                        sure = -4.0 * length * np.log1p(-np.minimum(far / (4.0 * length), 0.999)) <= 0.95 * most
                        joined, one = np.unique(of[some[sure]], return_index=True)
                        some = some[sure][one]
                        of[np.isin(of, joined)] = of[k]
                    else:
                        some = some[far <= most]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[k], node[some])), pa.array(np.maximum(node[k], node[some]))], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, found: DataFrame, corpus: Corpus, bands: Bands, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b), distinct, that are similar: first by their sketches, then exactly by their texts. Few pairs go to what is
    known of b, and only the rest of what they name is shuffled."""
    side, few = found.select("node", "n", "sketch"), is_few(pairs)
    if few:
        side = side.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("w"))), F.col("node") == F.col("w"), "left_semi")
    close = side.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")).join(beside(pairs, few), "b")
    close = close.join(side.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")).hint("merge"), "a")
    num, den = bands.num, bands.den

    def by_sketch(batches):
        for batch in batches:
            c = {k: batch.column(k) for k in ("n_a", "n_b", "s_a", "s_b")}
            keep = [hamming(x.as_py(), y.as_py()) <= bands.differ(m.as_py(), n.as_py()) for m, n, x, y in zip(c["n_a"], c["n_b"], c["s_a"], c["s_b"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = scratch.write(close.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(by_sketch, "a long, b long"), f"{name}-near")
    if not close.limit(1).count():
        return close
    own = scratch.write(corpus.texts_of(close.select(F.explode(F.array("a", "b")).alias("w")), f"{name}-wanted").select("node", "text"), f"{name}-texts")
    both = own.select(F.col("node").alias("b"), F.col("text").alias("t_b")).join(beside(close, is_few(close)), "b")
    both = both.join(own.select(F.col("node").alias("a"), F.col("text").alias("t_a")).hint("merge"), "a")

    def exactly(batches):
        last, own_set = None, None  # pairs come sorted by a
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a"), batch.column("t_a"), batch.column("t_b"), strict=True):
                if (a := a.as_py()) != last:
                    last, own_set = a, shingles(x.as_py())
                other = shingles(y.as_py())
                common = len(np.intersect1d(own_set, other, assume_unique=True))
                keep.append(common > 0 and den * common >= num * (len(own_set) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scratch.write(both.select("a", "b", "t_a", "t_b").mapInArrow(exactly, "a long, b long"), f"{name}-links")


def open_groups(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component, size) of the groups of three or more that are in several components."""
    large = met.filter("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("node")).distinct()
    known = large.join(beside(labels, is_few(labels)), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high").select("key", "size")
    return known.join(several.hint("merge"), "key")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, whose components differ."""
    few = is_few(labels)
    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(beside(labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), few), c, "left")
    return pairs.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def extend(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """labels (node, component) after more links: only the components that these join are taken further."""
    few = is_few(labels)
    of = lambda c: beside(labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), few)
    joined = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = scratch.write(joined.filter("a <> b").distinct(), f"{name}-joined")
    if not joined.limit(1).count():
        return labels
    merged = components(joined, scratch, f"{name}-merged").select(F.col("node").alias("was"), F.col("component").alias("now"))
    kept = labels.join(beside(merged, is_few(merged)), F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    new = merged.join(beside(labels, few), F.col("was") == F.col("node"), "left_anti").select("was", "now")
    return scratch.write(kept.union(new), f"{name}-labels")


def link_groups(met: DataFrame, found: DataFrame, labels: DataFrame, more: DataFrame | None, corpus: Corpus, bands: Bands, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Follows the pairs of met, then all pairs of the small groups that are still in several components: labels after the
    former, the links (a, b) of the latter, and the rows (key, node, component, size) of the common keys.

    labels are those known so far, more are links that they don't hold yet."""
    seen = scratch.write(apart(met.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")), labels), f"{name}-pairs")
    scratch.release()
    links = verify(seen, found, corpus, bands, scratch, f"{name}-first")
    labels = extend(labels, links.union(more) if more else links, scratch, name)
    still = scratch.write(open_groups(met, labels), f"{name}-open")
    few = still.filter(F.col("size") < COMMON).join(found.select("node", "n", "sketch").distinct().hint("merge"), "node")
    pairs = scratch.write(cross(few, bands).distinct().join(beside(seen, is_few(seen)), ["a", "b"], "left_anti"), f"{name}-more")
    scratch.release()
    return labels, verify(pairs, found, corpus, bands, scratch, f"{name}-second"), still.filter(F.col("size") >= COMMON)


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """key, n_shingles (long) and component_id (long) of each row of docs: the least id reachable by links, itself included.

    Null, empty and blank texts have no shingles and no links. Rows with equal texts have equal sets and are linked; rows
    that share an id are one document and linked by any of their texts. Rows with a null id have a null component, and
    no shingles are counted for them if no row with an id has their text."""
    scratch, bands = Scratch(docs.sparkSession, "ngram-join"), Bands(similar)
    corpus = Corpus(docs, key, text, scratch)
    keyed = scratch.write(sets(corpus.all_texts(), bands), "keyed")
    scratch.release()
    met = scratch.write(meet(keyed.select(F.explode("keys").alias("key"), "node", "n"), bands), "met-0")
    found = scratch.write(keyed.drop("keys"), "sets")
    scratch.drop("keyed")
    sizes = found.select("node", "n", "sketch", "room").distinct().hint("merge")
    none = scratch.write(found.select("node", F.col("node").alias("component")).limit(0), "none")
    labels, more, common = link_groups(met, found, none, None, corpus, bands, scratch, "blocks")
    # Sets with too many common keys in one home, of empty blocks or of groups that stay in several components.
    crowded = common.groupBy("node", F.pmod("key", F.lit(2)).alias("home")).count().join(sizes.drop("sketch"), "node").filter("count > room").select("node")
    texts = corpus.texts_of(crowded.union(found.filter("room < 0 AND n > 0").select("node")).select(F.col("node").alias("w")), "crowded")
    by_token = scratch.write(tokens(texts), "tokens")
    met = scratch.write(meet(by_token.select(F.explode("keys").alias("key"), "node", "n"), bands), "met-1")
    labels, more, common = link_groups(met, found, labels, more, corpus, bands, scratch, "tokens")
    # Sets that have so many common tokens that all that they share with another can be common.
    common = scratch.write(common.select("key", "node", "size"), "common")
    if common.limit(1).count():
        inside, left = classes(common, by_token, bands, scratch)
        more = more.union(verify(inside, found, corpus, bands, scratch, "inside-class"))
        if left.filter("first").limit(2).count() == 2:
            rest = members(common, left, bands).join(by_token.select("node", "sketch").hint("merge"), "node")
            rest = scratch.write(rest, "rest")
            possible = rest.agg(F.sum("firsts")).first()[0] or 0
            for name, forest in (("sure", True), ("all", False))[possible <= FEW_PAIRS :] if possible else ():
                labels, more = extend(labels, more, scratch, f"before-{name}"), more.limit(0)
                now = rest.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
                pairs = scratch.write(cross_classes(cells(now), bands, forest).distinct(), f"{name}-pairs")
                more = verify(pairs, found, corpus, bands, scratch, name)
    labels = extend(labels, more, scratch, "last")
    of_node = corpus.firsts.join(found.select("node", "hash", "n").distinct().hint("merge"), ["node", "hash"]).join(beside(labels, is_few(labels)), "node", "left")
    of_node = of_node.select(F.col("hash").alias("node_hash"), "n", F.coalesce("component", "node").alias("component"))
    of_row = corpus.ids.join(scratch.write(of_node, "classes").hint("merge"), F.col("hash") == F.col("node_hash"), "left")
    component = F.when(F.coalesce("n", F.lit(0)) > 0, F.least("component", "id")).otherwise(F.col("id"))
    return of_row.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
