"""Ranked lexical search over a length-stratified index.

A document's score sums, over the distinct terms of an item, w * ((SCALE * tf) div (1000 * tf + K * m)), where w falls with
the number of documents that hold the term and m grows with the document's length. All documents of equal m are a stratum:
inside it a term's impact depends on tf alone, so it is computed once for each tf and shared by all its postings, and what
the stratum can give to an item at most follows from the greatest tf of each term. These bounds order the visits: the strata
of the highest bounds for an item give a first tenth-best score, then each task visits its strata from the highest bound
down and leaves out what stays below the best scores so far. Nothing else is left out, so results are exact.

The index is a table of blocks of up to BLOCK documents of one stratum (a third of all documents may have one length): their
ids, and by term and tf the places of the documents in the block. It is dealt out by range of m, written once, and serves any
items. Items are a stated query set: their terms go to the tasks in blocks of at most ITEM_TERMS (item, term) rows.

Terms are runs of ASCII letters, digits and all signs beyond ASCII; only A-Z are lower-cased. Documents without terms (null
and empty texts among them) are not counted and never found; items without terms, or whose terms no document has, have no
rows. Repeated documents are documents of their own; each row of items is ranked by itself. Equal scores rank by id, null ids
last. Long texts are taken whole, an empty table gives an empty table, and other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, rows_in_a_batch

#: Fixed values of the score: m = FLOOR + (SLOPE * n * N) div L, impact = (SCALE * tf) div (1000 * tf + K * m), w = floor(1000 * ln).
SLOPE, SCALE, K = 90, 1_000_000_000, 8
FLOOR = 100 - SLOPE
TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents and postings of a block of the index; (item, term) rows broadcast at once; blocks that give an item its first score.
BLOCK, POSTINGS, ITEM_TERMS, SEEDS = 512, 400_000, 500_000, 4
#: Blocks that a task holds at a time, whose bounds order its visits.
AT_A_TIME = 16
#: Cells of the matrix of scores that are summed at once.
CELLS = 4_000_000


def terms_of(text: str | None) -> Counter:
    """Terms as UTF-8, with their counts. Bytes beyond ASCII belong to signs beyond it, and lower() changes A-Z only."""
    return Counter(TERMS.findall(text.encode("utf-8", "surrogatepass").lower())) if text else Counter()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def bags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, terms (distinct, joined by blanks) and tfs (32-bit integers) of each row with at least one term."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.StringType()), T.StructField("tfs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, terms, tfs = [], [], []
            for t in batch.column(1):
                bag = terms_of(t.as_py())
                counts = np.fromiter(bag.values(), "<i4", len(bag))
                ns.append(int(counts.sum()))
                terms.append(b" ".join(bag))
                tfs.append(counts.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.binary())], names=schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).filter("n > 0")


@dataclass(frozen=True)
class Index:
    """blocks: block, m, ids, terms (by their bytes), dfs, tops (greatest tf) and runs of each term, tfs and sizes of the runs, and the
    places of their documents; n_docs documents hold n_terms terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


#: The numbers of a block, packed, and their types; a place and the size of a run fit two bytes, as BLOCK does.
PACKED = {"dfs": "<i4", "tops": "<i4", "runs": "<i4", "tfs": "<i4", "sizes": "<u2", "places": "<u2"}


def _blocks(key: T.DataType) -> T.StructType:
    named = {"block": T.LongType(), "m": T.LongType(), "ids": T.ArrayType(key), "terms": T.ArrayType(T.StringType(), False)} | dict.fromkeys(PACKED, T.BinaryType())
    return T.StructType([T.StructField(n, t, False) for n, t in named.items()])


def invert(terms: list[str], tfs: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Postings of a block by term and tf."""
    names: dict[bytes, int] = {}
    term = np.array([names.setdefault(t, len(names)) for bag in terms for t in bag.encode().split(b" ")], np.int32)
    tf = np.frombuffer(b"".join(tfs), "<i4")
    place = np.repeat(np.arange(len(tfs), dtype=np.int32), [len(x) // 4 for x in tfs])
    order = np.lexsort((place, tf, term))
    term, tf, place = term[order], tf[order], place[order]
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
    sizes, run_term, run_tf = np.diff(np.r_[starts, len(term)]), term[starts], tf[starts]
    ends = np.flatnonzero(np.r_[run_term[1:] != run_term[:-1], True])
    return list(names), [np.bincount(term), run_tf[ends], np.diff(np.r_[-1, ends]), run_tf, sizes, place]


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> Index:
    """The index of all documents: texts are read once, their terms move once, into the range of their stratum."""
    scratch = scratch or Scratch(docs.sparkSession, "lexical")
    with rows_in_a_batch(docs.sparkSession, BLOCK):
        found = scratch.write(bags(docs, key, text), "bags")
    n_docs, n_terms = found.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    stratum = F.expr(f"{FLOOR}L + ({SLOPE}L * n * {n_docs}L) div {max(1, n_terms)}L")
    dealt = found.withColumns({"m": stratum, "salt": F.xxhash64(F.monotonically_increasing_id())}).repartitionByRange("m", "salt").sortWithinPartitions("m", "salt")
    schema = _blocks(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, number = to_arrow_schema(schema), 0
        for batch in batches:
            ms = batch.column(0).to_numpy()
            sizes = np.cumsum(np.array([len(x.as_buffer()) // 4 for x in batch.column(3)]))
            start = 0
            for end in range(1, len(ms) + 1):
                before = int(sizes[start - 1]) if start else 0
                if end < len(ms) and ms[end] == ms[start] and end - start < BLOCK and int(sizes[end]) - before <= POSTINGS:
                    continue
                part = batch.slice(start, end - start)
                terms, ints = invert(part.column(2).to_pylist(), part.column(3).to_pylist())
                values = [number, int(ms[start]), part.column(1).to_pylist(), [t.decode() for t in terms], *(x.astype(t).tobytes() for x, t in zip(ints, PACKED.values(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)
                start, number = end, number + 1

    made = dealt.select("m", "key", "terms", "tfs").mapInArrow(run, schema).withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("block"))
    with rows_in_a_batch(docs.sparkSession, BLOCK):
        return Index(scratch.write(made, "blocks"), n_docs, n_terms)


class Queries:
    """Items as rows of term numbers, with the weights of the terms."""

    def __init__(self, items: list[list[str]], weights: dict[str, int]):
        names = {t: k for k, t in enumerate(weights)}
        self.terms = pa.array(list(names), pa.string())
        self.weights = np.array(list(weights.values()), np.int64)
        rows = [(k, [names[t] for t in item if t in names]) for k, item in enumerate(items)]
        rows = [(k, r) for k, r in rows if r]
        self.numbers = np.array([k for k, _ in rows], np.int64)
        self.flat = np.array([t for _, r in rows for t in r], np.int64)
        self.sizes = np.array([len(r) for _, r in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def sums(self, values: np.ndarray, row: np.ndarray, which: np.ndarray) -> np.ndarray:
        """For each of some items the sum of the values of its terms; row says where each term's values stand."""
        sizes = self.sizes[which]
        starts = np.cumsum(sizes) - sizes
        flat = self.flat[np.repeat(self.starts[which] - starts, sizes) + np.arange(int(sizes.sum()))]
        return np.add.reduceat(values[row[flat]], starts, axis=0)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return SCALE * tf // (1000 * tf + K * m)


def _column(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))[row].values


def _numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), PACKED[name])


def _local(q: Queries, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which terms of a block are asked for, and their numbers."""
    import pyarrow.compute as pc

    at = pc.fill_null(pc.index_in(terms, value_set=q.terms), -1).to_numpy()
    here = np.flatnonzero(at >= 0)
    return here, at[here]


def bounds(q: Queries, batch: pa.RecordBatch, row: int) -> np.ndarray:
    """The most that a block can give to each item."""
    here, numbers = _local(q, _column(batch, "terms", row))
    most = np.zeros(len(q.terms), np.int64)
    most[numbers] = q.weights[numbers] * impact(_numbers(batch, "tops", row)[here], batch.column(batch.schema.get_field_index("m"))[row].as_py())
    return q.sums(most, np.arange(len(q.terms)), np.arange(len(q.numbers)))


def scores(q: Queries, batch: pa.RecordBatch, row: int, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scores of all documents of a block for some items, a few items at a time."""
    here, numbers = _local(q, _column(batch, "terms", row))
    m, n = batch.column(batch.schema.get_field_index("m"))[row].as_py(), len(_column(batch, "ids", row))
    runs, tfs, sizes, places = (_numbers(batch, c, row) for c in ("runs", "tfs", "sizes", "places"))
    asked = np.full(len(runs), -1, np.int64)
    asked[here] = np.arange(len(here))
    by_run = np.repeat(asked, runs)
    each = np.repeat(by_run, sizes)
    value = np.zeros(len(by_run), np.int64)
    known = by_run >= 0
    # One impact for each run of a term and a tf.
    value[known] = q.weights[numbers[by_run[known]]] * impact(tfs[known], m)
    dense, kept = np.zeros((len(here) + 1, n), np.int64), each >= 0
    dense[each[kept], places[kept]] = np.repeat(value, sizes)[kept]
    local = np.full(len(q.terms), len(here), np.int64)
    local[numbers] = np.arange(len(here))
    step = max(1, CELLS // max(1, n * int(q.sizes.max())))
    for i in range(0, len(which), step):
        yield which[i : i + step], q.sums(dense, local, which[i : i + step])


class Best:
    """The k best documents of each item so far, and the score that a further one must reach."""

    def __init__(self, q: Queries, k: int, least: dict[int, int]):
        self.q, self.k = q, k
        self.least = np.array([max(1, least.get(int(n), 1)) for n in q.numbers], np.int64)
        self.held: list[list[tuple]] = [[] for _ in q.numbers]

    def visit(self, batch: pa.RecordBatch, row: int, which: np.ndarray) -> None:
        ids = _column(batch, "ids", row).to_pylist()
        for some, found in scores(self.q, batch, row, which):
            for i, j in zip(*(x.tolist() for x in np.nonzero(found >= self.least[some][:, None])), strict=True):
                item = int(some[i])
                if (score := int(found[i, j])) >= self.least[item]:
                    self.held[item].append((-score, ids[j] is None, 0 if ids[j] is None else ids[j]))
                    if len(self.held[item]) >= 20 * self.k:
                        self.shrink(item)

    def shrink(self, item: int) -> None:
        self.held[item] = heapq.nsmallest(self.k, self.held[item])
        if len(self.held[item]) == self.k:
            self.least[item] = max(int(self.least[item]), -self.held[item][-1][0])

    def rows(self) -> list[tuple]:
        for item in range(len(self.held)):
            self.shrink(item)
        return [(int(n), -s, None if none else i) for n, held in zip(self.q.numbers, self.held, strict=True) for s, none, i in held]


def _visits(index: Index, blocks: DataFrame, q: Queries, k: int, least: dict[int, int], only: dict[int, list[int]] | None = None) -> DataFrame:
    """number, score, key: the k best of each task for each item; only: the items that a block is visited for."""
    sent = blocks.sparkSession.sparkContext.broadcast((q, least, only))
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("score", T.LongType()), T.StructField("key", index.blocks.schema["ids"].dataType.elementType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        q, least, only = sent.value
        best, place = Best(q, k, least), {int(n): i for i, n in enumerate(q.numbers)}
        for batch in batches:
            limits = np.array([bounds(q, batch, r) for r in range(batch.num_rows)])
            for r in np.argsort(-limits.max(axis=1, initial=0), kind="stable").tolist() if len(q.numbers) else []:
                which = np.flatnonzero((limits[r] >= best.least) & (limits[r] > 0))
                if only is not None:
                    which = np.intersect1d(which, [place[n] for n in only.get(batch.column(0)[r].as_py(), [])])
                if len(which):
                    best.visit(batch, r, which)
                    for item in which.tolist():
                        if len(best.held[item]) >= k:
                            best.shrink(item)
        if rows := best.rows():
            out = to_arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return blocks.mapInArrow(run, schema)


def _seeds(index: Index, q: Queries, k: int) -> dict[int, int]:
    """For each item a score that its k best documents reach, from the blocks with the highest bounds for it."""
    sent = index.blocks.sparkSession.sparkContext.broadcast(q)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("number", "bound", "block")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        held: list[list[tuple]] = [[] for _ in q.numbers]
        for batch in batches:
            for r in range(batch.num_rows):
                for item, b in enumerate(bounds(q, batch, r).tolist()):
                    if b > 0 and (len(held[item]) < SEEDS or held[item][0][0] < b):
                        (heapq.heappush if len(held[item]) < SEEDS else heapq.heappushpop)(held[item], (b, batch.column(0)[r].as_py()))
        rows = [(int(n), b, block) for n, some in zip(q.numbers, held, strict=True) for b, block in some]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=schema.names)

    first = index.blocks.select("block", "m", "terms", "tops").mapInArrow(run, schema)
    w = Window.partitionBy("number").orderBy(F.desc("bound"), "block")
    only: dict[int, list[int]] = {}
    for number, block in first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SEEDS).select("number", "block").collect():  # SEEDS for each item
        only.setdefault(block, []).append(number)
    seen = _visits(index, index.blocks.filter(F.col("block").isin(list(only))), q, k, {}, only) if only else None
    if seen is None:
        return {}
    scored = seen.groupBy("number").agg(F.sort_array(F.collect_list("score"), False).alias("s")).filter(F.size("s") >= k)  # k for each of SEEDS blocks at most
    return {r[0]: r[1] for r in scored.select("number", F.col("s")[k - 1]).collect()}


def _frequencies(index: Index, asked: list[str]) -> dict[str, int]:
    """In how many documents each of some terms stands."""
    sent = index.blocks.sparkSession.sparkContext.broadcast(pa.array(asked, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        asked = sent.value
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column(0).flatten(), value_set=asked)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            np.add.at(total, pc.fill_null(at, 0).to_numpy()[known], np.frombuffer(b"".join(x.as_buffer() for x in batch.column(1)), PACKED["dfs"])[known])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], names=["term", "df"])

    counts = index.blocks.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {asked[r[0]]: r[1] for r in counts.collect()}


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """item, rank, doc and score of the k best documents of each row of items, with scores above 0."""
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "lexical")
    asked = bags(items, key, text).select("key", F.monotonically_increasing_id().alias("number"), F.split("terms", " ").alias("terms"))
    asked = scratch.write(asked, "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-total // ITEM_TERMS) or 1
    found = None
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == b).select("number", "terms").collect()  # about ITEM_TERMS terms
        with rows_in_a_batch(spark, AT_A_TIME):
            dfs = _frequencies(index, sorted({t for r in rows for t in r[1]}))
            weights = {t: w for t, df in dfs.items() if (w := weight(index.n_docs, df)) > 0}
            q = Queries([r[1] for r in rows], weights)
            if not len(q.numbers):
                continue
            names = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "number long, item_number long")
            part = _visits(index, index.blocks, q, k, _seeds(index, q, k)).join(names.hint("broadcast"), "number").select("item_number", "score", F.col("key").alias("doc"))
            part = scratch.write(part, f"found{b}")
        found = part if found is None else found.union(part)
    if found is None:
        doc = index.blocks.schema["ids"].dataType.elementType
        return spark.createDataFrame([], T.StructType([T.StructField("item", items.schema[key].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc", doc), T.StructField("score", T.LongType())]))
    w = Window.partitionBy("item_number").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.join(asked.select(F.col("number").alias("item_number"), F.col("key").alias("item")).hint("merge"), "item_number").select("item", "rank", "doc", "score")
