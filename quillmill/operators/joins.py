"""Incremental joins, hydration and ground-truth matching."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import decode_baseline_source, source_hints
from quillmill.sources.files import STORE_SCHEMA
from quillmill.sources.scratch import scratch_dir
from quillmill.sources.store import delete_rows, same

#: Pages in a run that is a key of a join; beginnings of titles that are sent to every task at a time.
PAGES, TITLE_BLOCK = 8, 100_000
#: Classes of chunks up to which their sizes are broadcast; files that hints name, and matches of their titles, up to which they are.
MOST_CLASSES, MOST_NAMED = 100_000, 100_000


def skip_ingested(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (book_id, sha256, ...) that no committed batch has; of equal contents in this one the first by name stays.
    A null book is a book of its own, null contents are equal, and a file without name stays if none of its content has one. Files and
    manifest meet in one shuffle."""
    known = manifest.select("book_id", "sha256", F.lit(True).alias("_known"))
    same_content = Window.partitionBy("book_id", "sha256")
    both = files.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    marked = both.withColumns({"_old": F.max("_known").over(same_content), "_first": F.min("filename").over(same_content)})
    return marked.filter(~F.col("_old") & F.col("filename").eqNullSafe(F.col("_first"))).drop("_known", "_old", "_first")


def skip_existing_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Before the costly encoder."""
    return chunks.join(store.select("chunk_id").hint("merge"), "chunk_id", "left_anti")


def delete_by_source(spark: SparkSession, path: str, files: DataFrame) -> int:
    """The chunks of files (book_id, source_file) go from the chunk store in path; only folders of books that have some
    are written anew, and their number is returned. No name and an empty one are the same."""
    named = files.select(F.nullif("book_id", F.lit("")).alias("book_id"), "source_file")
    return delete_rows(spark, path, STORE_SCHEMA, "book_id", named, ["book_id", "source_file"])


def hydrate(citations: DataFrame, store: DataFrame) -> DataFrame:
    """Citations (pos, chunk_id): each id once, at its first place; chunks that are gone stay as nulls."""
    once = citations.groupBy("chunk_id").agg(F.min("pos").alias("pos"))
    return once.hint("merge").join(store, "chunk_id", "left")


def reuse_cached(work: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses)."""
    return work.join(cache, key), work.join(cache.select(key), key, "left_anti")


def purge_stale_cache(files: DataFrame, images: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (sha256, image_shas) and images (image_sha256): what is left of both when only the files of keep (sha256)
    are; an image goes if only files that go have it."""
    left = files.join(keep.select("sha256"), "sha256", "left_semi")
    gone = files.join(keep.select("sha256"), "sha256", "left_anti")
    stale = gone.select(F.explode("image_shas").alias("image_sha256")).distinct().join(left.select(F.explode("image_shas").alias("image_sha256")).hint("merge"), "image_sha256", "left_anti")
    return left, images.join(stale.hint("merge"), "image_sha256", "left_anti")


def gt_page_match(hints: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hints (qid, file, first, last): chunks of the file that start on one of the pages, whole numbers. Files are cut into runs of
    PAGES pages, which are keys of the join beside the file, so a file that all hints name is spread over its runs.

    Both sides lose their repetitions before they meet, so that pairs, which are many more, need no distinct: a question's hints become
    one set of bits for each run, and copies of a chunk go. Only chunk ids that stand in several places can give a pair twice."""
    run = lambda c: F.floor(F.col(c) / PAGES)
    bit = lambda c: F.call_function("shiftleft", F.lit(1), c.cast("int"))
    asked = hints.filter("first <= last").select("qid", "file", "first", "last", F.explode(F.sequence(run("first"), run("last"))).alias("_run"))
    lo, hi = F.greatest(F.ceil("first") - F.col("_run") * PAGES, F.lit(0)), F.least(F.floor("last") - F.col("_run") * PAGES, F.lit(PAGES - 1))
    asked = asked.select("qid", "file", "_run", F.when(lo <= hi, bit(hi + 1) - bit(lo)).alias("_bits")).filter("_bits > 0")
    asked = asked.repartition("file", "_run").groupBy("file", "_run", "qid").agg(F.bit_or("_bits").alias("_bits"))  # no partial one before the shuffle
    there = places(chunks.select(F.col("source_file").alias("file"), "page_start", "chunk_id").filter("file IS NOT NULL AND page_start IS NOT NULL"))
    there = there.select("file", run("page_start").alias("_run"), "chunk_id", bit(F.pmod("page_start", F.lit(PAGES))).alias("_bit"), "_several")
    match = lambda some: asked.hint("merge").join(there.filter(some), ["file", "_run"]).filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select("qid", "chunk_id")
    return match("NOT _several").union(match("_several").distinct())


def places(chunks: DataFrame) -> DataFrame:
    """Chunks (file, page_start, chunk_id) without copies, and whether the id stands in several places (_several). The rows of an id are
    sorted in one task, nothing is gathered."""
    w, place = Window.partitionBy("chunk_id").orderBy("file", "page_start"), F.struct("file", "page_start")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = chunks.withColumns({"_copy": place.eqNullSafe(F.lag(place).over(w)), "_several": F.first(place).over(whole) != F.last(place).over(whole)})
    return marked.filter("NOT _copy").drop("_copy")


def interval_overlap(left: DataFrame, right: DataFrame, key: str, bucket: int) -> DataFrame:
    """Left (l_id, key, l0, l1), right (r_id, key, r0, r1): pairs that overlap, half-open, so touching ends don't count.

    Both sides go to the time buckets that they touch; a pair is kept in the bucket where it begins to overlap, so no pair
    comes twice and a long common key is spread over its buckets. bucket: about the usual length."""
    cut = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.greatest(F.floor((F.col(b) - 1e-9) / bucket), F.floor(F.col(a) / bucket)))))
    pairs = cut(left, "l0", "l1").hint("merge").join(cut(right, "r0", "r1"), [key, "_bucket"])
    meet = (F.col("l0") < F.col("r1")) & (F.col("r0") < F.col("l1"))
    first = F.col("_bucket") == F.floor(F.greatest("l0", "r0") / bucket)
    return pairs.filter(meet & first).drop("_bucket")


def gt_section_match(hints: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hints (qid, file, title): chunks of the file that hold the title's first twenty signs, in either case.

    The beginnings of titles, a stated set, go to the tasks in blocks, and each content of a file that a hint names is read once for a
    block. What was found is written, once for each file and beginning that are asked for together, and then meets the hints: up to
    MOST_NAMED matches go to them, so that many hints of one title stay where they are. An empty title is in all."""
    asked = hints.select("qid", "file", F.lower(F.substring("title", 1, 20)).alias("start"))
    spark, root = hints.sparkSession, scratch_dir(hints.sparkSession, "titles")
    wanted = asked.select("file", "start").distinct()
    wanted.write.mode("overwrite").parquet(f"{root}/wanted")
    wanted = spark.read.schema(wanted.schema).parquet(f"{root}/wanted")
    way = lambda df: "broadcast" if df.limit(MOST_NAMED + 1).count() <= MOST_NAMED else "merge"
    files = wanted.select("file").distinct()
    there = chunks.select(F.col("source_file").alias("file"), F.lower("content").alias("content"), "chunk_id").filter("content IS NOT NULL")
    there = there.join(files.hint(way(files)), "file", "left_semi")
    schema = ", ".join(f"{c} {there.schema[c].dataType.simpleString()}" for c in ("file", "chunk_id")) + ", start string"
    found = there.select("file", "chunk_id", F.lit("").alias("start"))
    for block in blocks_of(wanted.filter("start <> ''").select("start").distinct(), TITLE_BLOCK):
        shared = chunks.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            trie = ahocorasick.Automaton()
            for start in shared.value:
                trie.add_word(start, start)
            trie.make_automaton()
            for pdf in batches:
                rows = [(f, c, start) for f, text, c in zip(pdf["file"], pdf["content"], pdf["chunk_id"], strict=True) for start in {s for _, s in trie.iter(text)}]
                yield pd.DataFrame(rows, columns=["file", "chunk_id", "start"])

        found = found.union(there.mapInPandas(run, schema))
    found = wanted.hint("merge").join(found, ["file", "start"]).distinct()
    found.write.mode("overwrite").parquet(f"{root}/found")
    found = spark.read.schema(found.schema).parquet(f"{root}/found")
    return asked.join(found.hint(way(found)), ["file", "start"]).select("qid", "chunk_id").distinct()


def blocks_of(values: DataFrame, size: int) -> Iterator[list]:
    """The values of a stated set's only column, size at a time."""
    block: list = []
    for (v,) in values.toLocalIterator():
        block.append(v)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def apply_overrides(hints: DataFrame, manual: DataFrame) -> DataFrame:
    """The manual hints of a question replace all parsed ones."""
    return hints.join(manual.select("qid").distinct().hint("merge"), "qid", "left_anti").unionByName(manual)


def hits(truth: DataFrame, retrieved: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """Truth (qid, chunk_id), retrieved (qid, round, chunk_id, rank): (qid, hit), whether one is within the first k. With asked,
    the questions (qid) that have a truth, truth may be only the pairs among retrieved, as truth_among() gives them."""
    found = retrieved.filter(F.col("rank") <= k).select("qid", "chunk_id").distinct().withColumn("_f", F.lit(True))
    hit = truth.distinct().join(found.hint("merge"), ["qid", "chunk_id"], "left").groupBy("qid").agg(F.max(F.coalesce("_f", F.lit(False))).alias("hit"))
    if asked is None:
        return hit
    return asked.select("qid").distinct().hint("merge").join(hit, "qid", "left").select("qid", F.coalesce("hit", F.lit(False)).alias("hit"))


def truth_among(ranked: DataFrame, asked: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """Truth by classes: all other chunks (chunk_id, by) of its class belong to a question (qid, by). The pairs (qid, chunk_id) of
    ranked that do; a class is never multiplied out, so there are no more rows than in ranked."""
    pairs = ranked.select("qid", "chunk_id").distinct().filter("qid <> chunk_id")
    own = asked.select("qid", F.col(by).alias("_q")).distinct()
    there = chunks.select("chunk_id", F.col(by).alias("_c")).distinct()
    return pairs.hint("merge").join(own, "qid").hint("merge").join(there, "chunk_id").filter("_q = _c").select("qid", "chunk_id").distinct()


def truth_sizes(asked: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """(qid, n): how many chunks belong to each question by classes as truth_among() takes them; questions without any are left out."""
    there = chunks.select("chunk_id", by).distinct()
    sizes = there.groupBy(by).agg(F.count("*").alias("_n"))  # partly summed where the rows are
    own = asked.select("qid", by).distinct()
    itself = own.join(there.withColumnRenamed("chunk_id", "qid").withColumn("_s", F.lit(1)).hint("merge"), ["qid", by], "left")
    few = sizes.limit(MOST_CLASSES + 1).count() <= MOST_CLASSES  # a class's questions stay where they are
    n = itself.join(sizes.hint("broadcast" if few else "merge"), by).withColumn("n", F.col("_n") - F.coalesce("_s", F.lit(0)))
    return n.groupBy("qid").agg(F.sum("n").alias("n")).filter("n > 0")


def baseline_hints(sources: DataFrame, source: str = "source") -> DataFrame:
    """Sources (qid, source) decoded, for gt_page_match and interval_overlap."""
    s = sources.withColumn("_s", decode_baseline_source(F.col(source)))
    return s.select("qid", "_s.file", F.col("_s.page").alias("first"), F.col("_s.page").alias("last"), F.col("_s.start").alias("l0"), F.col("_s.end").alias("l1"))


def derive_ground_truth(qa: DataFrame, manual: DataFrame, chunks: DataFrame) -> DataFrame:
    """Qa (id, source_location), manual hints of the same columns as the parsed ones, chunks: (qid,
    method, chunk_ids). The method is that of the question's last hint that has one."""
    parsed = qa.select(F.col("id").alias("qid"), F.posexplode(source_hints(F.col("source_location"))).alias("pos", "h"))
    parsed = parsed.select("qid", "pos", "h.kind", "h.file", F.col("h.first").cast("double").alias("first"), F.col("h.last").cast("double").alias("last"), "h.title")
    h = apply_overrides(parsed, manual.select(parsed.columns))
    pages = gt_page_match(h.filter("kind = 'page'"), chunks)
    sections = gt_section_match(h.filter("kind = 'section'"), chunks)
    times = interval_overlap(
        h.filter("kind = 'audio'").select("qid", "file", F.col("first").alias("l0"), F.col("last").alias("l1")),
        chunks.filter("start_sec IS NOT NULL").select("chunk_id", F.col("source_file").alias("file"), F.col("start_sec").alias("r0"), F.col("end_sec").alias("r1")), "file", 60,
    )
    found = pages.union(sections).union(times.select("qid", "chunk_id")).distinct().groupBy("qid").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    named = h.filter("kind IN ('page', 'audio', 'section')").groupBy("qid").agg(F.max_by("kind", "pos").alias("method"))
    out = h.select("qid").distinct().join(named.hint("merge"), "qid", "left").join(found.hint("merge"), "qid", "left")
    return out.select("qid", F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
