"""Ordered element tables from paged markdown and chapters, and what hangs on neighbours and images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import alt_text, classify_block, is_caption, strip_page_artifact, stripped

Describer = Callable[..., object]
#: Failures in a row after which a task calls for no further description.
MAX_FAILURES = 3


def read_paged_markdown(df: DataFrame, key: str, markdown: str, separator: str) -> DataFrame:
    """Key, page_num, content: the sections after each separator; what stands before the first one is dropped."""
    quoted = r"\Q" + separator + r"\E"
    parts = df.select(key, F.posexplode(F.split(markdown, quoted)).alias("page_num", "content"))
    return parts.filter("page_num >= 1").withColumn("content", strip_page_artifact(F.col("content")))


def split_markdown_blocks(text: Column) -> Column:
    """Blocks between blank lines; fenced code, and what stands between lines of $$, stay whole. An automaton over lines."""
    state = "struct<blocks:array<string>,open:array<string>,fence:string>"
    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.array().cast("array<string>").alias("open"), F.lit("").alias("fence")).cast(state)
    closed = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["blocks"], F.array(F.array_join(acc["open"], "\n")))).otherwise(acc["blocks"])

    def step(acc: Column, line: Column) -> Column:
        bare = stripped(line)
        mark = F.when(bare.startswith("```"), "```").when(bare == "$$", "$$").otherwise("")
        opens, ends = (acc["fence"] == "") & (mark != ""), (acc["fence"] != "") & (mark == acc["fence"])
        blank = (acc["fence"] == "") & (bare == "")
        one = F.array(line)
        return F.struct(
            F.when(opens | blank, closed(acc)).when(ends, F.concat(acc["blocks"], F.array(F.array_join(F.concat(acc["open"], one), "\n")))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(opens, one).when(blank | ends, F.array().cast("array<string>")).otherwise(F.concat(acc["open"], one)).alias("open"),
            F.when(opens, mark).when(ends, F.lit("")).otherwise(acc["fence"]).alias("fence"),
        ).cast(state)

    blocks = F.aggregate(F.split(text, "\n"), start, step, closed)
    return F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^\n+|\n+$", "")), lambda b: stripped(b) != "")


def markdown_elements(sections: DataFrame, key: str, dense: bool = True) -> DataFrame:
    """E01 and E02 over sections (key, page_num, content): key, elem_idx, type, content, page_num. Elements without content,
    like a fence with nothing in it, are left out. Unless dense, elem_idx has the order of the elements but gaps, and no
    content is shuffled."""
    blocks = sections.select(key, "page_num", F.posexplode(split_markdown_blocks(F.col("content"))).alias("_at", "_block"))
    blocks = blocks.withColumn("_c", classify_block(F.col("_block"))).filter("_c.content <> ''")
    at = F.row_number().over(Window.partitionBy(key).orderBy("page_num", "_at")) - 1 if dense else F.shiftleft(F.col("page_num").cast("bigint"), 32) + F.col("_at")
    return blocks.select(key, at.alias("elem_idx"), "_c.type", "_c.content", "page_num")


def assemble_spine(chapters: DataFrame, elements: DataFrame) -> DataFrame:
    """Chapters (book_id, spine_pos, chapter_id) and their elements (chapter_id, elem_idx, type, content): one ordered
    table; page_num is the position in the spine from 1; a section_break stands before each non-empty chapter but the first.
    Further columns of the elements stay."""
    placed = chapters.withColumn("page_num", F.row_number().over(Window.partitionBy("book_id").orderBy("spine_pos")))
    own = [c for c in elements.columns if c not in ("chapter_id", "book_id", "page_num", "elem_idx", "type", "content")]
    rows = placed.join(elements.hint("merge"), "chapter_id").select("book_id", "page_num", F.col("elem_idx").alias("_sub"), "type", "content", *own)
    full = rows.select("book_id", "page_num").distinct()
    first = Window.partitionBy("book_id").orderBy("page_num")
    breaks = full.withColumn("_n", F.row_number().over(first)).filter("_n > 1")
    breaks = breaks.select("book_id", "page_num", F.lit(-1).alias("_sub"), F.lit("section_break").alias("type"), F.lit("").alias("content"))
    order = Window.partitionBy("book_id").orderBy("page_num", "_sub")
    placed_rows = rows.unionByName(breaks, allowMissingColumns=True).withColumn("elem_idx", F.row_number().over(order) - 1)
    return placed_rows.select("book_id", "elem_idx", "type", "content", "page_num", *own)


def rebase_page_batches(elements: DataFrame, batches: DataFrame) -> DataFrame:
    """Batches (batch_id, start) say where a slice of pages began; page numbers become those of the whole file."""
    return elements.join(batches.select("batch_id", "start").hint("merge"), "batch_id").withColumn("page_num", (F.col("page_num") + F.col("start")).cast("int")).drop("start")


def page_mismatches(sections: DataFrame, batches: DataFrame) -> DataFrame:
    """Batches (batch_id, expected) whose number of sections is another one."""
    found = sections.groupBy("batch_id").agg(F.count("*").alias("found"))
    return batches.join(found.hint("merge"), "batch_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found <> expected").select("batch_id", "expected", "found")


def attach_image_bytes(elements: DataFrame, images: DataFrame) -> DataFrame:
    """Images (doc, ref, image_bytes) to the figures (doc, ..., content) that name them."""
    ref = F.regexp_extract("content", r"^!\[[^\]]*\]\(([^)]*)\)", 1)
    named = elements.withColumn("_ref", F.when(F.col("type") == "figure", ref))
    pictures = images.select(F.col("doc").alias("_doc"), F.col("ref").alias("_name"), "image_bytes")
    return named.join(pictures.hint("merge"), (F.col("doc") == F.col("_doc")) & (F.col("_ref") == F.col("_name")), "left").drop("_ref", "_doc", "_name")


def attach_caption(elements: DataFrame) -> DataFrame:
    """Caption of the next element of a figure, else empty."""
    order = Window.partitionBy("doc").orderBy("elem_idx")
    following = F.lead("content").over(order)
    fits = (F.col("type") == "figure") & (F.lead("type").over(order) == "text") & is_caption(following)
    return elements.withColumn("caption", F.when(fits, following).otherwise(F.lit("")))


def figure_prompt(caption: Column) -> Column:
    """E17."""
    ask = "Describe this figure for a reader who cannot see it."
    return F.when(caption != "", F.concat(F.lit(ask + " Its caption is: "), caption)).otherwise(F.lit(ask))


def figures_with_bytes(elements: DataFrame) -> DataFrame:
    """P03."""
    return elements.filter((F.col("type") == "figure") & F.col("image_bytes").isNotNull())


def figures_without_bytes(elements: DataFrame) -> DataFrame:
    """P03."""
    return elements.filter((F.col("type") == "figure") & F.col("image_bytes").isNull())


def unresolved_figures(elements: DataFrame, file: str = "source_file") -> DataFrame:
    """Files with a figure that has bytes and no status yet; they are held back."""
    waits = (F.col("type") == "figure") & F.col("image_bytes").isNotNull() & F.col("vlm_status").isNull()
    return elements.groupBy(file).agg(F.max(waits).alias("_w")).filter("_w").select(file)


def fresh_descriptions(elements: DataFrame, cache: DataFrame, describer: Describer, max_failures: int = MAX_FAILURES, at_once: int = 1, retries: int = 0, load: bool = False) -> DataFrame:
    """E18 with E19: (image_sha256, description, called) of the images that the cache lacks, each distinct one once.

    describer takes a series of at_once images; with load it is a function that gives such a describer and is called once for
    each task. A null or an exception is a failure, after as many retries; after max_failures in a row (0: never) a task's
    breaker is open, and its other images aren't called for: called is false. So a model that is down costs max_failures
    calls, with their retries, for each task. Images go by their hash."""
    images = figures_with_bytes(elements).groupBy(F.sha2("image_bytes", 256).alias("image_sha256")).agg(F.first("image_bytes").alias("image_bytes"))
    wanted = images.join(cache.select("image_sha256").hint("merge"), "image_sha256", "left_anti").sortWithinPartitions("image_sha256")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describe = describer() if load else describer
        in_a_row = 0
        for frame in frames:
            found: list[tuple[str | None, bool]] = []
            for i in range(0, len(frame), at_once):
                some = frame["image_bytes"].iloc[i : i + at_once].reset_index(drop=True)
                if max_failures and in_a_row >= max_failures:
                    found += [(None, False)] * len(some)
                    continue
                got = called_with_retries(describe, some, retries)
                found += [(d, True) for d in got]
                for d in got:
                    in_a_row = 0 if d is not None else in_a_row + 1
            yield pd.DataFrame({"image_sha256": frame["image_sha256"], "description": [d for d, _ in found], "called": [c for _, c in found]})

    return wanted.mapInPandas(run, "image_sha256 string, description string, called boolean")


def called_with_retries(describe: Callable[[pd.Series], pd.Series], images: pd.Series, retries: int) -> list[str | None]:
    """Descriptions of some images: those that failed are called for again; null if they fail to the end."""
    got: list[str | None] = [None] * len(images)
    for _ in range(retries + 1):
        left = [k for k, d in enumerate(got) if d is None]
        if not left:
            break
        try:
            new = list(describe(images.iloc[left].reset_index(drop=True)))
        except Exception:  # whatever a model raises: its images have no description
            continue
        for k, d in zip(left, new, strict=True):
            got[k] = None if d is None or d != d else str(d)
    return got


def with_descriptions(elements: DataFrame, known: DataFrame) -> DataFrame:
    """Figures with bytes get their description of known (image_sha256, description), and the status described; without
    one they are degraded. Content becomes [alt: ...] and the description."""
    marked = elements.withColumn("image_sha256", F.when(F.col("type") == "figure", F.sha2("image_bytes", 256)))
    # elements without an image have keys of their own, which no image has, so that they don't meet in one task
    marked = marked.withColumn("_image", F.coalesce("image_sha256", F.concat(F.lit("none "), F.xxhash64("elem_idx", "content"))))
    out = marked.join(known.select(F.col("image_sha256").alias("_image"), "description").hint("merge"), "_image", "left").drop("_image")
    alt = alt_text(F.col("content"))
    described = F.concat(F.when(alt != "", F.concat(F.lit("[alt: "), alt, F.lit("] "))).otherwise(F.lit("")), "description")
    status = F.when(F.col("image_sha256").isNotNull(), F.when(F.col("description").isNotNull(), "described").otherwise("degraded"))
    return out.withColumn("vlm_status", status).withColumn("content", F.coalesce(described, "content")).drop("description")


def describe_figures(elements: DataFrame, cache: DataFrame, describer: Describer, max_failures: int = MAX_FAILURES) -> DataFrame:
    """Both in one plan: descriptions from the cache (image_sha256, description) or from the describer."""
    fresh = fresh_descriptions(elements, cache, describer, max_failures).select("image_sha256", "description")
    return with_descriptions(elements, fresh.unionByName(cache.select("image_sha256", "description")))


def degrade_after_failures(calls: DataFrame, n: int, by: str, order: list[str], failed: Column) -> DataFrame:
    """Adds degraded: true for all rows of a group after n failures in a row. A success ends a run of failures."""
    w = Window.partitionBy(by).orderBy(*order)
    run = calls.withColumn("_failed", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_failed")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_length", F.sum("_failed").over(Window.partitionBy(by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    trips = F.max(F.when(F.col("_length") >= n, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return run.withColumn("degraded", F.coalesce(trips, F.lit(0)) == 1).drop("_failed", "_run", "_length")
