"""Queries of the streaming jobs: tables cut into several files, so that there are several micro-batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.registry import query, table
from quillmill.sources.scratch import scratch_dir
from quillmill.streaming import jobs

from .aggregates import HEADERS_SQL
from .elements import E19_SQL
from .ingest import PAGE, read_store
from .io import page_files, recordings


def cut(df, path: str, order: str, files: int = 3) -> str:
    """Files in the order of a column, each by one append, so that their times follow the order too."""
    for part in slices(df, order, files):
        part.write.mode("append").parquet(path)
    return path


def slices(df, order: str, n: int):
    """The rows of n equal ranges of a column, one after the other."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    for k in range(n):
        a, b = low + (high - low + 1) * k // n, low + (high - low + 1) * (k + 1) // n
        yield df.filter((F.col(order) >= a) & (F.col(order) < b))


def tails(spark, turns, root: str, tail):
    """tail(stream) over three slices of turns that arrive one after the other: each is read as one micro-batch however many files it
    has. The last row of each conversation."""
    keep = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/out/b={batch}")
    for part in slices(turns, "turn", 3):
        part.write.mode("append").parquet(f"{root}/in")
        jobs.run_batches(tail(jobs.read_stream(spark, f"{root}/in", None)), f"{root}/cp", keep, "update")
    return spark.read.parquet(f"{root}/out").groupBy("conv_id").agg(F.max_by("title", "batch").alias("title"), F.max("last_turn").alias("last_turn"))


ST1_SQL = """SELECT coalesce(regexp_extract(url, '://([^/?#]+)', 1), '') AS book_id, 'stored' AS place, count(DISTINCT html) AS n_files FROM pages WHERE html IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'talks', 'stored', count(DISTINCT conv_id) FROM conversations HAVING count(*) > 0
UNION ALL SELECT 'images', 'staged', count(*) FROM part HAVING count(*) > 0
UNION ALL SELECT 'suppliers', CASE WHEN s_suppkey % 2 = 0 THEN 'stored' ELSE 'staged' END, count(*) FROM supplier GROUP BY ALL"""


#: Of staged Parquet files that a micro-batch of the ingest takes.
BYTES_PER_BATCH = 1 << 30


@query("st1_incremental_ingest", ST1_SQL)
def _(spark, d):
    """Files of all four routes, staged in several parquet files: pages as books, conversations as recordings, parts as images
    without a describer, suppliers as converted pages, every second one in a file of no route. What is stored has left the
    folder, the rest stays in it; started again, the run adds nothing. Batches are counted in bytes, so their number doesn't follow
    that of small files."""
    root = scratch_dir(spark, "st1")
    name = lambda key, ext: F.concat(F.lpad(F.col(key).cast("string"), 9, "0"), ext if isinstance(ext, Column) else F.lit(ext)).alias("filename")
    books = page_files(spark, d).filter("html IS NOT NULL").select("book_id", F.regexp_replace("filename", "html$", "epub").alias("filename"), F.array("html").alias("chapters"))
    images = table(spark, d, "part").select(F.lit("images").alias("book_id"), name("p_partkey", ".png"), F.col("p_name").cast("binary").alias("content"))
    ext = F.when(F.col("s_suppkey") % 2 == 0, ".pdf").otherwise(".doc")
    text = F.concat(F.lit(PAGE), "s_name", F.lit(" "), F.col("s_suppkey").cast("string"))
    other = table(spark, d, "supplier").select(F.lit("suppliers").alias("book_id"), name("s_suppkey", ext), text.alias("markdown"))
    files = books
    for more in (recordings(spark, d), images, other):
        files = files.unionByName(more, allowMissingColumns=True)
    source = cut(files.withColumn("n", F.crc32("filename")), f"{root}/in", "n")
    for _ in range(2):
        jobs.incremental_ingest(spark, source, root, None, BYTES_PER_BATCH)
    stored = read_store(spark, f"{root}/store").select("book_id", F.lit("stored").alias("place"), "source_file").distinct()
    staged = spark.read.parquet(source).select("book_id", F.lit("staged").alias("place"), F.col("filename").alias("source_file"))
    return stored.union(staged).groupBy("book_id", "place").agg(F.count("*").alias("n_files"))


@query("st2_stream_dedup", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def _(spark, d):
    root = scratch_dir(spark, "st2")
    source = cut(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), f"{root}/in", "doc_id")
    return jobs.run_to_table(jobs.stream_dedup(jobs.read_stream(spark, source), ["sha256"]), f"{root}/cp", f"{root}/out").select("sha256")


@query("st2_stream_dedup_within")
def _(spark, d):
    root = scratch_dir(spark, "st2w")
    source = cut(table(spark, d, "events"), f"{root}/in", "event_id")
    return jobs.run_to_table(jobs.stream_dedup_within(jobs.read_stream(spark, source), ["user_id", "event_type"], "ts", "1 day"), f"{root}/cp", f"{root}/out").select("user_id", "event_type", "event_id")


ST3_SQL = """WITH r AS (SELECT min(event_id) AS low, max(event_id) - min(event_id) + 1 AS span FROM events),
  e AS (SELECT *, (SELECT count(*) FROM range(1, 3) AS k(k), r WHERE event_id >= low + span * k // 3) AS slice FROM events)
  SELECT slice, count(*) AS n_rows, count(*) FILTER (event_type = 'purchase') AS n_done, min(event_id) AS first, max(event_id) AS last FROM e GROUP BY slice"""


@query("st3_progress_counts", ST3_SQL)
def _(spark, d):
    """The table that a listener wrote of a run over three slices of events, each of one file or more: what it says of each."""
    root, events = scratch_dir(spark, "st3"), table(spark, d, "events")
    source = cut(events, f"{root}/in", "event_id")
    ends = (F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    seen = jobs.progress_counts(jobs.read_stream(spark, source), "progress", F.col("event_type") == "purchase", *ends)
    progress = jobs.run_with_progress(seen, "progress", f"{root}/cp", f"{root}/out", f"{root}/progress")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    slices = sum((F.col("first") >= low + (high - low + 1) * k // 3).cast("bigint") for k in (1, 2))
    return progress.groupBy(slices.alias("slice")).agg(F.sum("rows").alias("n_rows"), F.sum("done").alias("n_done"), F.min("first").alias("first"), F.max("last").alias("last"))


@query("st4_conversation_tail", f"SELECT conv_id, title, (updated_at - conv_id) // 60 AS last_turn FROM ({HEADERS_SQL}) AS h")
def _(spark, d):
    return tails(spark, table(spark, d, "conversations"), scratch_dir(spark, "st4"), jobs.conversation_tail)


@query("st5_failure_breaker", E19_SQL.replace("SELECT event_id, ", "SELECT user_id, event_id, "))
def _(spark, d):
    """Events arrive in three slices of time, each read as one micro-batch however many files it has; the ids needn't follow time."""
    root, at = scratch_dir(spark, "st5"), F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    bounds = [low + (high - low + 1) * k // 3 for k in range(4)]
    with jobs.keyed_state(spark):
        for a, b in zip(bounds, bounds[1:], strict=False):
            events.filter((at >= a) & (at < b)).write.mode("append").parquet(f"{root}/in")
            found = jobs.run_to_table(jobs.failure_breaker(jobs.read_stream(spark, f"{root}/in", None), 3), f"{root}/cp", f"{root}/out")
    return found


@query("st4_conversation_tail_expiring", f"SELECT conv_id, title, (updated_at - conv_id) // 60 AS last_turn FROM ({HEADERS_SQL}) AS h")
def _(spark, d):
    """State is forgotten after a century of silence, which no conversation of these has."""
    turns = table(spark, d, "conversations").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("conv_id") + 60 * F.col("turn")))
    with jobs.keyed_state(spark):
        return tails(spark, turns, scratch_dir(spark, "st4e"), lambda stream: jobs.conversation_tail_expiring(stream, 100 * 365 * 86_400_000, "36500 days"))
