"""Sources and sinks: files of a corpus, transcripts, chunk stores, manifests, failure reports, result files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import delete_rows, exists, same

#: Supported extensions and the branch that reads them.
ROUTES = {"pdf": ("pdf",), "epub": ("epub",), "audio": ("mp3", "wav", "m4a"), "image": ("png", "jpg", "jpeg", "webp", "svg")}
#: The most that a row can hold of a file: an array of bytes in the JVM has fewer than 2**31.
MAX_BYTES = 2**31 - 2**16
#: Columns of the result file, in order.
RESULT_COLUMNS = (
    "id", "type", "run", "question", "expected_tool", "triggered_tool", "format_ok", "fill_ok", "tool_accuracy_ok", "final_answer", "total_tokens", "prompt_tokens", "completion_tokens", "latency_s",
)
CHUNK_SCHEMA = T.StructType(
    [T.StructField("chunk_id", T.StringType(), False)]
    + [T.StructField(n, T.StringType()) for n in ("book_id", "source_file", "element_type", "content")]
    + [T.StructField(n, T.IntegerType()) for n in ("token_count", "page_start", "page_end")]
    + [T.StructField("start_sec", T.DoubleType()), T.StructField("end_sec", T.DoubleType()), T.StructField("low_confidence", T.BooleanType())]
)
STORE_SCHEMA = (
    "chunk_id string, source_file string, element_type string, content string, token_count int, page_start int, page_end int, "
    "start_sec double, end_sec double, low_confidence boolean, embedding array<float>, book_id string"
)
MANIFEST_SCHEMA = "book_id string, sha256 string, source_file string"
SEGMENT_SCHEMA = "book_id string, source_file string, segments array<struct<text:string,start:double,end:double,words:array<struct<word:string,score:double>>,speaker:string>>"
CASE_SCHEMA = "id string, type string, question string, expected_tool string, expected_answer string"
BENCH_SCHEMA = "id string, parser string, elapsed_sec double, char_count int, elements array<struct<type:string,content:string,page_num:int>>, error string"
SCORECARD_SCHEMA = "id string, parser string, element_type string, detect string, content string, struct string, notes string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def any_case(extensions: Sequence[str]) -> str:
    """A glob of file names with one of the extensions, in either case."""
    letters = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*.{" + ",".join(letters(e.lstrip(".")) for e in extensions) + "}"


def _listed(spark: SparkSession, dirs: Sequence[str], extensions: Sequence[str] | None) -> DataFrame:
    wanted = extensions or [e for v in ROUTES.values() for e in v]
    return spark.read.format("binaryFile").option("pathGlobFilter", any_case(wanted)).load(list(dirs)).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def read_corpus_files(spark: SparkSession, dirs: Sequence[str], extensions: Sequence[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Path, filename, content and sha256 of the files of the folders, not of their subfolders, with a supported extension in
    either case and at most max_bytes. Names are filtered when folders are listed and lengths before a file is opened, so nothing
    else is read; rows have no order, list_corpus_files() has that of names."""
    files = _listed(spark, dirs, extensions).filter(F.col("length") <= max_bytes)
    return files.select("path", "filename", "content", F.sha2("content", 256).alias("sha256"))


def list_corpus_files(spark: SparkSession, dirs: Sequence[str], extensions: Sequence[str] | None = None) -> DataFrame:
    """Path, filename and length of the same files of any length, sorted by name; no content is read."""
    return _listed(spark, dirs, extensions).select("path", "filename", "length").orderBy("filename", "path")


def oversize_failures(spark: SparkSession, dirs: Sequence[str], extensions: Sequence[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files too long for read_corpus_files(), as rows of the failure report."""
    files = _listed(spark, dirs, extensions).filter(F.col("length") > max_bytes)
    message = F.concat(F.col("length").cast("string"), F.lit(f" bytes, more than {max_bytes}"))
    return files.select(F.col("filename").alias("file"), F.lit("oversize").alias("error_type"), message.alias("error_message"))


def route_by_extension(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds route (pdf, epub, audio, image) and failure; a file without route has a failure."""
    e = extension(F.col(path))
    route = F.coalesce(*(F.when(e.isin(list(v)), k) for k, v in ROUTES.items()))
    return files.withColumn("route", route).withColumn("failure", F.when(F.col("route").isNull(), "unsupported extension"))


def staged_file_validation(staged: DataFrame, present: DataFrame) -> DataFrame:
    """Staged (path) with a reason: missing, unsupported or null if it can be taken; present: (path) of what exists."""
    there = present.select(F.col("path").alias("_there")).distinct()
    e = extension(F.col("path"))
    reason = F.when(F.col("_there").isNull(), "missing").when(~e.isin([x for v in ROUTES.values() for x in v]), "unsupported")
    return staged.join(there, F.col("path") == F.col("_there"), "left").select("path", reason.alias("reason"))


def read_images_as_figures(files: DataFrame, *keep: str) -> DataFrame:
    """An image file is one figure element with its bytes, page 0; keep: columns of files that stay."""
    image = files.filter(extension(F.col("path")).isin(list(ROUTES["image"])))
    return image.select(
        *keep, F.col("filename").alias("source_file"), F.lit(0).alias("elem_idx"), F.lit("figure").alias("type"), F.concat(F.lit("![]("), "filename", F.lit(")")).alias("content"),
        F.lit(0).alias("page_num"), F.col("content").alias("image_bytes"), F.lit(None).cast("string").alias("vlm_status"),
    )


def segment_rows(transcripts: DataFrame) -> DataFrame:
    """One row for each segment in order; its score is the mean of the words that have one, else 1.0."""
    s = transcripts.select("book_id", "source_file", F.posexplode("segments").alias("seg_idx", "s"))
    scored = F.filter(F.transform("s.words", lambda w: w["score"]), lambda x: x.isNotNull())
    score = F.coalesce(F.aggregate(scored, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scored), F.lit(0)), F.lit(1.0))
    return s.select("book_id", "source_file", "seg_idx", "s.text", F.col("s.start").alias("start"), F.col("s.end").alias("end"), score.alias("score"), "s.speaker")


def read_asr_segments(spark: SparkSession, path: str) -> DataFrame:
    return segment_rows(spark.read.schema(SEGMENT_SCHEMA).json(path))


def write_chunks(chunks: DataFrame, path: str, last: Callable[[DataFrame], DataFrame] = lambda some: some) -> None:
    """Appended to the store, a folder for each book, so that a query of one book reads that folder only. last adds columns
    that needn't be shuffled."""
    last(chunks.repartition("book_id", F.pmod(F.xxhash64("chunk_id"), F.lit(16)))).write.partitionBy("book_id").mode("append").parquet(path)


def dump_chunks_json(chunks: DataFrame, path: str, evaluation: bool = False) -> None:
    """All columns, or the eight that evaluation reads; 0.0 seconds stay 0.0."""
    few = ["chunk_id", "source_file", "element_type", "content", "page_start", "page_end", "start_sec", "end_sec"]
    (chunks.select(few) if evaluation else chunks).write.mode("overwrite").json(path)


def read_cases_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Test cases; blank lines are skipped."""
    return spark.read.schema(CASE_SCHEMA).json(path).filter("id IS NOT NULL")


def write_result_csv(results: DataFrame, path: str) -> None:
    """The fixed columns in order, with a header; other columns are left out, missing ones are empty."""
    columns = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS]
    results.select(columns).write.mode("overwrite").csv(path, header=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, sha256, source_file) of all committed batches; empty if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def commit_manifest(new: DataFrame, path: str, batch: int | str) -> None:
    """What no batch has committed is added below the batch's folder, so a repeated commit adds nothing and a batch that is
    run again for files held back keeps those it had."""
    known = read_manifest(new.sparkSession, path).select("book_id", "sha256").alias("r")
    fresh = new.groupBy("book_id", "sha256").agg(F.min("source_file").alias("source_file")).alias("l").join(known.hint("merge"), same("l", "r", ["book_id", "sha256"]), "left_anti")
    fresh.select("book_id", "sha256", "source_file").write.mode("append").parquet(f"{path}/batch={batch}")


def remove_from_manifest(spark: SparkSession, path: str, files: DataFrame) -> int:
    """Files (book_id, source_file) are no longer known, so they can be ingested anew; the number of batches rewritten."""
    return delete_rows(spark, path, f"{MANIFEST_SCHEMA}, batch string", "batch", files, ["book_id", "source_file"])


def write_failures(failed: DataFrame, not_attempted: DataFrame, aborted: bool, path: str) -> DataFrame:
    """Failed (file, error_type, error_message) and files that were not attempted (file), as one report. aborted: whether the
    batch stopped early, after failures in a row; files that wait for a describer are not attempted in a batch that went to its end."""
    a = failed.select("file", "error_type", "error_message", F.current_timestamp().alias("timestamp"), F.lit(True).alias("attempted"))
    b = not_attempted.select("file", F.lit(None).cast("string"), F.lit(None).cast("string"), F.current_timestamp(), F.lit(False))
    report = a.union(b).withColumn("aborted_early", F.lit(aborted))
    report.write.mode("overwrite").json(path, compression="gzip")
    return report


def read_bench_results(spark: SparkSession, path: str) -> DataFrame:
    """S15."""
    return spark.read.schema(BENCH_SCHEMA).json(path, multiLine=True)


def read_scorecard(spark: SparkSession, path: str) -> DataFrame:
    """S15."""
    return spark.read.schema(SCORECARD_SCHEMA).csv(path, header=True)


def scorecard_skeleton(pages: DataFrame, parsers: Sequence[str]) -> DataFrame:
    """A row for each page and parser, with blank scores; parsers are a short given list."""
    blank = [F.lit("").alias(c) for c in ("detect", "content", "struct", "notes")]
    return pages.select("id", F.explode(F.array(*map(F.lit, parsers))).alias("parser"), "element_type", *blank)


def append_turn(turns: DataFrame, path: str) -> None:
    """The log only grows."""
    turns.write.mode("append").parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """In the order of conversation and turn."""
    return spark.read.parquet(path).orderBy("conv_id", "turn")
