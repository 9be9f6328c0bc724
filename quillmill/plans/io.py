"""Queries that write and read back: each works on the given tables, in a folder that the cluster shares."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillmill.registry import query, table
from quillmill.sources import files as io
from quillmill.sources.scratch import scratch_dir

from . import views
from .ingest import PAGE, delete_files, ingest_files, ingest_pages, read_store, roll_back


def page_files(spark, d):
    return table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("book_id"), F.concat(F.lit("p"), F.format_string("%09d", "page_id"), F.lit(".html")).alias("filename"), "html")


@query("s01_read_corpus_files", "SELECT coalesce(source, '') AS source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    """Whole texts as files of some hundred lines in a folder for each source."""
    path = scratch_dir(spark, "files")
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("source"), F.col("text").alias("value"))
    rows.withColumn("folder", F.hex("source")).drop("source").write.mode("overwrite").option("maxRecordsPerFile", 500).partitionBy("folder").text(path)
    files = io.read_corpus_files(spark, [f"{path}/*"], ["txt"])
    source = F.decode(F.unhex(F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^folder=(__HIVE_DEFAULT_PARTITION__)?", "")), "UTF-8")
    return files.groupBy(source.alias("source")).agg(F.sum(F.length("content")).alias("n_bytes"))


@query("s08_read_images_as_figures", "SELECT 'i' || page_id || '.PNG' AS source_file, 'figure' AS type, '![](i' || page_id || '.PNG)' AS content, 0 AS page_num, CAST(octet_length(encode(html)) AS INT) AS n_bytes FROM pages WHERE url IS NOT NULL")
def _(spark, d):
    found = table(spark, d, "pages").select(F.concat("url", F.lit("/i.PNG")).alias("path"), F.concat(F.lit("i"), F.col("page_id").cast("string"), F.lit(".PNG")).alias("filename"), F.encode("html", "UTF-8").alias("content"))
    return io.read_images_as_figures(found).select("source_file", "type", "content", "page_num", F.length("image_bytes").alias("n_bytes"))


CHUNK_COLUMNS = "chunk_id, book_id, source_file, element_type, content, token_count, page_start, page_end"


@query("s09_write_chunks", f"SELECT {CHUNK_COLUMNS} FROM ({views.CHUNKS_SQL}) AS c")
def _(spark, d):
    path = scratch_dir(spark, "store")
    io.write_chunks(views.chunks(spark, d), path)
    return spark.read.parquet(path).select(CHUNK_COLUMNS.split(", "))


@query("s10_dump_chunks_json", f"SELECT {CHUNK_COLUMNS} FROM ({views.CHUNKS_SQL}) AS c")
def _(spark, d):
    path = scratch_dir(spark, "dump")
    io.dump_chunks_json(views.chunks(spark, d), path)
    return spark.read.schema(io.CHUNK_SCHEMA).json(path).select(CHUNK_COLUMNS.split(", "))


@query("s11_read_cases_jsonl", "SELECT CAST(item_id AS VARCHAR) AS id, text AS question FROM benchmark")
def _(spark, d):
    path = scratch_dir(spark, "cases")
    table(spark, d, "benchmark").select(F.concat(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.lit("retrieve").alias("type"), F.col("text").alias("question"))), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
    return io.read_cases_jsonl(spark, path).select("id", "question")


@query("s12_write_result_csv", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, CAST(value AS VARCHAR) AS latency_s FROM events")
def _(spark, d):
    path = scratch_dir(spark, "results")
    io.write_result_csv(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("value").alias("latency_s"), "props"), path)
    back = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in io.RESULT_COLUMNS))
    return back.select("id", "type", "latency_s")


@query("s13_manifest", "SELECT source AS book_id, sha256(text) AS sha256, min(doc_id || '.txt') AS source_file FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY ALL")
def _(spark, d):
    path = scratch_dir(spark, "manifest")
    docs = table(spark, d, "documents").filter("source IS NOT NULL AND text IS NOT NULL")
    m = docs.select(F.col("source").alias("book_id"), F.sha2("text", 256).alias("sha256"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"))
    for batch in (1, 2, 2):  # a batch that is committed twice counts once
        io.commit_manifest(m.filter(F.crc32("sha256") % 2 == batch - 1), path, batch)
    return io.read_manifest(spark, path)


@query("s14_write_failures", "SELECT 'f' || doc_id AS file, CASE WHEN doc_id % 5 = 0 THEN 'unsupported' END AS error_type, doc_id % 5 = 0 AS attempted FROM documents WHERE doc_id % 5 < 2")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.lit("unsupported").alias("error_type"), F.lit("no route").alias("error_message"))
    return io.write_failures(docs.filter("doc_id % 5 = 0"), docs.filter("doc_id % 5 = 1"), True, scratch_dir(spark, "failures")).select("file", "error_type", "attempted")


@query("s15_read_bench_results", f"SELECT CAST(doc AS VARCHAR) AS id, 'marker' AS parser, 1.5::DOUBLE AS elapsed_sec, CAST(count(*) AS INT) AS n FROM ({views.ELEMENTS_SQL}) AS e GROUP BY doc")
def _(spark, d):
    path = scratch_dir(spark, "bench")
    e = views.elements(spark, d).groupBy(F.col("doc").cast("string").alias("id")).agg(F.collect_list(F.struct("type", "content", "page_num")).alias("elements"))
    e.select("id", F.lit("marker").alias("parser"), F.lit(1.5).alias("elapsed_sec"), "elements").write.mode("overwrite").json(path)
    return spark.read.schema(io.BENCH_SCHEMA).json(path).select("id", "parser", "elapsed_sec", F.size("elements").alias("n"))


@query("s15_read_scorecard", "SELECT CAST(l_orderkey AS VARCHAR) AS id, l_returnflag AS parser, CAST(l_linenumber % 3 AS VARCHAR) AS detect FROM lineitem")
def _(spark, d):
    path = scratch_dir(spark, "card")
    card = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("parser"), F.lit("text").alias("element_type"), (F.col("l_linenumber") % 3).alias("detect"), F.lit(1).alias("content"), F.lit("").alias("struct"), F.lit("n").alias("notes"))
    card.write.mode("overwrite").csv(path, header=True)
    return io.read_scorecard(spark, path).select("id", "parser", "detect")


@query("s16_scorecard_skeleton", "SELECT page_id AS id, parser, 'text' AS element_type, '' AS detect, '' AS content, '' AS struct, '' AS notes FROM pages, (VALUES ('marker'), ('unstructured')) AS p(parser)")
def _(spark, d):
    return io.scorecard_skeleton(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("text").alias("element_type")), ["marker", "unstructured"])


@query("s17_turns", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, d):
    path = scratch_dir(spark, "turns")
    turns = table(spark, d, "conversations")
    for k in (0, 1):
        io.append_turn(turns.filter(F.col("turn") % 2 == k), path)
    return io.read_turns(spark, path)


@query("p09_staged_file_validation", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 2 = 0 THEN 'unsupported' END AS reason FROM documents")
def _(spark, d):
    path = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".exe").otherwise(".Pdf"))
    docs = table(spark, d, "documents").select("doc_id", path.alias("path"))
    return io.staged_file_validation(docs, docs.filter("doc_id % 3 <> 0")).join(docs, "path").select("doc_id", "reason")


@query("x03_custom_tokenizer", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS INT) AS n FROM documents")
def _(spark, d):
    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(t.encode().split()))

    return table(spark, d, "documents").select("doc_id", count("text").alias("n"))


@query("x05_best_of", "SELECT lang, arg_max(doc_id, n_chars * 100000000 - doc_id) AS longest FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.max_by("doc_id", F.col("n_chars") * 100_000_000 - F.col("doc_id")).alias("longest"))


FILE_SQL = "SELECT coalesce(regexp_extract(url, '://([^/?#]+)', 1), '') AS book_id, sha256(html) AS sha256, min('p' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.html') AS source_file FROM pages WHERE html IS NOT NULL GROUP BY ALL"


@query("ingest_pages_twice", FILE_SQL)
def _(spark, d):
    """Pages in two batches by content, then the first one again: the manifest has each content of a book once, by its first name."""
    root, pages = scratch_dir(spark, "ingest"), page_files(spark, d).filter("html IS NOT NULL")
    for batch in (0, 1, 0):
        ingest_pages(pages.filter(F.crc32("html") % 2 == batch), root, batch)
    return io.read_manifest(spark, f"{root}/manifest").select("book_id", "sha256", "source_file")


@query("ingest_chunks_once", f"SELECT book_id, source_file FROM ({FILE_SQL}) AS f")
def _(spark, d):
    """The files of all chunks of the store after a batch that was run twice, of which no chunk comes twice."""
    root, pages = scratch_dir(spark, "once"), page_files(spark, d).filter("html IS NOT NULL")
    for _ in range(2):
        ingest_pages(pages, root, 0)
    chunks = read_store(spark, f"{root}/store").groupBy("book_id", "source_file").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"))
    return chunks.filter("n = ids").select("book_id", "source_file")


@query("ingest_delete_files", f"""WITH f AS ({FILE_SQL}), gone AS (SELECT * FROM f WHERE source_file LIKE '%0.html')
  SELECT book_id, source_file, source_file LIKE '%00.html' AS again FROM f WHERE source_file NOT LIKE '%0.html' UNION ALL SELECT book_id, source_file, true FROM gone WHERE source_file LIKE '%00.html'""")
def _(spark, d):
    """Every tenth file is deleted from the store and the manifest, twice; then every hundredth one is ingested again."""
    root, pages = scratch_dir(spark, "rollback"), page_files(spark, d).filter("html IS NOT NULL")
    ingest_pages(pages, root, 0)
    gone = pages.filter("filename LIKE '%0.html'").select(F.coalesce("book_id", F.lit("")).alias("book_id"), F.col("filename").alias("source_file"))
    for _ in range(2):
        delete_files(spark, root, gone)
    again = io.read_manifest(spark, f"{root}/manifest").select("source_file")
    ingest_pages(pages.filter("filename LIKE '%00.html'"), root, 1)
    store = read_store(spark, f"{root}/store").select("book_id", "source_file").distinct()
    return store.join(io.read_manifest(spark, f"{root}/manifest").hint("merge"), ["book_id", "source_file"], "left_semi").withColumn("again", F.col("source_file").like("%00.html"))


@query("ingest_roll_back", "SELECT coalesce(regexp_extract(url, '://([^/?#]+)', 1), '') AS book_id, count(DISTINCT sha256(html)) AS n_files FROM pages WHERE page_id % 10 <> 0 GROUP BY 1")
def _(spark, d):
    """The store on disk after every tenth file of a batch was rolled back."""
    root, pages = scratch_dir(spark, "rollback"), page_files(spark, d)
    ingest_pages(pages, root, 0)
    failed = pages.filter(F.col("filename").rlike(r"0\.html$")).select("book_id", F.col("filename").alias("source_file"))
    roll_back(spark, root, failed)
    return read_store(spark, f"{root}/store").groupBy("book_id").agg(F.count_distinct("source_file").alias("n_files"))


STOP_SQL = """WITH f AS (SELECT c_mktsegment AS book_id, lpad(CAST(c_custkey AS VARCHAR), 9, '0') || CASE WHEN c_nationkey % 5 < 2 THEN '.exe' ELSE '.pdf' END AS file, c_nationkey % 5 < 2 AS bad FROM customer),
  a AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY file) AS run FROM f),
  b AS (SELECT *, sum(bad::INT) OVER (PARTITION BY book_id, run ORDER BY file) AS len FROM a),
  c AS (SELECT *, coalesce(max((len >= 4)::INT) OVER (PARTITION BY book_id ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM b)
  SELECT book_id, file, CASE WHEN stopped THEN 'not attempted' WHEN bad THEN 'failed' ELSE 'stored' END AS status, (SELECT max(stopped) FROM c) AS aborted_early FROM c"""


@query("ingest_stops_early", STOP_SQL)
def _(spark, d):
    """Customers as files of a book for each segment; a book stops after four files in a row that have no route."""
    root, c = scratch_dir(spark, "stop"), table(spark, d, "customer")
    name = F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.when(F.col("c_nationkey") % 5 < 2, ".exe").otherwise(".pdf"))
    report = ingest_files(c.select(F.col("c_mktsegment").alias("book_id"), name.alias("filename"), F.concat(F.lit(PAGE), "c_name").alias("markdown")), root, 0, max_failures=4)
    aborted = spark.read.json(f"{root}/failures/batch=0").agg(F.max("aborted_early").alias("aborted_early"))
    return report.select("book_id", "file", "status").crossJoin(F.broadcast(aborted))  # one row


def recordings(spark, d):
    """Each conversation as a recording whose turns last a second each."""
    second = (F.col("conv_id") * 1000 + F.col("turn")).cast("double")
    words = F.lit(None).cast("array<struct<word:string,score:double>>").alias("words")
    segment = F.struct("text", second.alias("start"), (second + 1).alias("end"), words, F.col("role").alias("speaker"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", segment.alias("s")))).alias("x"))
    return talks.select(F.lit("talks").alias("book_id"), F.concat(F.col("conv_id").cast("string"), F.lit(".wav")).alias("filename"), F.transform("x", lambda r: r["s"]).alias("segments"))


INGEST_SQL = """SELECT coalesce(source, '') AS book_id, 'pdf' AS ext, CASE WHEN text IS NULL THEN 'failed' ELSE 'stored' END AS status, count(DISTINCT coalesce(text, CAST(doc_id AS VARCHAR))) AS n_files, NULL::DOUBLE AS last_second
  FROM documents GROUP BY ALL
UNION ALL SELECT coalesce(regexp_extract(url, '://([^/?#]+)', 1), ''), 'epub', 'stored', count(DISTINCT html), NULL FROM pages WHERE html IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'talks', 'wav', 'stored', count(DISTINCT conv_id), max(conv_id * 1000 + turn + 1) FROM conversations
UNION ALL SELECT 'images', 'png', CASE WHEN octet_length(encode(p_name)) % 4 = 0 THEN 'failed' ELSE 'stored' END, count(DISTINCT p_name), NULL FROM part GROUP BY ALL
UNION ALL SELECT 'orders', 'exe', 'failed', count(*), NULL FROM orders"""


@query("ingest_all_routes", INGEST_SQL)
def _(spark, d):
    """One batch of documents as converted pages, pages as books, conversations as recordings, parts as images, orders as
    files of no route; first without a describer, which holds images back, then with one."""
    from .elements import stub

    name = lambda key, ext: F.concat(F.col(key).cast("string"), F.lit(f".{ext}")).alias("filename")
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("book_id"), name("doc_id", "pdf"), F.concat(F.lit(PAGE), "text").alias("markdown"))
    host = F.coalesce(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit(""))
    books = table(spark, d, "pages").filter("html IS NOT NULL").select(host.alias("book_id"), name("page_id", "epub"), F.array("html").alias("chapters"))
    talks = recordings(spark, d)
    images = table(spark, d, "part").select(F.lit("images").alias("book_id"), name("p_partkey", "png"), F.col("p_name").cast("binary").alias("content"))
    other = table(spark, d, "orders").select(F.lit("orders").alias("book_id"), name("o_orderkey", "exe"))
    files = docs
    for more in (books, talks, images, other):
        files = files.unionByName(more, allowMissingColumns=True)
    root, ext = scratch_dir(spark, "routes"), F.element_at(F.split("source_file", r"\."), -1).alias("ext")
    reports = [ingest_files(files, root, batch, describer=describer, describer_failures=0) for batch, describer in ((0, None), (1, stub))]
    last = reports[1].unionByName(reports[0].join(reports[1].select("book_id", "file").hint("merge"), ["book_id", "file"], "left_anti"))
    times = read_store(spark, f"{root}/store").groupBy("book_id", ext).agg(F.max("end_sec").alias("last_second"))
    counts = last.groupBy("book_id", ext, "status").agg(F.count("*").alias("n_files"))
    return counts.join(times.hint("merge"), ["book_id", "ext"], "left").select("book_id", "ext", "status", "n_files", "last_second")
