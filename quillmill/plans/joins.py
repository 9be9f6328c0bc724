"""Queries of incremental joins, hydration, ground truth and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import joins as ops
from quillmill.registry import query, table
from quillmill.sources.files import STORE_SCHEMA, write_chunks
from quillmill.sources.scratch import scratch_dir

from . import views
from .ingest import read_store


def files(spark, d):
    """Each document is a file of its source's book."""
    return table(spark, d, "documents").select(F.col("source").alias("book_id"), F.concat(F.lit("f"), F.format_string("%09d", "doc_id")).alias("filename"), F.sha2("text", 256).alias("sha256"), "doc_id")


FILES_SQL = "(SELECT source AS book_id, 'f' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS filename, sha256(text) AS sha256, doc_id FROM documents)"


@query("j01_skip_ingested", f"SELECT book_id, min(filename) AS filename FROM {FILES_SQL} AS f WHERE NOT EXISTS (SELECT 1 FROM {FILES_SQL} AS m WHERE m.doc_id % 4 = 0 AND m.book_id IS NOT DISTINCT FROM f.book_id AND m.sha256 IS NOT DISTINCT FROM f.sha256) GROUP BY book_id, sha256")
def _(spark, d):
    f = files(spark, d)
    return ops.skip_ingested(f, f.filter("doc_id % 4 = 0")).select("book_id", "filename")


@query("j02_skip_existing_chunks", f"SELECT DISTINCT chunk_id FROM ({views.CHUNKS_SQL}) AS c WHERE chunk_id NOT IN (SELECT chunk_id FROM ({views.CHUNKS_SQL}) AS s WHERE token_count > 25)")
def _(spark, d):
    c = views.chunks(spark, d)
    return ops.skip_existing_chunks(c.select("chunk_id").distinct(), c.filter("token_count > 25"))


@query("j03_delete_by_source", "SELECT coalesce(lang, '') AS book_id, source AS source_file, count(*) AS n FROM documents WHERE lang IS DISTINCT FROM 'de' AND (source IS NULL OR source NOT IN ('src1', 'src3')) GROUP BY ALL")
def _(spark, d):
    """A store on disk with a book for each language, from which two files of all books and one whole book are deleted twice."""
    path, docs = scratch_dir(spark, "delete"), table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("book_id"), F.col("source").alias("source_file"), F.col("text").alias("content"))
    write_chunks(spark.createDataFrame([], STORE_SCHEMA).unionByName(chunks, allowMissingColumns=True), path)
    gone = chunks.filter("book_id = 'de' OR source_file IN ('src1', 'src3')").select("book_id", "source_file").distinct()
    for _ in range(2):
        ops.delete_by_source(spark, path, gone)
    return read_store(spark, path).groupBy("book_id", "source_file").agg(F.count("*").alias("n"))


@query("j04_hydrate", "SELECT c.chunk_id, c.pos, d.lang, d.source FROM (SELECT doc_id * 2 AS chunk_id, min(doc_id) AS pos FROM documents GROUP BY 1) AS c LEFT JOIN documents AS d ON d.doc_id = c.chunk_id")
def _(spark, d):
    docs = table(spark, d, "documents")
    cited = docs.select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 2).alias("chunk_id"))
    return ops.hydrate(cited.union(cited.withColumn("pos", F.col("pos") + 1)), docs.select(F.col("doc_id").alias("chunk_id"), "lang", "source"))


HINTS = "SELECT o_orderkey AS qid, 'doc' || CAST(CAST(floor(o_orderkey / 16) AS INT) AS STRING) || '.pdf' AS file, CAST(o_orderkey % 5 AS INT) AS first, CAST(o_orderkey % 5 + 1 AS INT) AS last FROM orders"


@query("j05_gt_page_match", f"SELECT DISTINCT h.qid, c.chunk_id FROM ({HINTS}) AS h JOIN ({views.CHUNKS_SQL}) AS c ON c.source_file = h.file AND c.page_start BETWEEN h.first AND h.last")
def _(spark, d):
    return ops.gt_page_match(views.view(spark, d, HINTS), views.chunks(spark, d))


@query("j06_gt_interval_overlap", f"SELECT a.event_id AS l_id, b.event_id AS r_id FROM ({views.INTERVALS_SQL}) AS a JOIN ({views.INTERVALS_SQL}) AS b ON a.user_id = b.user_id AND a.t0 < b.t1 AND b.t0 < a.t1 WHERE a.event_type = 'click' AND b.event_type = 'view'")
def _(spark, d):
    i = views.intervals(spark, d)
    left = i.filter("event_type = 'click'").select(F.col("event_id").alias("l_id"), "user_id", F.col("t0").alias("l0"), F.col("t1").alias("l1"))
    right = i.filter("event_type = 'view'").select(F.col("event_id").alias("r_id"), "user_id", F.col("t0").alias("r0"), F.col("t1").alias("r1"))
    return ops.interval_overlap(left, right, "user_id", 16).select("l_id", "r_id")


@query("j07_gt_section_match", "SELECT DISTINCT b.item_id AS qid, CAST(d.doc_id AS VARCHAR) AS chunk_id FROM benchmark AS b JOIN documents AS d ON contains(lower(d.text), lower(substr(b.text, 1, 20)))")
def _(spark, d):
    """All documents are chunks of one file."""
    chunks = table(spark, d, "documents").select(F.lit("all").alias("source_file"), F.col("text").alias("content"), F.col("doc_id").cast("string").alias("chunk_id"))
    hints = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lit("all").alias("file"), F.col("text").alias("title"))
    return ops.gt_section_match(hints, chunks)


@query("j08_apply_overrides", "SELECT doc_id AS qid, CASE WHEN doc_id % 10 = 0 THEN 'manual' ELSE 'parsed' END AS kind FROM documents")
def _(spark, d):
    parsed = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.lit("parsed").alias("kind"))
    return ops.apply_overrides(parsed, parsed.filter("qid % 10 = 0").withColumn("kind", F.lit("manual")))


@query("j10_reuse_cached", f"SELECT doc_id, EXISTS (SELECT 1 FROM {FILES_SQL} AS m WHERE m.doc_id % 3 = 0 AND m.sha256 = f.sha256) AS cached FROM {FILES_SQL} AS f")
def _(spark, d):
    f = files(spark, d).select("doc_id", "sha256")
    hit, miss = ops.reuse_cached(f, f.filter("doc_id % 3 = 0").select("sha256").distinct(), "sha256")
    return hit.select("doc_id", F.lit(True).alias("cached")).union(miss.select("doc_id", F.lit(False)))


@query("j11_purge_stale_cache", "SELECT image_sha256 FROM (SELECT DISTINCT 'i' || doc_id % 97 AS image_sha256 FROM documents) AS i WHERE image_sha256 IN (SELECT 'i' || doc_id % 97 FROM documents WHERE doc_id % 5 = 0)")
def _(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.select(F.col("doc_id").cast("string").alias("sha256"), F.array(F.concat(F.lit("i"), F.col("doc_id") % 97)).alias("image_shas"))
    images = cache.select(F.explode("image_shas").alias("image_sha256")).distinct()
    return ops.purge_stale_cache(cache, images, docs.filter("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("sha256")))[1]


@query("j12_baseline_source_parse", f"SELECT DISTINCT o_orderkey AS qid, chunk_id FROM orders JOIN ({views.CHUNKS_SQL}) AS c ON source_file = 'doc' || CAST(floor(o_orderkey / 16) AS INT) || '.pdf' AND page_start = o_orderkey % 7 + 1")
def _(spark, d):
    source = F.concat(F.lit("data/doc"), F.floor(F.col("o_orderkey") / 16), F.lit(".pdf:p"), F.col("o_orderkey") % 7, F.lit("@3"))
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), source.alias("source"))
    return ops.gt_page_match(ops.baseline_hints(s), views.chunks(spark, d))


QA = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'doc' || CAST(CAST(floor(o_orderkey / 16) AS INT) AS STRING) || '.pdf p.2-3；doc' || CAST(CAST(floor(o_orderkey / 16) AS INT) AS STRING) || '.pdf p.3' WHEN 1 THEN 'doc1.pdf 「RED WIDGET」' ELSE '-' END AS source_location FROM orders"


@query("u02_ground_truth", f"""WITH q AS (SELECT o_orderkey AS id, o_orderkey % 3 AS k FROM orders), c AS ({views.CHUNKS_SQL})
  SELECT CAST(id AS BIGINT) AS qid, CASE k WHEN 0 THEN 'page' WHEN 1 THEN 'section' ELSE 'none' END AS method, count(DISTINCT chunk_id) AS n FROM q
  LEFT JOIN c ON (k = 0 AND source_file = 'doc' || CAST(floor(id / 16) AS INT) || '.pdf' AND page_start BETWEEN 2 AND 3) OR (k = 1 AND source_file = 'doc1.pdf' AND contains(lower(content), 'red widget')) GROUP BY ALL""")
def _(spark, d):
    qa = views.view(spark, d, QA)
    manual = spark.createDataFrame([], "qid bigint, pos int, kind string, file string, first double, last double, title string")
    chunks = views.chunks(spark, d).withColumns({"start_sec": F.lit(None).cast("double"), "end_sec": F.lit(None).cast("double")})
    return ops.derive_ground_truth(qa, manual, chunks).select("qid", "method", F.size("chunk_ids").cast("bigint").alias("n"))


@query("a13_method_histogram", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'section' ELSE 'none' END AS method, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    from quillmill.operators.aggregates import method_histogram

    qa = views.view(spark, d, QA)
    manual = spark.createDataFrame([], "qid bigint, pos int, kind string, file string, first double, last double, title string")
    chunks = views.chunks(spark, d).withColumns({"start_sec": F.lit(None).cast("double"), "end_sec": F.lit(None).cast("double")})
    return method_histogram(ops.derive_ground_truth(qa, manual, chunks))


@query("u01_union_of_files", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter("doc_id % 2 = 0").select("doc_id").unionByName(docs.filter("doc_id % 5 = 0").select("doc_id"))


@query("u04_still_to_do", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def _(spark, d):
    ids = table(spark, d, "documents").select("doc_id")
    return ids.exceptAll(ids.filter("doc_id % 3 = 0"))


@query("u05_distinct_citations", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS cited FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) AS c GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("x", lambda s: s["role"])), ",").alias("cited"))
