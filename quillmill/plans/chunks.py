"""Queries of chunking, chunk checks and chunk statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.text import token_count
from quillmill.operators import chunking as ops
from quillmill.operators.html import html_to_elements
from quillmill.operators.tokens import chunk_texts_counted
from quillmill.registry import query, table

from . import views
from .elements import NEXT
from .scalars import HEADING_SQL, TOKENS, pack_sql, parts_sql

STARTS = "'table', 'formula', 'code', 'figure'"
GROUPS_SQL = f"""SELECT doc, elem_idx, page_num, type, content, sum((b OR a OR coalesce(pa, false))::INT) OVER (PARTITION BY doc ORDER BY elem_idx) AS group_id, b FROM (
  SELECT *, type = 'text' AND ({HEADING_SQL}) AS b, type IN ({STARTS}) AS a, lag(type IN ({STARTS})) OVER (PARTITION BY doc ORDER BY elem_idx) AS pa FROM ({views.ELEMENTS_SQL}) AS e) AS m"""


@query("c13_native_chunk_stats", f"SELECT lang, count(*) AS n_chunks, CAST(min(n) AS INT) AS least, CAST(max(n) AS INT) AS most, CAST(sum(n) AS BIGINT) AS tokens FROM ({parts_sql('SELECT doc_id AS k, text FROM documents', 512)}) AS p JOIN documents ON doc_id = k GROUP BY lang")
def flagship(spark, d):
    """Sentences, counts, packs, ids and statistics by language, without any Python in the tasks."""
    chunks = ops.chunk_texts(table(spark, d, "documents"), "doc_id", "text", keep=("lang",))
    return chunks.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.sum("token_count").alias("tokens"))


@query("c13_bpe_chunks")
def _(spark, d):
    """The same documents packed by the tokens of a public byte-level BPE vocabulary, counted in Arrow batches over arrays of
    sentences; without SQL, as it has no BPE: tests compare with the library."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return chunk_texts_counted(table(spark, d, "documents"), "doc_id", "text", ops.MAX_TOKENS, path, pattern)


def document_elements(spark, d):
    """Documents as files of one element for each line."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("book_id"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("source_file"), F.posexplode(F.split("text", "\n")).alias("elem_idx", "content"))
    return docs.select("book_id", "source_file", "elem_idx", F.lit("text").alias("type"), "content", F.floor(F.col("elem_idx") / 9).cast("int").alias("page_num"))


@query("c13_chunk_elements_documents")
def _(spark, d):
    return ops.chunk_elements(document_elements(spark, d))


@query("c13_chunk_elements_pages")
def _(spark, d):
    pages = table(spark, d, "pages")
    e = html_to_elements(pages).hint("merge").join(pages.select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("book_id")), "page_id")
    return ops.chunk_elements(e.select("book_id", F.col("page_id").cast("string").alias("source_file"), "elem_idx", "type", "content", F.lit(1).alias("page_num")))


def synthetic(spark, d):
    return views.elements(spark, d).select(F.lit("bk").alias("book_id"), F.col("doc").cast("string").alias("source_file"), "elem_idx", "type", "content", "page_num")


@query("c13_chunk_elements_synthetic")
def _(spark, d):
    """C08-C10 meet their triggers here: captions after figures, tables side by side."""
    return ops.chunk_elements(synthetic(spark, d), 40, 8)


#: Lines are elements of a type; a heading ends a group and goes; groups are packed by the tokens of their lines.
LINES_SQL = "SELECT lang AS book_id, source || '-' || doc_id AS source_file, doc_id AS doc, generate_subscripts(l, 1) - 1 AS elem_idx, unnest(l) AS content FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) AS d"
NATIVE_SQL = f"""WITH RECURSIVE g AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc ORDER BY elem_idx) AS group_id FROM (SELECT *, {HEADING_SQL} AS b FROM ({LINES_SQL}) AS l) AS m),
  s AS (SELECT (doc, group_id) AS k, row_number() OVER (PARTITION BY doc, group_id ORDER BY elem_idx) AS i, content AS text, {TOKENS.replace("text", "content")} AS n, book_id, source_file, elem_idx // 9 AS page FROM g WHERE NOT b),
  {pack_sql("p", "s", 512)},
  c AS (SELECT p.k[1] AS doc, p.k[2] AS group_id, seq AS pack, any_value(book_id) AS book_id, any_value(source_file) AS source_file, trim(string_agg(p.text, ' ' ORDER BY p.i)) AS content,
    CAST(nullif(arg_min(page, p.i), 0) AS INT) AS page_start, CAST(nullif(arg_max(page, p.i), 0) AS INT) AS page_end FROM p JOIN s ON s.k = p.k AND s.i = p.i GROUP BY ALL)
  SELECT book_id || '/' || source_file || '/' || coalesce('p' || lpad(page_start::VARCHAR, greatest(4, length(page_start::VARCHAR))::INT, '0'), 'pNone') || '/' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS chunk_id, book_id, source_file, 'text' AS element_type, content,
    CAST({TOKENS.replace("text", "content")} AS INT) AS token_count, page_start, page_end FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY group_id, pack) - 1 AS n FROM c WHERE content <> '') AS x"""


@query("c13_chunk_elements_native", NATIVE_SQL)
def _(spark, d):
    return ops.chunk_elements_native(document_elements(spark, d))


@query("c06_section_groups", f"SELECT doc, elem_idx, CAST(group_id AS BIGINT) AS group_id FROM ({GROUPS_SQL}) AS g WHERE NOT b")
def _(spark, d):
    return ops.section_groups(views.elements(spark, d)).select("doc", "elem_idx", F.col("group_id").cast("bigint").alias("group_id"))


@query("c07_isolate_atomic", f"SELECT doc, CAST(group_id AS BIGINT) AS group_id, string_agg(elem_idx || ' ' || type || ' ' || content, '; ' ORDER BY elem_idx) AS members FROM ({GROUPS_SQL}) AS g WHERE NOT b GROUP BY ALL HAVING bool_or(type IN ({STARTS}))")
def _(spark, d):
    """The whole group of each atomic element: nothing else may be in it."""
    g = ops.section_groups(views.elements(spark, d)).withColumn("one", F.struct("elem_idx", F.concat_ws(" ", "elem_idx", "type", "content").alias("text")))
    g = g.groupBy("doc", F.col("group_id").cast("bigint").alias("group_id")).agg(F.array_sort(F.collect_list("one")).alias("all"), F.bool_or(F.col("type").isin(*ops.ATOMIC)).alias("atomic"))
    return g.filter("atomic").select("doc", "group_id", F.array_join(F.transform("all", lambda x: x["text"]), "; ").alias("members"))


@query("c10_captioned_figures", f"SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT type, {NEXT} AS nx, lead(type) OVER (PARTITION BY doc ORDER BY elem_idx) AS nt FROM ({views.ELEMENTS_SQL}) AS e) AS c WHERE type IN ({STARTS}) AND nt = 'text' AND regexp_matches(nx, '^(Figure|Table|图|表)\\s*\\d+(\\.\\d+)*\\s*[:：\\s]')")
def _(spark, d):
    chunks = ops.chunk_elements(synthetic(spark, d), 10_000, 8)
    return chunks.filter(F.col("element_type").isin(*ops.ATOMIC) & F.col("content").rlike(r" Figure \d+\.1: ")).agg(F.count("*").alias("n"))


@query("c11_page_span", f"SELECT doc, nullif(arg_min(page_num, elem_idx), 0) AS page_start, nullif(arg_max(page_num, elem_idx), 0) AS page_end FROM ({views.ELEMENTS_SQL}) AS e GROUP BY doc")
def _(spark, d):
    return ops.page_span(["doc"], views.elements(spark, d))


@query("c12_chunk_id", "SELECT doc_id, lang || '/' || source || '/' || CASE WHEN doc_id % 4 = 0 THEN 'pNone' ELSE 'p' || lpad(CAST(doc_id % 4 AS VARCHAR), 4, '0') END || '/' || printf('%04d', row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) AS chunk_id FROM documents")
def _(spark, d):
    from quillmill.functions.text import chunk_id

    s = ops.chunk_seq(table(spark, d, "documents"), ["lang", "source"], ["doc_id"])
    return s.select("doc_id", chunk_id(F.col("lang"), F.col("source"), F.expr("nullif(doc_id % 4, 0)"), F.col("seq")).alias("chunk_id"))


@query("w02_chunk_seq", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) + 9 AS INT) AS seq FROM documents")
def _(spark, d):
    return ops.chunk_seq(table(spark, d, "documents"), ["source"], ["doc_id"], 10).select("doc_id", "seq")


SEGMENTS = f"SELECT conv_id, turn, role, trim(text) AS text, {TOKENS} AS tok, CAST(turn % 4 + 3 AS DOUBLE) / 10 AS score FROM conversations WHERE trim(text) <> ''"


def segments(spark, d):
    c = table(spark, d, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("book_id"), F.lit("talk").alias("source_file"), F.col("turn").alias("seg_idx"), "text", F.col("turn").cast("double").alias("start"),
        (F.col("turn") + 1).cast("double").alias("end"), ((F.col("turn") % 4 + 3) / 10).alias("score"), F.col("role").alias("speaker"),
    )


#: Packs by recursion: a segment joins the pack unless the pack would exceed the limit.
PACKS = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({SEGMENTS}) AS x),
  p AS (SELECT conv_id, turn, role, text, tok, score, n, 0 AS seq, tok AS sum FROM s WHERE n = 1
    UNION ALL SELECT s.conv_id, s.turn, s.role, s.text, s.tok, s.score, s.n, CASE WHEN p.sum + s.tok > 256 THEN p.seq + 1 ELSE p.seq END, CASE WHEN p.sum + s.tok > 256 THEN s.tok ELSE p.sum + s.tok END FROM p JOIN s ON s.conv_id = p.conv_id AND s.n = p.n + 1)"""


@query("c14_pack_segments", f"{PACKS} SELECT conv_id || '/talk/' || lpad(CAST(seq AS VARCHAR), 4, '0') AS chunk_id, CAST(min(turn) AS DOUBLE) AS start_sec, CAST(max(turn) + 1 AS DOUBLE) AS end_sec FROM p GROUP BY conv_id, seq")
def _(spark, d):
    return ops.pack_segments(segments(spark, d)).select("chunk_id", "start_sec", "end_sec")


@query("c15_speaker_tags", f"{PACKS} SELECT chunk_id, sha256(string_agg(t, ' ' ORDER BY turn)) AS digest FROM (SELECT conv_id || '/talk/' || lpad(CAST(seq AS VARCHAR), 4, '0') AS chunk_id, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id, seq ORDER BY turn) = role THEN text ELSE '[' || role || '] ' || text END AS t FROM p) AS q GROUP BY chunk_id")
def _(spark, d):
    return ops.pack_segments(segments(spark, d)).select("chunk_id", F.sha2("content", 256).alias("digest"))


@query("c16_weighted_confidence", f"{PACKS} SELECT conv_id || '/talk/' || lpad(CAST(seq AS VARCHAR), 4, '0') AS chunk_id, round(coalesce(sum(score * tok) / nullif(sum(tok), 0), 1.0), 6) AS score FROM p GROUP BY conv_id, seq")
def _(spark, d):
    return ops.pack_segments(segments(spark, d)).select("chunk_id", F.round("score", 6).alias("score"))


@query(
    "p08_chunk_quality_violations",
    f"""WITH c AS ({views.CHUNKS_SQL}) SELECT chunk_id, 'micro chunk' AS rule FROM c WHERE token_count < 10
    UNION ALL SELECT chunk_id, 'page range' FROM c WHERE page_end < page_start UNION ALL SELECT chunk_id, 'token count' FROM c WHERE token_count <> {TOKENS.replace("text", "content")}
    UNION ALL SELECT chunk_id, 'duplicate id' FROM c GROUP BY chunk_id HAVING count(*) > 1""",
)
def _(spark, d):
    return ops.chunk_quality_violations(views.chunks(spark, d))


@query("a01_chunk_stats", f"SELECT lang, count(*) AS n, CAST(min(t) AS INT) AS least, CAST(max(t) AS INT) AS most, CAST(sum(t) // count(*) AS BIGINT) AS mean FROM (SELECT lang, {TOKENS} AS t FROM documents) AS x GROUP BY lang")
def _(spark, d):
    from quillmill.operators.aggregates import chunk_stats

    return chunk_stats(table(spark, d, "documents").withColumn("token_count", token_count(F.col("text"))).withColumnRenamed("lang", "element_type"), "element_type").withColumnRenamed("element_type", "lang")


def of_parts(spark, d, *elements: tuple[str, str]):
    """Chunks of a small file for each part, its elements written by SQL expressions over the table's columns."""
    rows = [F.struct(F.lit(n).alias("elem_idx"), F.lit(kind).alias("type"), F.expr(content).alias("content")) for n, (kind, content) in enumerate(elements)]
    e = table(spark, d, "part").select(F.lit("parts").alias("book_id"), F.col("p_partkey").cast("string").alias("source_file"), F.explode(F.array(*rows)).alias("e"))
    out = ops.chunk_elements(e.select("book_id", "source_file", "e.*", F.lit(2).alias("page_num")))
    return out.select("chunk_id", "element_type", "content")


@query("x03_custom_counter", "SELECT 'parts/' || p_partkey || '/pNone/0000' AS chunk_id, p_name || ' ' || p_type AS content, CAST(length(p_name || ' ' || p_type) AS INT) AS token_count FROM part")
def _(spark, d):
    """A counter of one's own: signs are tokens."""
    rows = F.array(F.struct(F.lit(0).alias("elem_idx"), F.col("p_name").alias("content")), F.struct(F.lit(1).alias("elem_idx"), F.col("p_type").alias("content")))
    e = table(spark, d, "part").select(F.lit("parts").alias("book_id"), F.col("p_partkey").cast("string").alias("source_file"), F.explode(rows).alias("e"))
    e = e.select("book_id", "source_file", "e.*", F.lit("text").alias("type"), F.lit(0).alias("page_num"))
    return ops.chunk_elements(e, 1000, 0, count=len).select("chunk_id", "content", "token_count")


@query("c08_move_lead_in_sentence", "SELECT 'parts/' || p_partkey || '/p0002/0000' AS chunk_id, 'text' AS element_type, p_name || ' is sold.' AS content FROM part UNION ALL SELECT 'parts/' || p_partkey || '/p0002/0001', 'table', 'See also: | ' || p_brand || ' |' FROM part")
def _(spark, d):
    return of_parts(spark, d, ("text", "p_name || ' is sold. See also:'"), ("table", "'| ' || p_brand || ' |'"))


@query("c09_merge_split_tables", "SELECT 'parts/' || p_partkey || '/p0002/0000' AS chunk_id, 'table' AS element_type, '| ' || p_name || ' |' || chr(10) || '-|-' || chr(10) || '| ' || p_brand || ' | Table 1: ' || p_type AS content FROM part")
def _(spark, d):
    return of_parts(spark, d, ("table", "'| ' || p_name || ' |'"), ("table", "'-|-' || char(10) || '| ' || p_brand || ' |'"), ("text", "'Table 1: ' || p_type"))
