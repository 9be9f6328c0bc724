"""Queries of the scalar functions, tokens and predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as f
from quillmill.functions.calculator import safe_calculate
from quillmill.registry import query, table

from . import views

TOKEN_SQL = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]|[^\sA-Za-z0-9]"
TOKENS = f"len(regexp_extract_all(text, '{TOKEN_SQL}'))"
SENTENCES = r"""list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z\d])', '\1' || chr(1) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13)) <> '')"""


def docs(spark, d):
    return table(spark, d, "documents")


@query("c01_token_count", f"SELECT doc_id, CAST({TOKENS} AS INT) AS n_tokens FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", f.token_count(F.col("text")).alias("n_tokens"))


@query("c02_split_sentences", f"SELECT doc_id, CAST(len({SENTENCES}) AS INT) AS n_sentences, sha256(array_to_string({SENTENCES}, chr(1))) AS digest FROM documents")
def _(spark, d):
    s = f.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(s).alias("n_sentences"), F.sha2(F.array_join(s, "\x01"), 256).alias("digest"))


@query("f04_last_sentence", rf"SELECT doc_id, coalesce(regexp_replace(({SENTENCES})[-1], '^\s+|\s+$', '', 'g'), trim(text)) AS last FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", f.last_sentence(F.col("text")).alias("last"))


HEADING_SQL = r"regexp_matches(trim(content), '^#{1,6}\s') AND NOT regexp_matches(trim(content), '(?i)^#{1,6}\s(TIP|CRUX|ASIDE|WARNING|CAUTION|SIDEBAR)\b')"


@query("p05_is_heading_boundary", f"SELECT doc, elem_idx, {HEADING_SQL} AS boundary FROM ({views.ELEMENTS_SQL}) AS e")
def _(spark, d):
    return views.elements(spark, d).select("doc", "elem_idx", f.is_heading_boundary(F.col("content")).alias("boundary"))


CAPTION_SQL = r"regexp_matches(content, '^(Figure|Table|图|表)\s*\d+(\.\d+)*\s*[:：\s]')"


@query("p06_is_caption", f"SELECT doc, elem_idx, {CAPTION_SQL} AS caption FROM ({views.ELEMENTS_SQL}) AS e")
def _(spark, d):
    return views.elements(spark, d).select("doc", "elem_idx", f.is_caption(F.col("content")).alias("caption"))


@query(
    "e02_classify_block",
    f"""SELECT doc, elem_idx, CASE WHEN starts_with(content, '```') THEN 'code' WHEN starts_with(content, '|') AND ends_with(content, '|') THEN 'table'
      WHEN starts_with(content, '![') THEN 'figure' ELSE 'text' END AS kind, CASE WHEN starts_with(content, '```') THEN '' ELSE content END AS body FROM ({views.ELEMENTS_SQL}) AS e""",
)
def _(spark, d):
    b = f.classify_block(F.col("content"))
    return views.elements(spark, d).select("doc", "elem_idx", b["type"].alias("kind"), b["content"].alias("body"))


#: A block of some kind for each part: open and closed fences, formulas, rows between other lines, and what only looks like one of these.
KINDS = """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '```sql' || chr(10) || p_name WHEN 1 THEN '```' || chr(10) || p_name || chr(10) || '```' WHEN 2 THEN '$$ ' || p_name || ' $$' WHEN 3 THEN '$$$$' WHEN 4 THEN '||'
  WHEN 5 THEN p_name || chr(13) || chr(10) || ' | ' || p_brand || ' | ' || chr(13) || chr(10) || 'end' WHEN 6 THEN '| ' || p_name WHEN 7 THEN '![' || p_name || '](a.png)' WHEN 8 THEN 'see ![' || p_name || '](a.png)' WHEN 9 THEN '```' || p_name ELSE '# ' || p_name END AS block FROM part"""


@query("e02_kinds_of_blocks", f"""SELECT p_partkey, CASE WHEN p_partkey % 11 IN (0, 1, 9) THEN 'code' WHEN p_partkey % 11 = 2 THEN 'formula' WHEN p_partkey % 11 = 5 THEN 'table' WHEN p_partkey % 11 = 7 THEN 'figure' ELSE 'text' END AS kind,
  CASE WHEN p_partkey % 11 IN (0, 1, 2) THEN p_name WHEN p_partkey % 11 = 9 THEN '' ELSE block END AS body FROM ({KINDS}) AS k JOIN part USING (p_partkey)""")
def _(spark, d):
    b = f.classify_block(F.col("block"))
    return views.view(spark, d, KINDS).select("p_partkey", b["type"].alias("kind"), b["content"].alias("body"))


@query("e03_strip_page_artifact", r"SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    marked = F.concat("text", F.lit("\n\n{"), F.col("doc_id").cast("string"), F.lit("}  \n"))
    return docs(spark, d).select("doc_id", F.sha2(f.strip_page_artifact(marked), 256).alias("digest"))


@query("f01_format_timestamp", "SELECT event_id, CAST(CAST(floor(value * 20) AS BIGINT) // 3600 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(value * 20) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value * 20) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS stamp FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", f.format_timestamp(F.col("value") * 20).alias("stamp"))


@query(
    "f02_format_citation",
    f"""SELECT chunk_id, CASE WHEN token_count % 3 = 0 THEN source_file WHEN token_count % 3 = 1 THEN source_file || ' 0:00:' || lpad(CAST(page_start AS VARCHAR), 2, '0') || '-0:00:' || lpad(CAST(page_end AS VARCHAR), 2, '0')
      WHEN page_start = page_end THEN source_file || ' p.' || page_start ELSE source_file || ' p.' || page_start || '-' || page_end END AS citation FROM ({views.CHUNKS_SQL}) AS c""",
)
def _(spark, d):
    c = views.chunks(spark, d)
    paged, timed = F.col("token_count") % 3 == 2, F.col("token_count") % 3 == 1
    cite = f.format_citation(F.col("source_file"), F.when(paged, F.col("page_start")), F.when(paged, F.col("page_end")), F.when(timed, F.col("page_start")), F.when(timed, F.col("page_end")))
    return c.select("chunk_id", cite.alias("citation"))


@query("f03_normalize_text", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\v]+', ' ', 'g'))) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(f.normalize_text(F.col("text")), 256).alias("digest"))


@query("f05_preview_keywords", r"SELECT item_id, substr(text, 1, 200) AS preview, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 1)[1:5], ',') AS keywords FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 200).alias("preview"), F.array_join(f.keywords(F.col("text")), ",").alias("keywords"))


@query("f06_has_cjk", "SELECT doc_id, doc_id % 5 = 0 AS cjk FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", f.has_cjk(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("中文"))).otherwise(F.col("text"))).alias("cjk"))


LOCATIONS = """CASE doc_id % 5 WHEN 0 THEN 'a.mp3 01:0' || CAST(doc_id % 10 AS STRING) || '-02:30' WHEN 1 THEN 'b.pdf p.' || CAST(doc_id AS STRING) WHEN 2 THEN 'b.pdf p.' || CAST(doc_id AS STRING) || '-' || CAST(doc_id + 2 AS STRING) || '；「Part ' || CAST(doc_id AS STRING) || '」'
  WHEN 3 THEN '-' ELSE 'somewhere' END"""


@query(
    "f07_parse_source_location",
    """SELECT doc_id, 0 AS pos, CASE doc_id % 5 WHEN 0 THEN 'audio' WHEN 1 THEN 'page' WHEN 2 THEN 'page' WHEN 3 THEN 'none' ELSE 'unparsed' END AS kind,
      CASE doc_id % 5 WHEN 0 THEN 'a.mp3' WHEN 1 THEN 'b.pdf' WHEN 2 THEN 'b.pdf' END AS file, CAST(CASE doc_id % 5 WHEN 0 THEN 60 + doc_id % 10 WHEN 1 THEN doc_id WHEN 2 THEN doc_id END AS INT) AS first_at,
      CAST(CASE doc_id % 5 WHEN 0 THEN 150 WHEN 1 THEN doc_id WHEN 2 THEN doc_id + 2 END AS INT) AS last_at, NULL::VARCHAR AS title FROM documents
    UNION ALL SELECT doc_id, 1, 'section', NULL, NULL, NULL, 'Part ' || doc_id FROM documents WHERE doc_id % 5 = 2""",
)
def _(spark, d):
    hints = docs(spark, d).select("doc_id", F.posexplode(f.source_hints(F.expr(LOCATIONS))).alias("pos", "h"))
    return hints.select("doc_id", "pos", "h.kind", "h.file", F.col("h.first").alias("first_at"), F.col("h.last").alias("last_at"), "h.title")


@query("f08_mmss_to_sec", "SELECT event_id, CAST(event_id % 60 * 60 + user_id % 60 AS INT) AS sec FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", f.mmss_to_sec(F.format_string("%02d:%02d", F.col("event_id") % 60, F.col("user_id") % 60)).alias("sec"))


@query("f09_parse_chunk_id", "SELECT doc_id, source AS source_file, CAST(nullif(doc_id % 7, 0) AS INT) AS page, CAST(doc_id AS INT) AS seq, lang AS book_id FROM documents")
def _(spark, d):
    built = f.chunk_id(F.col("lang"), F.col("source"), F.expr("nullif(doc_id % 7, 0)"), F.col("doc_id"))
    return docs(spark, d).select("doc_id", f.parse_chunk_id(built).alias("p")).select("doc_id", "p.source_file", "p.page", "p.seq", "p.book_id")


@query("f10_collection_name", "SELECT DISTINCT 'b_' || lower(hex(encode(source || ' ñ中'))) AS encoded, source || ' ñ中' AS decoded FROM documents")
def _(spark, d):
    e = docs(spark, d).select(f.encode_collection(F.concat("source", F.lit(" ñ中"))).alias("encoded")).distinct()
    return e.withColumn("decoded", f.decode_collection(F.col("encoded")))


@query("f11_append_tool_tags", "SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || '[calculated]' ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '[sources: a.pdf p.1, ' || role || ']' ELSE '' END AS answer FROM conversations")
def _(spark, d):
    cites = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("a.pdf p.1"), F.col("role"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select("conv_id", "turn", f.append_tool_tags(F.col("text"), cites, F.col("turn") % 2 == 0).alias("answer"))


@query("f12_strip_known_tags", "SELECT conv_id, turn, text AS answer FROM conversations")
def _(spark, d):
    tagged = f.append_tool_tags(f.append_tool_tags(F.col("text"), F.array("role"), F.lit(True)), F.array("role"), F.col("turn") % 2 == 0)
    return table(spark, d, "conversations").select("conv_id", "turn", f.strip_known_tags(tagged).alias("answer"))


@query("f13_safe_calculate", "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN user_id + event_id WHEN 1 THEN user_id * event_id WHEN 2 THEN user_id - event_id END AS VARCHAR) AS result, CASE WHEN event_id % 4 = 3 THEN 'division by zero' END AS reason FROM events")
def _(spark, d):
    op = F.element_at(F.array(*map(F.lit, (" + ", " * ", " - "))), (F.col("event_id") % 4 + 1).cast("int"))
    expression = F.when(F.col("event_id") % 4 == 3, F.concat(F.col("user_id").cast("string"), F.lit(" / 0"))).otherwise(F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 4 < 3, op), F.col("event_id").cast("string")))
    e = table(spark, d, "events").filter("event_id IS NOT NULL").withColumn("x", safe_calculate(expression))
    return e.select("event_id", "x.result", "x.reason")


@query("f14_normalize_expression", "SELECT event_id, CAST(1 + event_id % 9 AS VARCHAR) || CASE WHEN user_id > 999 THEN ',' ELSE '' END || printf('%03d', user_id) || ' + (' || CAST(user_id AS VARCHAR) || '/100)' AS expression FROM events")
def _(spark, d):
    """A comma before three digits is one of thousands and goes; before more of them it stays."""
    raw = F.concat(F.lit("$"), (1 + F.col("event_id") % 9).cast("string"), F.lit(","), F.format_string("%03d", "user_id"), F.lit(" + "), F.col("user_id").cast("string"), F.lit("%"))
    return table(spark, d, "events").select("event_id", f.normalize_expression(raw).alias("expression"))


@query("f15_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("f16_base64_round_trip", "SELECT doc_id, base64(encode(text)) AS encoded, text AS decoded FROM documents")
def _(spark, d):
    encoded = docs(spark, d).select("doc_id", f.base64_of(F.encode("text", "UTF-8")).alias("encoded"))
    return encoded.withColumn("decoded", F.decode(F.unbase64("encoded"), "UTF-8"))


@query("f17_sorted_distinct", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM conversations GROUP BY conv_id")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("f18_json_arguments", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 10 <> 0 AS format_ok FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{k")).otherwise(F.col("props"))
    parsed = F.from_json(raw, "k bigint, _corrupt_record string", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").withColumn("p", parsed).select("event_id", "p.k", F.col("p._corrupt_record").isNull().alias("format_ok"))


@query("f19_alt_text", rf"SELECT doc, elem_idx, regexp_extract(content, '^!\[([^\]]*)\]', 1) AS alt FROM ({views.ELEMENTS_SQL}) AS e WHERE type = 'figure'")
def _(spark, d):
    return views.elements(spark, d).filter("type = 'figure'").select("doc", "elem_idx", f.alt_text(F.col("content")).alias("alt"))


@query("f20_baseline_source", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'u.pdf' ELSE 'u.mp3' END AS file, CASE WHEN event_id % 2 = 0 THEN CAST(user_id + 1 AS INT) END AS page, CASE WHEN event_id % 2 = 1 THEN CAST(user_id AS DOUBLE) END AS start_sec, CASE WHEN event_id % 2 = 1 THEN user_id + 2.5::DOUBLE END AS end_sec FROM events")
def _(spark, d):
    u = F.col("user_id").cast("string")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("data/u.pdf:p"), u, F.lit("@17"))).otherwise(F.concat(F.lit("data/u.mp3:t"), u, F.lit("-"), (F.col("user_id") + 2.5).cast("string")))
    e = table(spark, d, "events").withColumn("s", f.decode_baseline_source(raw))
    return e.select("event_id", "s.file", "s.page", F.col("s.start").alias("start_sec"), F.col("s.end").alias("end_sec"))


@query(
    "c03_greedy_pack",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS doc, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1),
    walk AS (SELECT doc, q, 1 AS pos, 0 AS start, q[1] AS total, FALSE AS cut, 0 AS was FROM s
      UNION ALL SELECT doc, q, pos + 1, CASE WHEN total + q[pos + 1] > 64 THEN pos ELSE start END, CASE WHEN total + q[pos + 1] > 64 THEN q[pos + 1] ELSE total + q[pos + 1] END, total + q[pos + 1] > 64, start FROM walk WHERE pos < len(q))
    SELECT doc, was AS first, pos - 2 AS last FROM walk WHERE cut UNION ALL SELECT doc, start, pos - 1 FROM walk WHERE pos = len(q)""",
)
def _(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q")))).alias("l"))
    return items.select("doc", F.explode(f.greedy_pack(F.transform("l", lambda x: x["q"]), 64)).alias("p")).select("doc", "p.first", "p.last")


def pack_sql(name: str, rows: str, most: int) -> str:
    """A recursive view: rows (k, i, text, n) with seq, the pack of at most `most` of n that row i of k falls into."""
    full = f"p.sum + s.n > {most}"
    return f"""{name} AS (SELECT k, i, text, n, 0 AS seq, n AS sum FROM {rows} WHERE i = 1 UNION ALL
    SELECT s.k, s.i, s.text, s.n, p.seq + ({full})::INT, CASE WHEN {full} THEN s.n ELSE p.sum + s.n END FROM {name} AS p JOIN {rows} AS s ON s.k = p.k AND s.i = p.i + 1)"""


def parts_sql(rows: str, most: int) -> str:
    """Parts (k, seq, part, pos, text, n) of rows (k, text), in the order of seq, part and pos."""
    counted = f"SELECT *, {TOKENS} AS n FROM"
    listed = "generate_subscripts(l, 1) AS i, unnest(l) AS text"
    return rf"""WITH RECURSIVE t AS ({counted} ({rows}) AS r),
  s AS ({counted} (SELECT k, {listed} FROM (SELECT k, {SENTENCES} AS l FROM t WHERE n > {most}) AS a) AS b),
  {pack_sql("sp", "s", most)},
  ss AS (SELECT k, seq, string_agg(text, ' ' ORDER BY i) AS text, sum(n) AS n FROM sp GROUP BY k, seq),
  w AS ({counted} (SELECT (k, seq) AS k, {listed} FROM (SELECT k, seq, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM ss WHERE n > {most}) AS a) AS b),
  {pack_sql("wp", "w", most)},
  ws AS (SELECT k[1] AS k, k[2] AS seq, seq AS part, string_agg(text, ' ' ORDER BY i) AS text, sum(n) AS n FROM wp GROUP BY ALL),
  c AS (SELECT k, seq, part, unnest(range(0, len(g), {most})) AS pos, g FROM (SELECT k, seq, part, regexp_extract_all(text, '{TOKEN_SQL}') AS g FROM ws WHERE n > {most}) AS a)
  SELECT k, 0 AS seq, 0 AS part, 0 AS pos, text, n FROM t WHERE coalesce(n, 0) <= {most} UNION ALL SELECT k, seq, 0, 0, text, n FROM ss WHERE n <= {most} UNION ALL SELECT k, seq, part, 0, text, n FROM ws WHERE n <= {most}
  UNION ALL SELECT k, seq, part, pos, array_to_string(g[pos + 1 : pos + {most}], ''), len(g[pos + 1 : pos + {most}]) FROM c"""


@query("c04_split_long_text", f"SELECT k AS doc_id, CAST(count(*) AS INT) AS n_parts, CAST(max(n) AS INT) AS most_tokens, sha256(string_agg(text, chr(1) ORDER BY seq, part, pos)) AS digest FROM ({parts_sql('SELECT doc_id AS k, text FROM documents', 64)}) AS p GROUP BY k")
def _(spark, d):
    parts = docs(spark, d).select("doc_id", f.split_long_text(F.col("text"), 64).alias("p"))
    return parts.select("doc_id", F.size("p").alias("n_parts"), F.array_max(F.transform("p", f.token_count)).alias("most_tokens"), F.sha2(F.array_join("p", "\x01"), 256).alias("digest"))


@query(
    "c05_overlap_suffix",
    rf"""WITH s AS (SELECT *, {TOKENS} AS n FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents) AS a) AS b
      WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''),
    taken AS (SELECT doc_id, string_agg(text, ' ' ORDER BY i) AS suffix FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i DESC) AS total FROM s) AS c WHERE total <= 50 GROUP BY doc_id)
    SELECT doc_id, coalesce(suffix, CASE WHEN len(g) < 50 THEN text ELSE array_to_string(g[-50:], '') END) AS suffix FROM (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN_SQL}') AS g FROM documents) AS d LEFT JOIN taken USING (doc_id)""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", f.overlap_suffix(F.col("text"), 50).alias("suffix"))


@query("s02_route_by_extension", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'audio' WHEN 3 THEN 'image' END AS route, CASE WHEN doc_id % 5 = 4 THEN 'unsupported extension' END AS failure FROM documents")
def _(spark, d):
    from quillmill.sources.files import route_by_extension

    ext = F.element_at(F.array(*map(F.lit, (".PDF", ".epub", ".mp3", ".png", ".xyz"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return route_by_extension(docs(spark, d).withColumn("path", F.concat("source", F.lit("/f.1"), ext))).select("doc_id", "route", "failure")
