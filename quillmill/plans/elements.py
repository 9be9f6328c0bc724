"""Queries of element sources and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import elements as ops
from quillmill.operators.html import decode_data_uri, html_to_elements, resolve_href, spread
from quillmill.registry import query, table
from quillmill.sources.files import segment_rows

from . import views
from .scalars import TOKENS

#: documents as rendered markdown: every line is a section of its own page.
PAGED = "'skip this' || chr(10) || '----page----' || replace(text, chr(10), chr(10) || chr(10) || '{7}' || '----page----')"


def paged(spark, d):
    docs = table(spark, d, "documents").withColumn("md", F.expr(PAGED.replace("chr(10)", "char(10)")))
    return ops.read_paged_markdown(docs, "doc_id", "md", "----page----")


@query("s03_read_paged_markdown", "SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS page_num, sha256(unnest(l)) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS s")
def _(spark, d):
    return paged(spark, d).select("doc_id", "page_num", F.sha2("content", 256).alias("digest"))


@query("s04_html_to_elements")
def _(spark, d):
    """E04, E05 and E10 at volume: headings, paragraphs, containers and skipped tags of raw pages."""
    return html_to_elements(table(spark, d, "pages")).select("page_id", "elem_idx", "type", "content")


SPINE_SQL = """WITH c AS (SELECT p_brand AS book_id, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS page_num FROM part),
  e AS (SELECT book_id, page_num, -1 AS sub, 'section_break' AS type, '' AS content FROM c WHERE page_num > 1
    UNION ALL SELECT book_id, page_num, 0, 'text', '# ' || p_name FROM c UNION ALL SELECT book_id, page_num, 1, 'text', CAST(p_partkey AS VARCHAR) FROM c)
  SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_num, sub) - 1 AS INT) AS elem_idx, type, content, CAST(page_num AS INT) AS page_num FROM e"""


@query("s05_assemble_spine", SPINE_SQL)
def _(spark, d):
    """Parts as chapters of their brand's book: contents, breaks and places of all elements."""
    parts = table(spark, d, "part")
    html = F.concat(F.lit("<h1>"), "p_name", F.lit("</h1><p>"), F.col("p_partkey").cast("string"), F.lit("</p>")).alias("html")
    elements = html_to_elements(parts.select(F.col("p_partkey").alias("chapter_id"), html), "chapter_id").drop("image_bytes")
    chapters = parts.select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("spine_pos"), F.col("p_partkey").alias("chapter_id"))
    return ops.assemble_spine(chapters, elements)


@query("s06_read_asr_segments", "SELECT user_id, event_id, greatest(0.0, least(1.0, avg(value / 500))) AS score FROM events GROUP BY user_id, event_id")
def _(spark, d):
    word = F.struct(F.lit("w").alias("word"), F.least(F.lit(1.0), F.col("value") / 500).alias("score"))
    blank = F.struct(F.lit("x").alias("word"), F.lit(None).cast("double").alias("score"))
    seg = F.struct(F.col("event_type").alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.array(word, blank).alias("words"), F.lit(None).cast("string").alias("speaker"))
    t = table(spark, d, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("source_file"), F.array(seg).alias("segments"))
    return segment_rows(t).select(F.col("book_id").alias("user_id"), F.col("source_file").alias("event_id"), "score")


@query("s07_rebase_page_batches", "SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) + doc_id % 7 * 100 AS INT) AS page_num FROM documents")
def _(spark, d):
    sections = paged(spark, d).withColumn("batch_id", F.col("doc_id") % 7)
    batches = sections.select("batch_id", (F.col("batch_id") * 100).alias("start")).distinct()
    return ops.rebase_page_batches(sections, batches).select("doc_id", "page_num")


@query("s07_page_mismatches", "SELECT doc_id AS batch_id, CAST(3 AS BIGINT) AS expected, CAST(len(string_split(text, chr(10))) AS BIGINT) AS found FROM documents WHERE len(string_split(text, chr(10))) <> 3")
def _(spark, d):
    sections = paged(spark, d).withColumnRenamed("doc_id", "batch_id")
    return ops.page_mismatches(sections, table(spark, d, "documents").select(F.col("doc_id").alias("batch_id"), F.lit(3).cast("bigint").alias("expected")))


@query("e01_split_markdown_blocks", "SELECT doc_id, CAST(unnest(range(0, len(l))) AS INT) AS pos, sha256(unnest(l)) AS digest FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) AS s")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("md"))
    return docs.select("doc_id", F.posexplode(ops.split_markdown_blocks(F.col("md"))).alias("pos", "b")).select("doc_id", "pos", F.sha2("b", 256).alias("digest"))


#: The lines of documents as blocks of their pages; kinds by the rules of E02.
LINE_BLOCKS = r"""SELECT doc_id, page_num, 0 AS pos, line AS block, trim(line, ' ' || chr(9) || chr(13)) AS content,
  CASE WHEN regexp_matches(line, '^\s*[|].+[|]\s*$') THEN 'table' WHEN starts_with(ltrim(line), '![') THEN 'figure' ELSE 'text' END AS type
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS page_num, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS s) AS t WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''"""


@query("x04_markdown_elements", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS INT) AS elem_idx, type, content, CAST(page_num AS INT) AS page_num FROM ({LINE_BLOCKS}) AS b")
def _(spark, d):
    return ops.markdown_elements(paged(spark, d), "doc_id")


#: What follows the line of a page: closed code and a formula with blank lines, glued text, a row, and on every third page a fence that stays open.
AFTER = r"""char(10) || char(10) || '```py' || char(10) || 'x = ' || page_num || char(10) || char(10) || 'y' || char(10) || '```' || char(10) || 'after' || char(10) || '$$' || char(10) || 'a' || char(10) || char(10) || 'b' || char(10) || '$$'
  || char(10) || '| ' || doc_id || ' |' || CASE WHEN page_num % 3 = 0 THEN char(10) || char(10) || '```open' || char(10) || char(10) || 'rest' || char(10) ELSE char(10) END"""
PAGES_SQL = "SELECT doc_id, generate_subscripts(l, 1) AS page_num FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS s"
RICH_SQL = f"""WITH p AS ({PAGES_SQL}), b AS ({LINE_BLOCKS}
  UNION ALL SELECT doc_id, page_num, 1, '```py' || chr(10) || 'x = ' || page_num || chr(10) || chr(10) || 'y' || chr(10) || '```', 'x = ' || page_num || chr(10) || chr(10) || 'y', 'code' FROM p
  UNION ALL SELECT doc_id, page_num, 2, 'after', 'after', 'text' FROM p
  UNION ALL SELECT doc_id, page_num, 3, '$$' || chr(10) || 'a' || chr(10) || chr(10) || 'b' || chr(10) || '$$', 'a' || chr(10) || chr(10) || 'b', 'formula' FROM p
  UNION ALL SELECT doc_id, page_num, 4, '| ' || doc_id || ' |', '| ' || doc_id || ' |', 'table' FROM p
  UNION ALL SELECT doc_id, page_num, 5, '```open' || chr(10) || chr(10) || 'rest', 'rest', 'code' FROM p WHERE page_num % 3 = 0)"""


def rich(spark, d):
    return paged(spark, d).withColumn("content", F.concat("content", F.expr(AFTER)))


@query("e01_fences_and_formulas", f"{RICH_SQL} SELECT doc_id, CAST(page_num AS INT) AS page_num, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY pos) - 1 AS INT) AS pos, sha256(block) AS digest FROM b")
def _(spark, d):
    blocks = rich(spark, d).select("doc_id", "page_num", F.posexplode(ops.split_markdown_blocks(F.col("content"))).alias("pos", "b"))
    return blocks.select("doc_id", "page_num", "pos", F.sha2("b", 256).alias("digest"))


@query("x04_typed_elements", f"{RICH_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, pos) - 1 AS INT) AS elem_idx, type, sha256(content) AS digest, CAST(page_num AS INT) AS page_num FROM b")
def _(spark, d):
    return ops.markdown_elements(rich(spark, d), "doc_id").select("doc_id", "elem_idx", "type", F.sha2("content", 256).alias("digest"), "page_num")


#: Each part as a page: chrome and head are skipped, containers opened, and p, li and b are left open as on real pages.
NESTED_HTML = """'<!DOCTYPE html><html><head><title>' || p_name || '</title><script>var t="</p>";</script></head><body><nav><ul><li>' || p_type || '</li></ul></nav><!-- ' || p_brand || ' --><div class="ad">not a block</div><article><section><h2> '
  || p_name || ' </h2><p><b>' || p_brand || '  &amp; more<br><p>See <i>' || p_type || '</i><img alt="' || p_brand || '" src="i/' || p_partkey || '.png"></p><ul><li>one<li>' || p_brand || '</ul><pre> a ' || p_partkey || '
 b</pre><figure><table><tr><th>k<th>v<tr><td>' || p_partkey || '<td>' || p_brand || '</table><figcaption>Table 1: ' || p_name || '</figcaption></figure></section></article><footer><p>' || p_name || '</footer>'"""
NESTED_SQL = """SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1 AS INT) AS elem_idx, type, content FROM (
  SELECT p_partkey, 1 AS pos, 'text' AS type, '## ' || trim(p_name) AS content FROM part
  UNION ALL SELECT p_partkey, 2, 'text', p_brand || ' & more' FROM part
  UNION ALL SELECT p_partkey, 3, 'figure', '![' || p_brand || '](i/' || p_partkey || '.png)' FROM part
  UNION ALL SELECT p_partkey, 4, 'text', 'See ' || p_type FROM part
  UNION ALL SELECT p_partkey, 5, 'text', '- one' || chr(10) || '- ' || p_brand FROM part
  UNION ALL SELECT p_partkey, 6, 'code', 'a ' || p_partkey || chr(10) || ' b' FROM part
  UNION ALL SELECT p_partkey, 7, 'table', '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | ' || p_brand || ' |' FROM part
  UNION ALL SELECT p_partkey, 8, 'text', 'Table 1: ' || p_name FROM part) AS e"""


@query("s04_nested_pages", NESTED_SQL)
def _(spark, d):
    """E04-E11 together, in the order of a page, with chrome around them."""
    return html_to_elements(spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(NESTED_HTML).alias("html")), "p_partkey").select("p_partkey", "elem_idx", "type", "content")


@query("e11_page_figures", "SELECT page_id, 0 AS elem_idx, 'figure' AS type, '![a](img/' || page_id || '.png)' AS content FROM pages UNION ALL SELECT page_id, 1, 'text', 'see' FROM pages")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("<body><p>"), F.lit('<img alt="a" src="../img/'), F.col("page_id").cast("string"), F.lit('.png">see</p></body>')).alias("html"), F.lit("text/ch.html").alias("base"))
    return html_to_elements(pages, base_href="base").select("page_id", "elem_idx", "type", "content")


@query("e12_resolve_href", "SELECT page_id, 'x/' || page_id || ' a.png' AS href FROM pages")
def _(spark, d):
    src = F.concat(F.lit("../x/"), F.col("page_id").cast("string"), F.lit("%20a.png"))
    return table(spark, d, "pages").select("page_id", resolve_href(F.lit("text/ch.html"), src).alias("href"))


@query("e13_decode_data_uri", "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url END AS decoded FROM pages")
def _(spark, d):
    src = F.concat(F.lit("data:image/png;base64,"), F.when(F.col("page_id") % 3 == 0, F.lit("!!")).otherwise(F.base64(F.encode("url", "UTF-8"))))
    return table(spark, d, "pages").select("page_id", F.decode(decode_data_uri(src), "UTF-8").alias("decoded"))


@query(
    "e15_attach_image_bytes",
    f"SELECT doc, elem_idx, CASE WHEN type = 'figure' AND p_brand IS NOT NULL THEN encode(p_brand) END AS image_bytes FROM ({views.ELEMENTS_SQL}) AS e LEFT JOIN (SELECT DISTINCT p_brand FROM part) AS p ON p_brand || '.png' = regexp_extract(content, '\\(([^)]*)\\)', 1)",
)
def _(spark, d):
    e = views.elements(spark, d)
    figures = e.filter("type = 'figure'").select("doc", F.regexp_extract("content", r"\(([^)]*)\)", 1).alias("ref")).distinct()
    images = figures.withColumn("image_bytes", F.encode(F.regexp_replace("ref", r"\.png$", ""), "UTF-8"))
    return ops.attach_image_bytes(e, images).select("doc", "elem_idx", "image_bytes")


NEXT = "lead(content) OVER (PARTITION BY doc ORDER BY elem_idx)"
CAPTION_SQL = rf"CASE WHEN type = 'figure' AND lead(type) OVER (PARTITION BY doc ORDER BY elem_idx) = 'text' AND regexp_matches({NEXT}, '^(Figure|Table|图|表)\s*\d+(\.\d+)*\s*[:：\s]') THEN {NEXT} ELSE '' END"


@query("e16_attach_caption", f"SELECT doc, elem_idx, {CAPTION_SQL} AS caption FROM ({views.ELEMENTS_SQL}) AS e")
def _(spark, d):
    return ops.attach_caption(views.elements(spark, d)).select("doc", "elem_idx", "caption")


@query("e17_figure_prompt", f"SELECT doc, elem_idx, 'Describe this figure for a reader who cannot see it.' || CASE WHEN caption <> '' THEN ' Its caption is: ' || caption ELSE '' END AS prompt FROM (SELECT doc, elem_idx, type, {CAPTION_SQL} AS caption FROM ({views.ELEMENTS_SQL}) AS e) AS c WHERE type = 'figure'")
def _(spark, d):
    figures = ops.attach_caption(views.elements(spark, d)).filter("type = 'figure'")
    return figures.select("doc", "elem_idx", ops.figure_prompt(F.col("caption")).alias("prompt"))


def figures(spark, d):
    """Figures of the elements with bytes; every fifth has none, some have a status."""
    e = views.elements(spark, d).filter("type = 'figure'")
    return e.withColumn("image_bytes", F.when(F.col("doc") % 5 != 0, F.encode("content", "UTF-8"))).withColumn("vlm_status", F.when(F.col("doc") % 3 == 0, "described"))


FIGURES_SQL = f"(SELECT *, doc % 5 <> 0 AS has, doc % 3 = 0 AS done FROM ({views.ELEMENTS_SQL}) AS e WHERE type = 'figure') AS f"


@query("p03_figures_with_bytes", f"SELECT doc, elem_idx FROM {FIGURES_SQL} WHERE has")
def _(spark, d):
    return ops.figures_with_bytes(figures(spark, d)).select("doc", "elem_idx")


@query("p03_figures_without_bytes", f"SELECT doc, elem_idx FROM {FIGURES_SQL} WHERE NOT has")
def _(spark, d):
    return ops.figures_without_bytes(figures(spark, d)).select("doc", "elem_idx")


@query("p04_unresolved_figures", f"SELECT DISTINCT doc FROM {FIGURES_SQL} WHERE has AND NOT done")
def _(spark, d):
    return ops.unresolved_figures(figures(spark, d), "doc")


def stub(images):
    """A deterministic describer: no description for every fourth size."""
    return images.map(lambda b: None if len(b) % 4 == 0 else f"an image of {len(b)} bytes")


E18_SQL = f"SELECT doc, elem_idx, CASE WHEN has AND length(encode(content)) % 4 <> 0 THEN '[alt: ' || regexp_extract(content, '^!\\[([^\\]]*)', 1) || '] an image of ' || octet_length(encode(content)) || ' bytes' ELSE content END AS described, CASE WHEN has THEN CASE WHEN octet_length(encode(content)) % 4 = 0 THEN 'degraded' ELSE 'described' END END AS vlm_status FROM {FIGURES_SQL}".replace("length(encode(content)) % 4 <> 0", "octet_length(encode(content)) % 4 <> 0")


@query("e18_describe_figures", E18_SQL)
def _(spark, d):
    f = figures(spark, d).drop("vlm_status")
    cache = f.filter("doc % 2 = 0 AND image_bytes IS NOT NULL AND length(image_bytes) % 4 <> 0").select(F.sha2("image_bytes", 256).alias("image_sha256"), F.concat(F.lit("an image of "), F.length("image_bytes"), F.lit(" bytes")).alias("description")).distinct()
    return ops.describe_figures(f, cache, stub, max_failures=0).select("doc", "elem_idx", F.col("content").alias("described"), "vlm_status")


@query(
    "a17_describe_stats",
    f"""SELECT count(*) FILTER (vlm_status = 'described') AS described, count(*) FILTER (vlm_status = 'degraded') AS degraded, count(*) FILTER (vlm_status IS NULL) AS no_bytes,
    CAST(sum(n) AS BIGINT) AS tokens, avg(n) AS mean_tokens FROM (SELECT *, CASE WHEN vlm_status = 'described' THEN {TOKENS.replace("text", "described")} END AS n FROM ({E18_SQL}) AS e) AS f""",
)
def _(spark, d):
    from quillmill.operators.aggregates import describe_stats

    return describe_stats(ops.describe_figures(figures(spark, d).drop("vlm_status"), spark.createDataFrame([], "image_sha256 string, description string"), stub, max_failures=0))


E19_SQL = """WITH a AS (SELECT *, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
    b AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS len FROM a)
    SELECT event_id, coalesce(max((len >= 3)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS degraded FROM b"""


@query("e19_degrade_after_failures", E19_SQL)
def _(spark, d):
    e = table(spark, d, "events")
    return ops.degrade_after_failures(e, 3, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "degraded")


def built(spark, d, html: str):
    """Elements of a small page for each part, its HTML written by an SQL expression over the table's columns."""
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.expr(html).alias("html"))
    return html_to_elements(pages).select("page_id", "elem_idx", "type", "content")


def built_sql(*elements: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey AS page_id, {n}::INT AS elem_idx, '{kind}' AS type, {content} AS content FROM part" for n, (kind, content) in enumerate(elements))


@query("e04_headings", built_sql(("text", "'## ' || p_name"), ("text", "p_brand")))
def _(spark, d):
    return built(spark, d, "'<body><h2> ' || p_name || '</h2><h5>' || p_brand || '</h5></body>'")


@query("e05_paragraph_figures", built_sql(("figure", "'![' || p_brand || '](i.png)'"), ("text", "p_name || ' $$' || p_size || '^{2}$$ end'")))
def _(spark, d):
    return built(spark, d, "'<p>' || p_name || '<img src=\"i.png\" alt=\"' || p_brand || '\"> <math><msup><mi>' || p_size || '</mi><mn>2</mn></msup></math>  end</p>'")


@query("e06_pre", built_sql(("code", "p_name || chr(10) || '  x'")))
def _(spark, d):
    return built(spark, d, "'<pre> ' || p_name || char(10) || '  x </pre>'")


@query("e07_table_markdown", built_sql(("table", "'| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_size || ' |'")))
def _(spark, d):
    return built(spark, d, "'<table><tr><th>name</th><th>size</th></tr><tr><td>' || p_name || '<td> ' || p_size || ' </tr></table>'")


@query("e08_layout_table", built_sql(("text", "p_name || chr(10) || p_brand"), ("text", "p_name || ' ' || p_brand")))
def _(spark, d):
    return built(spark, d, "'<table><tr><td>' || p_name || '</td></tr><tr><td>' || p_brand || '</td></tr></table><table class=\"x-list\"><tr><td>' || p_name || '</td><td>' || p_brand || '</td></tr></table>'")


@query("e09_lists_quotes", built_sql(("text", "'1. ' || p_name || chr(10) || '2. ' || p_brand"), ("text", "'- ' || p_type"), ("text", "'> ' || p_name || chr(10) || '> ' || p_brand")))
def _(spark, d):
    return built(spark, d, "'<ol><li>' || p_name || '<li> <li>' || p_brand || '</ol><ul><li>' || p_type || '</ul><blockquote>' || p_name || '<br>' || p_brand || '</blockquote>'")


@query("e10_containers", built_sql(("text", "p_name"), ("text", "p_brand")))
def _(spark, d):
    return built(spark, d, "'<nav>n</nav><main><section><p>' || p_name || '</section></main><form>f</form><address>' || p_brand || '</address>'")


@query("e14_mathml", built_sql(("formula", "'$$\\frac{' || p_size || '}{\\sqrt{2}}$$'")))
def _(spark, d):
    return built(spark, d, "'<math><mfrac><mi>' || p_size || '</mi><msqrt><mn>2</mn></msqrt></mfrac></math>'")
