"""Views built by the same plain SQL in Spark and DuckDB, so that queries and their oracles start from equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.registry import table

#: Ordered elements of every kind: an order is a document, a line of it an element.
ELEMENTS = """
SELECT l_orderkey AS doc, CAST(l_linenumber AS INT) AS elem_idx, CAST(floor(l_linenumber / 3) AS INT) AS page_num,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN 'table' WHEN l_returnflag = 'A' AND l_linenumber % 3 = 0 THEN 'figure' ELSE 'text' END AS type,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN '| ' || p_name || ' | ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' |'
       WHEN l_returnflag = 'A' AND l_linenumber % 3 = 0 THEN '![' || p_name || '](' || p_brand || '.png)'
       WHEN l_returnflag = 'A' AND l_linenumber % 3 = 1 THEN 'Figure ' || CAST(l_linenumber AS STRING) || '.1: ' || p_name
       WHEN l_returnflag = 'N' AND l_linenumber % 4 = 0 THEN '# ' || p_name
       WHEN l_returnflag = 'N' AND l_linenumber % 4 = 1 THEN '## Tip ' || p_name
       WHEN l_returnflag = 'R' AND l_linenumber % 4 = 3 THEN '```' || p_name || '```'
       ELSE p_name || ' is sold. It costs ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' each! See the ' || p_type || ' list.' END AS content
FROM lineitem JOIN part ON l_partkey = p_partkey"""

#: Distinct (doc, elem_idx): the first of repeated lines.
ELEMENTS_SQL = f"SELECT doc, elem_idx, min(page_num) AS page_num, min(type) AS type, min(content) AS content FROM ({ELEMENTS}) AS e GROUP BY doc, elem_idx"

#: Chunks with pages: 16 orders are a file, so there are more files where there is more data.
CHUNKS_SQL = """
SELECT 'bk' || CAST(l_suppkey % 7 AS STRING) || '/doc' || CAST(CAST(floor(l_orderkey / 16) AS INT) AS STRING) || '.pdf/p' || CAST(1000 + l_linenumber AS STRING) || '/' || CAST(10000 + l_orderkey AS STRING) AS chunk_id,
  'bk' || CAST(l_suppkey % 7 AS STRING) AS book_id, 'doc' || CAST(CAST(floor(l_orderkey / 16) AS INT) AS STRING) || '.pdf' AS source_file,
  CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'table' ELSE 'figure' END AS element_type, p_name || ' ' || p_type AS content,
  CAST(l_quantity AS INT) AS token_count, CAST(l_linenumber AS INT) AS page_start, CAST(l_linenumber + l_quantity % 3 AS INT) AS page_end
FROM lineitem JOIN part ON l_partkey = p_partkey"""

#: A question for each user and hour with intervals, from the event stream.
INTERVALS_SQL = "SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) + event_id % 977 AS t0, CAST(floor(value) AS BIGINT) + event_id % 977 + 1 + event_id % 13 AS t1 FROM events"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a view's SQL over the tables of sf_dir."""
    names = [n for n in ("lineitem", "part", "events", "documents", "conversations", "embeddings", "labels", "benchmark", "pages", "orders") if n in sql]
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ELEMENTS_SQL)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CHUNKS_SQL)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, INTERVALS_SQL)
