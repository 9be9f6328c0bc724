"""Queries of statistics and of the checks of question tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import aggregates as ops
from quillmill.operators.checks import qa_schema_violations
from quillmill.registry import query, table

from . import views


@query("a02_source_files", "SELECT DISTINCT lang AS book_id, source AS source_file FROM documents")
def _(spark, d):
    return ops.source_files(table(spark, d, "documents").select(F.col("lang").alias("book_id"), F.col("source").alias("source_file")))


@query("a03_count_chunks", "SELECT source AS book_id, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return ops.count_chunks(table(spark, d, "documents").withColumnRenamed("source", "book_id"))


TURNS = "SELECT user_id % 10 AS config, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS expected_tool, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type IN ('view', 'click', 'error') THEN event_type END AS triggered_tool, event_id % 11 <> 0 AS format_ok, CASE WHEN event_type = 'click' THEN event_id % 13 <> 0 END AS tool_accuracy_ok FROM events"
METRICS_SQL = f"""SELECT config, coalesce(count(*) FILTER (format_ok AND triggered_tool IS NOT NULL) / nullif(count(triggered_tool), 0)::DOUBLE, 1.0) AS format_ratio,
  coalesce(count(*) FILTER (triggered_tool = expected_tool) / nullif(count(expected_tool), 0)::DOUBLE, 1.0) AS precision_ratio,
  coalesce(count(*) FILTER (triggered_tool IS NULL AND expected_tool IS NULL) / nullif(count(*) FILTER (expected_tool IS NULL), 0)::DOUBLE, 1.0) AS specificity_ratio,
  coalesce(count(*) FILTER (tool_accuracy_ok) / nullif(count(tool_accuracy_ok), 0)::DOUBLE, 1.0) AS accuracy_ratio FROM ({TURNS}) AS t GROUP BY config"""


@query("a04_tool_call_metrics", METRICS_SQL)
def _(spark, d):
    return ops.tool_call_metrics(views.view(spark, d, TURNS), "config")


@query("a05_passing", f"SELECT config, format_ratio >= 0.9 AND precision_ratio >= 0.85 AND specificity_ratio >= 0.7 AND accuracy_ratio >= 0.9 AS passed FROM ({METRICS_SQL}) AS m")
def _(spark, d):
    least = {"format_ratio": 0.9, "precision_ratio": 0.85, "specificity_ratio": 0.7, "accuracy_ratio": 0.9}
    return ops.passing(ops.tool_call_metrics(views.view(spark, d, TURNS), "config"), least).select("config", "passed")


@query("a06_latency_summary", "SELECT event_type, round(avg(user_id), 6) AS mean_tokens, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _(spark, d):
    return ops.latency_summary(table(spark, d, "events"), "event_type", "value", "user_id").select("event_type", *(F.round(c, 6).alias(c) for c in ("mean_tokens", "p50", "p95")))


BENCH = "SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS id, l_returnflag AS parser, l_extendedprice / 1000 AS elapsed_sec, CASE WHEN l_linenumber = 7 THEN 'failed' END AS error, l_linestatus FROM lineitem"


@query("a07_parser_speed", f"""WITH b AS (SELECT parser, elapsed_sec, row_number() OVER (PARTITION BY parser ORDER BY elapsed_sec) - 1 AS k, count(*) OVER (PARTITION BY parser) AS n FROM ({BENCH}) AS x WHERE error IS NULL AND id NOT IN (SELECT id FROM ({BENCH}) AS y WHERE elapsed_sec > 90))
  SELECT parser, round(60 / avg(elapsed_sec), 1) AS pages_per_min, round(median(elapsed_sec), 6) AS p50, max(elapsed_sec) FILTER (k = least(CAST(floor(0.95 * n) AS BIGINT), n - 1)) AS p95, CAST(max(n) AS BIGINT) AS n FROM b GROUP BY parser""")
def _(spark, d):
    b = views.view(spark, d, BENCH)
    return ops.parser_speed(b, b.filter("elapsed_sec > 90").select("id").distinct()).withColumn("p50", F.round("p50", 6))


CARD = "SELECT CAST(l_orderkey AS STRING) AS id, l_returnflag AS parser, CASE WHEN l_linenumber = 2 THEN '' ELSE CAST(l_linenumber % 3 AS STRING) END AS detect, CAST(l_linenumber % 2 AS STRING) AS content, CASE WHEN l_linenumber = 3 THEN ' ' ELSE CAST(l_suppkey % 3 AS STRING) END AS struct FROM lineitem"


@query("a08_score_totals", f"SELECT parser, CAST(sum(coalesce(try_cast(detect AS INT), 0)) AS BIGINT) AS detect, CAST(sum(coalesce(try_cast(content AS INT), 0)) AS BIGINT) AS content, CAST(sum(coalesce(try_cast(struct AS INT), 0)) AS BIGINT) AS struct, CAST(sum(coalesce(try_cast(detect AS INT), 0) + coalesce(try_cast(content AS INT), 0) + coalesce(try_cast(struct AS INT), 0)) AS BIGINT) AS total FROM ({CARD}) AS c GROUP BY parser")
def _(spark, d):
    return ops.score_totals(views.view(spark, d, CARD))


@query("a09_needs_model_route", f"SELECT DISTINCT id FROM (SELECT CAST(doc AS VARCHAR) AS id FROM ({views.ELEMENTS_SQL}) AS e WHERE contains(content, '![') UNION ALL SELECT id FROM ({CARD}) AS c GROUP BY id HAVING max(coalesce(try_cast(struct AS INT), 0)) = 0) AS x")
def _(spark, d):
    e = views.elements(spark, d)
    results = e.groupBy(F.col("doc").cast("string").alias("id")).agg(F.lit("marker").alias("parser"), F.collect_list(F.struct("type", "content", "page_num")).alias("elements"))
    return ops.needs_model_route(results, views.view(spark, d, CARD), "marker")


@query("a10_choose_winner", f"""WITH s AS (SELECT parser, 60 / avg(elapsed_sec) AS speed FROM ({BENCH}) AS b WHERE error IS NULL GROUP BY parser),
  t AS (SELECT parser, sum(coalesce(try_cast(detect AS INT), 0) + coalesce(try_cast(content AS INT), 0) + coalesce(try_cast(struct AS INT), 0)) AS total FROM ({CARD}) AS c GROUP BY parser)
  SELECT min(parser) AS parser FROM t JOIN s USING (parser) WHERE speed >= 0.5 AND total = (SELECT max(total) FROM t JOIN s USING (parser) WHERE speed >= 0.5)""")
def _(spark, d):
    return ops.choose_winner(ops.parser_speed(views.view(spark, d, BENCH)), ops.score_totals(views.view(spark, d, CARD)), 0.5)


AUDIT = "SELECT toxic = 1 AS hallucinated, quality = 1 AS answerable, CASE WHEN toxic = 1 THEN 'invented' WHEN quality = 1 THEN 'grounded' ELSE 'refused' END AS outcome FROM labels"


@query("a14_hallucination_rate", f"SELECT count(*) AS n, CAST(sum(hallucinated::INT) AS BIGINT) AS hallucinated, round(avg(hallucinated::INT), 6) AS rate, round(avg(hallucinated::INT) FILTER (NOT answerable), 6) AS rate_no_answer FROM ({AUDIT}) AS a")
def _(spark, d):
    return ops.hallucination_rate(views.view(spark, d, AUDIT))


@query("a14_outcome_classes", f"SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share FROM ({AUDIT}) AS a GROUP BY outcome")
def _(spark, d):
    return ops.outcome_classes(views.view(spark, d, AUDIT))


@query("a15_language_crosstab", "SELECT lang AS question_lang, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS material_lang, count(*) AS n, round(avg((n_chars > 1500)::INT), 6) AS rate FROM documents GROUP BY CUBE (1, 2)")
def _(spark, d):
    qa = table(spark, d, "documents").select(F.col("lang").alias("question_lang"), F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("material_lang"), (F.col("n_chars") > 1500).alias("hit"))
    return ops.language_crosstab(qa)


@query("a16_question_type_share", "SELECT lang, source, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents)::DOUBLE, 4) AS percent FROM documents GROUP BY ALL")
def _(spark, d):
    return ops.question_type_share(table(spark, d, "documents"), "lang", "source")


@query("a18_ingest_summary", "SELECT CAST(sum(CASE WHEN doc_id % 10 < 8 THEN n_chars END) AS BIGINT) AS chunks, count(*) FILTER (doc_id % 10 = 8) AS failed, count(*) FILTER (doc_id % 10 = 9) AS not_attempted, true AS aborted_early FROM documents")
def _(spark, d):
    status = F.when(F.col("doc_id") % 10 < 8, "stored").when(F.col("doc_id") % 10 == 8, "failed").otherwise("not_attempted")
    return ops.ingest_summary(table(spark, d, "documents").select(status.alias("status"), F.col("n_chars").alias("n_chunks")))


HEADERS_SQL = "SELECT conv_id, coalesce(arg_min(substr(text, 1, 20), turn) FILTER (role = 'user'), 'New conversation') AS title, CAST(max(turn * 60 + conv_id) AS BIGINT) AS updated_at FROM conversations GROUP BY conv_id"


def stamped(spark, d):
    return table(spark, d, "conversations").withColumn("ts", F.col("turn") * 60 + F.col("conv_id"))


@query("a19_conversation_headers", HEADERS_SQL)
def _(spark, d):
    return ops.conversation_headers(stamped(spark, d))


@query("t08_newest_first", HEADERS_SQL + " ORDER BY updated_at DESC, conv_id")
def _(spark, d):
    return ops.newest_first(ops.conversation_headers(stamped(spark, d)))


QA = """SELECT CASE WHEN doc_id % 50 = 1 THEN 'q0' ELSE 'q' || CAST(doc_id AS STRING) END AS id, CASE WHEN doc_id % 7 = 0 THEN 'physics' ELSE 'law' END AS subject, CASE doc_id % 3 WHEN 0 THEN 'no_answer' WHEN 1 THEN 'factual' ELSE 'riddle' END AS question_type,
  CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END AS question, CASE WHEN doc_id % 13 <> 0 THEN source END AS standard_answer, CASE WHEN doc_id % 2 = 0 THEN array('c') ELSE array() END AS supporting_chunks, '-' AS source_location FROM documents"""


@query("p07_qa_schema_violations", """WITH q AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'q0' ELSE 'q' || doc_id END AS id FROM documents)
  SELECT id, 'missing field' AS rule FROM q WHERE doc_id % 13 = 0 UNION ALL SELECT id, 'blank field' FROM q WHERE doc_id % 11 = 0 UNION ALL SELECT id, 'unknown type' FROM q WHERE doc_id % 3 = 2
  UNION ALL SELECT id, 'unknown subject' FROM q WHERE doc_id % 7 = 0 UNION ALL SELECT id, 'chunks without answer' FROM q WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 UNION ALL SELECT id, 'answer without chunks' FROM q WHERE doc_id % 3 <> 0 AND doc_id % 2 = 1
  UNION ALL SELECT id, 'repeated id' FROM q GROUP BY id HAVING count(*) > 1""")
def _(spark, d):
    qa = views.view(spark, d, QA.replace("array()", "cast(array() as array<string>)"))
    return qa_schema_violations(qa, types=("factual", "no_answer"), subjects=("law", "clinical", "cs"))
