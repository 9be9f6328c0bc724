"""Queries of names, neighbours, runs and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import windows as ops
from quillmill.registry import query, table

from . import views


@query("w01_resolve_source_names", "SELECT doc_id, CASE WHEN k = 0 THEN f ELSE replace(f, '.pdf', '(' || k || ').pdf') END AS source_file FROM (SELECT doc_id, source || '.pdf' AS f, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 + (source = 'src1')::INT AS k FROM documents) AS n")
def _(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.col("lang").alias("book_id"), F.concat("source", F.lit(".pdf")).alias("filename"), F.col("doc_id").alias("arrival"))
    manifest = files.filter("filename = 'src1.pdf'").select("book_id", F.col("filename").alias("source_file")).distinct()
    return ops.resolve_source_names(files, manifest).select("doc_id", "source_file")


@query("w03_neighbours", f"SELECT doc, elem_idx, lag(type) OVER (PARTITION BY doc ORDER BY elem_idx) AS before, lead(type) OVER (PARTITION BY doc ORDER BY elem_idx) AS after FROM ({views.ELEMENTS_SQL}) AS e")
def _(spark, d):
    return ops.neighbours(views.elements(spark, d), "doc", "elem_idx", "type").select("doc", "elem_idx", "before", "after")


@query("w04_running_groups", "SELECT event_id, CAST(sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM events")
def _(spark, d):
    return ops.running_groups(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "run")


@query("w07_history_before", "SELECT a.conv_id, a.turn, count(b.turn) AS n_before, coalesce(CAST(sum(length(b.text)) AS BIGINT), 0) AS n_chars FROM conversations AS a LEFT JOIN conversations AS b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY a.conv_id, a.turn")
def _(spark, d):
    h = ops.history_before(table(spark, d, "conversations"))
    return h.select("conv_id", "turn", F.size("history").cast("bigint").alias("n_before"), F.aggregate("history", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["text"])).alias("n_chars"))


@query("w07_history_pages", "SELECT a.conv_id, a.turn, count(b.turn) AS n_before, coalesce(string_agg(b.role || ':' || b.text, '|' ORDER BY b.turn), '') AS history FROM (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) AS a LEFT JOIN conversations AS b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY a.conv_id, a.turn")
def _(spark, d):
    """The history of the last turn of each conversation, from pages of three turns."""
    turns = table(spark, d, "conversations")
    last = ops.prefix_lengths(turns).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max("n_before").alias("n_before"))
    h = ops.history_of(last, ops.conversation_pages(turns, 3))
    said = F.array_join(F.transform("history", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "|")
    return h.select("conv_id", "turn", F.col("n_before").cast("bigint").alias("n_before"), said.alias("history"))


@query("w08_multi_round", "SELECT conv_id AS qid, string_agg(conv_id || '-' || turn, ',' ORDER BY turn) AS citations FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(spark, d):
    users = table(spark, d, "conversations").filter("role = 'user'")
    questions = users.groupBy(F.col("conv_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")).alias("calls"))
    found = ops.multi_round_expand(questions).select("qid", "round", F.lit(1).alias("rank"), F.concat_ws("-", "qid", "query").alias("chunk_id"))
    return ops.collect_rounds(found).select("qid", F.array_join("citations", ",").alias("citations"))
