"""Statistics of chunks, agent runs, parsers, retrieval and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.order_statistics import order_statistics

#: Ratios that a passing run must reach.
THRESHOLDS = {"format_ratio": 0.95, "precision_ratio": 0.85, "specificity_ratio": 0.85, "accuracy_ratio": 0.9}
PAGES_PER_MINUTE = 15


def chunk_stats(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Count and least, most and mean (whole) tokens, in all or by a column."""
    stats = (F.count("*").alias("n"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.expr("sum(token_count) div count(*)").alias("mean"))
    return chunks.groupBy(*([by] if by else [])).agg(*stats)


def source_files(chunks: DataFrame, book: str | None = None) -> DataFrame:
    """Distinct source files, of a book or of all."""
    c = chunks if book is None else chunks.filter(F.col("book_id") == book)
    return c.select("book_id", "source_file").distinct().orderBy("book_id", "source_file")


def count_chunks(chunks: DataFrame) -> DataFrame:
    """(book_id, n): the books and their chunks."""
    return chunks.groupBy("book_id").agg(F.count("*").alias("n"))


def ratio(hit: Column, base: Column) -> Column:
    """Share of the base that is hit; 1.0 for an empty base."""
    return F.coalesce(F.count_if(hit & base) / F.nullif(F.count_if(base), F.lit(0)), F.lit(1.0))


def tool_call_metrics(turns: DataFrame, by: str) -> DataFrame:
    """Turns (expected_tool, triggered_tool, format_ok, tool_accuracy_ok). What is named precision is taken over the
    turns that should call a tool."""
    should, called = F.col("expected_tool").isNotNull(), F.col("triggered_tool").isNotNull()
    right = F.coalesce(F.col("triggered_tool") == F.col("expected_tool"), F.lit(False))
    return turns.groupBy(by).agg(
        ratio(F.col("format_ok"), called).alias("format_ratio"), ratio(right, should).alias("precision_ratio"), ratio(~called, ~should).alias("specificity_ratio"),
        ratio(F.coalesce("tool_accuracy_ok", F.lit(False)), F.col("tool_accuracy_ok").isNotNull()).alias("accuracy_ratio"),
    )


def passing(metrics: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Adds passed: all ratios reach their thresholds."""
    ok = F.lit(True)
    for name, least in thresholds.items():
        ok = ok & (F.col(name) >= least)
    return metrics.withColumn("passed", ok)


def latency_summary(turns: DataFrame, by: str, latency: str, tokens: str) -> DataFrame:
    """Mean tokens, p50 and p95, interpolated."""
    return turns.groupBy(by).agg(F.avg(tokens).alias("mean_tokens"), F.percentile(latency, 0.5).alias("p50"), F.percentile(latency, 0.95).alias("p95"))


def parser_speed(results: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Results (id, parser, elapsed_sec, error) without failures and excluded ids: pages a minute, median, the element of
    the sorted times at the place 95 % of n (cut off), n; a parser that has nothing left has infinite speed.

    Median and p95 are taken at their places of the sorted times, which no task sees whole; a null parser has neither."""
    rows = results if exclude is None else results.join(exclude.select("id").hint("merge"), "id", "left_anti")
    good = rows.filter(F.col("error").isNull() & F.col("elapsed_sec").isNotNull())
    n = good.groupBy("parser").agg(F.count("*").alias("n"), F.round(60 / F.avg("elapsed_sec"), 1).alias("pages_per_min"))
    places = {"low": F.floor((F.col("n") - 1) / 2), "high": F.ceil((F.col("n") - 1) / 2), "p95": F.least(F.floor(0.95 * F.col("n")), F.col("n") - 1)}
    at = n.select("parser", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("place")) for k, v in places.items()))).alias("x")).select("parser", "x.name", "x.place")
    found = order_statistics(good.select("parser", "elapsed_sec"), "parser", "elapsed_sec", at)
    named = at.hint("merge").join(found, ["parser", "place"])
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("elapsed_sec")))
    times = named.groupBy("parser").agg(((of("low") + of("high")) / 2).alias("p50"), of("p95").alias("p95"))
    out = results.select("parser").distinct().hint("merge").join(n, "parser", "left").join(times, "parser", "left")
    return out.select("parser", F.coalesce("pages_per_min", F.lit(float("inf"))).alias("pages_per_min"), "p50", "p95", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def score_totals(scorecard: DataFrame) -> DataFrame:
    """Sums by parser; blank scores count as none."""
    parts = [F.coalesce(F.sum(F.expr(f"try_cast(nullif(trim(`{c}`), '') as int)")), F.lit(0)).alias(c) for c in ("detect", "content", "struct")]
    return scorecard.groupBy("parser").agg(*parts).withColumn("total", F.col("detect") + F.col("content") + F.col("struct"))


def needs_model_route(results: DataFrame, scorecard: DataFrame, parser: str) -> DataFrame:
    """Ids of pages with an image placeholder in one parser's output, or that every parser scored 0 for structure."""
    pictured = results.filter((F.col("parser") == parser) & F.exists("elements", lambda e: F.contains(e["content"], F.lit("![")))).select("id")
    zero = scorecard.groupBy("id").agg(F.max(F.coalesce(F.expr("try_cast(`struct` as int)"), F.lit(0))).alias("m")).filter("m = 0").select("id")
    return pictured.union(zero).distinct()


def choose_winner(speeds: DataFrame, scores: DataFrame, least: float = PAGES_PER_MINUTE) -> DataFrame:
    """A10: of the parsers that are fast enough the one with the highest total; on ties the first by name."""
    both = speeds.filter(F.col("pages_per_min") >= least).join(scores, "parser")
    return both.agg(F.min_by("parser", F.struct(-F.col("total"), "parser")).alias("parser"))


def hit_rate(hits: DataFrame) -> DataFrame:
    """Hits (subject, qid, hit), a row for each round of a question: rate by subject and, with a null subject, in all."""
    per_question = hits.groupBy("subject", "qid").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    return per_question.rollup("subject").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("rate"), F.grouping("subject").cast("int").alias("is_total"))


def recall_at_depths(truth: DataFrame, ranked: DataFrame, depths=(5, 10, 20, 30, 40, 50), sizes: DataFrame | None = None) -> DataFrame:
    """Truth (qid, chunk_id), ranked (pool, qid, chunk_id, rank): share of truth chunks within each depth, by pool.

    The truth is counted once; only ranked rows meet it, so no pair of pool and truth is made. With sizes (qid, n), how many truth
    chunks each question has, truth may be only the pairs among ranked."""
    n = truth.distinct().agg(F.count("*").alias("n")) if sizes is None else sizes.agg(F.sum("n").alias("n"))
    found = ranked.join(truth.distinct().hint("merge"), ["qid", "chunk_id"]).groupBy("pool", "qid", "chunk_id").agg(F.min("rank").alias("rank"))
    at = found.groupBy("pool").agg(*(F.count_if(F.col("rank") <= k).alias(str(k)) for k in depths))
    long = at.select("pool", F.explode(F.array(*(F.struct(F.lit(k).alias("depth"), F.col(str(k)).alias("found")) for k in depths))).alias("x"))
    return long.join(F.broadcast(n)).select("pool", "x.depth", "x.found", F.round(F.col("x.found") / F.col("n"), 6).alias("recall"))


def method_histogram(truth: DataFrame) -> DataFrame:
    """A13."""
    return truth.groupBy("method").agg(F.count_distinct("qid").alias("n"))


def hallucination_rate(audit: DataFrame) -> DataFrame:
    """Audit (hallucinated, answerable): rates over all and over questions without answer, and both counts."""
    h = F.col("hallucinated").cast("int")
    return audit.agg(F.count("*").alias("n"), F.sum(h).alias("hallucinated"), F.round(F.avg(h), 6).alias("rate"), F.round(F.avg(F.when(~F.col("answerable"), h)), 6).alias("rate_no_answer"))


def outcome_classes(audit: DataFrame) -> DataFrame:
    """A14 with classes: count and share of each outcome."""
    total = audit.agg(F.count("*").alias("t"))
    return audit.groupBy("outcome").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("outcome", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def language_crosstab(qa: DataFrame) -> DataFrame:
    """(question_lang, material_lang, hit): counts and hit rates of all combinations and subtotals (nulls)."""
    return qa.cube("question_lang", "material_lang").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))


def question_type_share(qa: DataFrame, *by: str) -> DataFrame:
    """Count and per cent of each value; the total is a small row of its own, no window over everything."""
    total = qa.agg(F.count("*").alias("t"))
    return qa.groupBy(*by).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(*by, "n", F.round(100 * F.col("n") / F.col("t"), 4).alias("percent"))


def describe_stats(figures: DataFrame) -> DataFrame:
    """A17."""
    from quillmill.functions.text import token_count

    t = F.when(F.col("vlm_status") == "described", token_count(F.col("content")))
    return figures.agg(
        F.count_if(F.col("vlm_status") == "described").alias("described"), F.count_if(F.col("vlm_status") == "degraded").alias("degraded"), F.count_if(F.col("image_bytes").isNull()).alias("no_bytes"),
        F.sum(t).alias("tokens"), F.avg(t).alias("mean_tokens"),
    )


def ingest_summary(files: DataFrame) -> DataFrame:
    """Files (status, n_chunks): stored chunks, failed and not attempted files, early abort."""
    is_ = lambda s: F.col("status") == s
    counts = files.agg(F.coalesce(F.sum(F.when(is_("stored"), F.col("n_chunks"))), F.lit(0)).alias("chunks"), F.count_if(is_("failed")).alias("failed"), F.count_if(is_("not_attempted")).alias("not_attempted"))
    return counts.withColumn("aborted_early", F.col("not_attempted") > 0)


def conversation_headers(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, ts): title is the first twenty signs of the first question, else a default."""
    first = F.min_by(F.substring("text", 1, 20), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.coalesce(first, F.lit("New conversation")).alias("title"), F.max("ts").alias("updated_at"))


def newest_first(headers: DataFrame) -> DataFrame:
    """T08."""
    return headers.orderBy(F.desc("updated_at"), "conv_id")
