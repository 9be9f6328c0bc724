"""From raw documents to token ids: five stages, each a written table that the next one reads.

Junk goes, one document of each group of near copies stays, documents with benchmark passages go, secrets are blacked out,
and what is left is encoded. Each stage takes all that its predecessor kept.

In every stage but the n-gram join rows are decided one by one: ties and repeated rows, rows without an id and rows with nulls
in other columns have the result of their text alone. Null and empty texts are texts without words: the first stage scores them
as such, they link with nothing, hold no leak and no secret, and have no tokens. Long texts are taken whole. Empty tables give empty
tables. Columns of documents keep their values in all stages but the last, whatever their names; only redaction
changes text and n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, decontam, ngram_join, quality_zstd, queries, secrets
from quillmill.llm.common import Scratch

#: Byte-level merges and three of the filters have no counterpart in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def by_text(docs: DataFrame, operate: Callable[[DataFrame], DataFrame], keep: Column | None = None) -> DataFrame:
    """The columns of docs after operate, which sees text only, and of its rows those to keep: so what it adds or replaces
    can't be taken for a column of docs, nor the other way round."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row")
    out = operate(docs.select(others, "text"))
    return (out if keep is None else out.filter(keep)).select([F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. The model is learned from docs and labels; without labels for both kinds all
    texts have one score, and without any all are rejected (a score of 0.5)."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    return by_text(docs, lambda d: quality_zstd.score(d, model), F.col("predicted") == 1)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies one row stays: with the least id, and of rows that share it the least by text and
    the other columns. Rows without an id can't be linked to others by it: one of each distinct text among them stays."""
    kept = ngram_join.similar_groups(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    row = F.struct("text", *(c for c in docs.columns if c != "text"))
    one = lambda rows, *keys: rows.groupBy(*keys).agg(F.min(row).alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in docs.columns))
    return one(named, "doc_id").union(one(docs.filter("doc_id IS NULL"), "text"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; with an empty benchmark all stay."""
    benchmark = queries.table(spark, sf_dir, "benchmark")
    return by_text(docs, lambda d: decontam.find(d, benchmark), F.size("leaks") == 0)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced in the text, and n_chars follows: null for a null text."""
    return by_text(docs, secrets.redact).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, one row for each: doc_id, lang, source, n_tokens and token_ids."""
    encoded = bpe.encode(docs, bpe.load_ranks(queries.RANKS), public_tokenizers.PATTERN, keep_text=False)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
    return docs
