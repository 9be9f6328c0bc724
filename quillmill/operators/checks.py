"""The contract of question tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("id", "subject", "question_type", "question", "standard_answer", "source_location")


def qa_schema_violations(qa: DataFrame, types: Sequence[str], subjects: Sequence[str], no_answer: str = "no_answer") -> DataFrame:
    """(id, rule), a row for each rule that a question breaks; a repeated id comes once."""
    missing = F.lit(False)
    blank = F.lit(False)
    for f in FIELDS:
        missing, blank = missing | F.col(f).isNull(), blank | (F.trim(F.col(f)) == "")
    n = F.coalesce(F.size("supporting_chunks"), F.lit(0))
    without = F.col("question_type") == no_answer
    rules = F.array_compact(F.array(
        F.when(missing | F.col("supporting_chunks").isNull(), "missing field"), F.when(F.coalesce(blank, F.lit(False)), "blank field"),
        F.when(~F.col("question_type").isin(list(types)), "unknown type"), F.when(~F.col("subject").isin(list(subjects)), "unknown subject"),
        F.when(without & (n > 0), "chunks without answer"), F.when(~without & (n == 0), "answer without chunks"),
    ))
    twice = qa.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("rule"))
    return qa.select("id", F.explode(rules).alias("rule")).union(twice)
