"""Values at given places of sorted groups, without a sort of a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.sources.scratch import scratch_dir

#: Rows of places that are broadcast; more of them are joined by sort and merge.
MOST_PLACES = 100_000


def order_statistics(rows: DataFrame, by: str, value: str, at: DataFrame) -> DataFrame:
    """rows (by, value), at (by, place): (by, place, value): of each group the value at a place, from 0, of its sorted values.
    Nulls come first; places outside of a group, and null groups, have no row.

    Rows are dealt out by range, equal ones too; what each range holds of a group gives, as sums over the ranges before it, the
    range and the row of a place. So a group of any size is spread over tasks, and sums run over as many rows as ranges."""
    spark, root = rows.sparkSession, scratch_dir(rows.sparkSession, "order")
    keys = [F.col("_by"), F.col("_value"), F.col("_salt")]
    named = rows.select(F.col(by).alias("_by"), F.col(value).alias("_value"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt")).filter("_by IS NOT NULL")
    # ids rise inside a partition, whose number is in their upper bits
    placed = named.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_by", "_value", F.monotonically_increasing_id().alias("_id"))
    placed.write.mode("overwrite").parquet(root)
    ordered = spark.read.schema(placed.schema).parquet(root)
    ranges = ordered.groupBy("_by", F.shiftright("_id", 33).alias("_range")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before)
    wanted = at.select(F.col(by).alias("_by"), F.col("place").cast("bigint").alias("_place")).distinct()
    inside = (F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_n"))
    hit = ranges.join(wanted.hint("merge"), "_by").filter(inside).select("_place", (F.col("_first") + F.col("_place") - F.col("_before")).alias("_id"))
    hit.write.mode("overwrite").parquet(f"{root}-hit")
    hit = spark.read.schema(hit.schema).parquet(f"{root}-hit")
    found = ordered.join(hit.hint("broadcast" if hit.count() <= MOST_PLACES else "merge"), "_id")
    return found.select(F.col("_by").alias(by), F.col("_place").alias("place"), F.col("_value").alias(value))
