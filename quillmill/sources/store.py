"""Deleting rows of a partitioned table on disk: only folders that hold such rows are written anew.

What stays of those folders is written beside the table first, then takes their place by a dynamic partition overwrite; folders
of which nothing stays go. If that is cut short, the next call (or finish_deletion) takes it up where the written rows are whole."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    """A path and its file system; path may be encoded, as Spark names the files that it has read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path."""
    p, fs = _path(spark, path)
    return fs.getContentSummary(p).getLength()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def same(left: str, right: str, on: Sequence[str]):
    """Equality of the columns of two aliased tables, in which nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in on])


def finish_deletion(spark: SparkSession, path: str, folder: str) -> None:
    """Bring a deletion to its end whose rows to stay were written whole."""
    aside = f"{path}.rewrite"
    if exists(spark, f"{aside}/rest/_SUCCESS"):
        rest = spark.read.parquet(f"{aside}/rest")
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)
        touched = spark.read.parquet(f"{aside}/touched")
        emptied = touched.alias("l").join(rest.select(folder).distinct().alias("r").hint("merge"), same("l", "r", [folder]), "left_anti")
        for (name,) in emptied.select("_folder").toLocalIterator():  # folders, whose names the driver lists at each read
            p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    remove(spark, aside)


def delete_rows(spark: SparkSession, path: str, schema: str, folder: str, gone: DataFrame, on: Sequence[str]) -> int:
    """Rows of the table (partitioned by folder, a column of schema) that equal one of gone in the columns of on go; nulls are
    equal. The number of folders that were written anew: with nothing to delete, none is."""
    finish_deletion(spark, path, folder)
    if not exists(spark, path):
        return 0
    aside = f"{path}.rewrite"
    gone.select(*on).distinct().write.mode("overwrite").parquet(f"{aside}/gone")
    gone = spark.read.schema(gone.select(*on).schema).parquet(f"{aside}/gone").alias("r")  # of known size, so Spark picks the join
    rows = spark.read.schema(schema).parquet(path)
    here = rows.select(*{folder: 1, **dict.fromkeys(on)}, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder"))
    here.alias("l").join(gone, same("l", "r", on), "left_semi").select(folder, "_folder").distinct().write.mode("overwrite").parquet(f"{aside}/touched")
    folders = [r[0] for r in spark.read.parquet(f"{aside}/touched").select("_folder").collect()]
    if folders:
        names = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)).toString() for f in folders]
        touched = spark.read.schema(schema).option("basePath", path).parquet(*names)
        touched.alias("l").join(gone, same("l", "r", on), "left_anti").write.mode("overwrite").parquet(f"{aside}/rest")
    finish_deletion(spark, path, folder)
    return len(folders)
