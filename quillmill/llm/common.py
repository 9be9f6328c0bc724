"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares of the hash space of which bounded_sample() takes the least that holds enough rows.
SHARES = tuple(4.0**-k for k in range(20, -1, -1))
#: ASCII white space, as Java's and RE2's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers up to which a written table goes to every task of a join: below 32 MB.
FEW_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs on one machine, as in
    tests, a folder of our own."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Written tables in the shared folder: they cut lineage, survive lost executors and have a known size."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Spark deletes the shuffle files of plans that nothing refers to any more; without a collection on the driver
        they would stay until the operator ends."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def rows_in_a_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """At most n rows at a time from Parquet and to Python, in the plans that are run inside: for tables of large rows."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    were = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, str(n))
    try:
        yield
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add; names compare as Spark compares them."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def is_few(df: DataFrame) -> bool:
    """Whether a written table has at most FEW_ROWS rows."""
    return df.count() <= FEW_ROWS


def beside(df: DataFrame, few: bool) -> DataFrame:
    """A side of a join: few rows go to the tasks of the other side, which stay as they are; else both are sorted and merged."""
    return df.hint("broadcast" if few else "merge")


def held_out(key: str = "doc_id", remainder: int = 2) -> Column:
    """crc32 of the id as text, modulo 4, equals remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == remainder, F.lit(False))


def append_arrow(
    df: DataFrame,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add columns computed from Arrow batches inside the tasks that already hold the rows: no shuffle.

    make() is called once per task and returns the function of a batch; columns in drop are read but not returned."""
    df = without(df, *(f.name for f in fields))
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            new = of(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + new, names=names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    """One text at a time, so that a batch is never held twice."""
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(name)))


def portions(many: Iterator[str | None], most: int) -> Iterator[list[str | None]]:
    """Lists of texts with at most so many signs together, or one longer text alone."""
    some: list[str | None] = []
    taken = 0
    for text in many:
        if some and taken + len(text or "") > most:
            yield some
            some, taken = [], 0
        some.append(text)
        taken += len(text or "")
    if some:
        yield some


def bounded_sample(df: DataFrame, by: str, key: Column, per_value: int) -> DataFrame:
    """The per_value rows of each value of by with the least hashes of key: the same rows at any partitioning.

    The values are few (labels, languages): their counts come to the driver. They say which of SHARES of the
    hashes is the least that holds enough rows, so about four times as many as are wanted are sorted, in one task for a value."""
    place = F.xxhash64(key).cast("double") / 2.0**64 + 0.5
    counts = df.groupBy(by).agg(*(F.count(F.when(place <= share, 1)).alias(f"n{k}") for k, share in enumerate(SHARES))).collect()
    limit = F.lit(1.0)
    for r in counts:
        limit = F.when(F.col(by).eqNullSafe(F.lit(r[0])), next((s for k, s in enumerate(SHARES) if r[k + 1] >= per_value), 1.0)).otherwise(limit)
    w = Window.partitionBy(by).orderBy(F.xxhash64(key), key)
    return df.filter(place <= limit).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_value).drop("_rank")
