"""What the operators share: saved tables, joins that check sizes, and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers each; beyond it, both sides are shuffled.
BROADCAST_ROWS = 500_000
BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only on a local master where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quirekit-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor loses none of it.

    While it is made, Arrow batches have BATCH_ROWS rows at most, so that a batch of long texts or sets is not too large for a worker."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirekit-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    rows = int(spark.conf.get(_BATCH, "10000"))
    small = rows <= 0 or rows > BATCH_ROWS
    if small:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        if small:
            spark.conf.set(_BATCH, str(rows))
    table = spark.read.schema(df.schema).parquet(path)
    table._quirekit_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that saved() made and nothing reads any more, and has the driver drop what it no longer refers to: with that go the shuffle files of what has been saved since."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._quirekit_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Has the driver drop what it no longer refers to, shuffle files of what has been saved among it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def narrow_join(wide: DataFrame, narrow: DataFrame, on: str | list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """wide joined with a saved table of a few numbers a row: broadcast if its rows, counted first, are few enough, else both sides are shuffled."""
    return wide.join(F.broadcast(narrow) if narrow.count() <= limit else narrow.hint("merge"), on, how)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rebatched(it: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same batches, none of more rows than that."""
    for batch in it:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    _release()


def _release() -> None:
    """Has a worker give back the memory that it has freed; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    """The type of an id in SQL: bigint for all whole numbers, its own for others."""
    kind = df.schema[name].dataType.simpleString()
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint", "void") else kind


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id (whole numbers as bigint, others as they are) and text as a string, of the rows that have both."""
    return docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")


def n_tokens(text: Column) -> Column:
    """The tokens of a text: words and single signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: `name`, with underscores before it as needed."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
