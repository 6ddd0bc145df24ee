"""What the operators share: lineage cuts, clash-free carrying of columns, null-safe keys."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Six ASCII white-space characters separate words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
ROW = "_row"


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="rollcall-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of our own from the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows as one struct, beside the named columns: nothing can clash with extra columns."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(ROW), *(v.alias(k) for k, v in columns.items()))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"{ROW}.`{c}`").alias(c) for c in like.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: a JVM task and its worker hold one batch of whole texts each, and some
#: texts are very long.
BATCH_ROWS = 1_000


def text_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text and more for a Python worker, in batches of few rows unless the session asks for fewer."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that few texts at a time are Python objects; at the end of a task
    its worker, which Spark keeps, gives free memory back."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        del b
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def one_each(df: DataFrame, keys: list[str], repeated: bool) -> DataFrame:
    """One row for each key.  ``repeated`` is an exact finding of the caller's, made on thin rows;
    without repeats the rows need no further shuffle."""
    return df.dropDuplicates(keys) if repeated else df
