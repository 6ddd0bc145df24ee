"""Form submissions as a stream: each micro-batch is ingested into a versioned record table.

A version is a folder of its own and is complete once its marker is written, so a batch that is run
again after a failure overwrites its own version and nothing else: the sink is idempotent by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import cut
from ..operators.ingest import ingest
from ..sources.leads import FORM_SCHEMA, exists, project_submissions, valid_submissions


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions from files of one JSON object a line, as they arrive."""
    return spark.readStream.schema(FORM_SCHEMA).json(folder)


def numbered(rows: DataFrame) -> DataFrame:
    """Arrival numbers, dense by task: order within a file is kept."""
    return rows.withColumn("sub", F.monotonically_increasing_id())


def version_path(table: str, version: int) -> str:
    return f"{table}/v{version:012d}"


def current_version(spark: SparkSession, table: str) -> int:
    """The newest complete version, -1 without one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n[1:]) for n in names if n.startswith("v") and exists(spark, f"{table}/{n}/leads/_SUCCESS")]
    return max(done, default=-1)


def merge_batch(table: str, now: Callable[[], str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function.  Batch n reads version n and writes version n + 1."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        leads = spark.read.parquet(f"{version_path(table, number)}/leads")
        accepted, rejected = valid_submissions(batch)
        subs = cut(project_submissions(numbered(accepted)))
        done = ingest(leads, subs, now())
        out = version_path(table, number + 1)
        rejected.write.mode("overwrite").json(f"{out}/rejected")
        done.outcomes.write.mode("overwrite").parquet(f"{out}/outcomes")
        done.leads.write.mode("overwrite").parquet(f"{out}/leads")

    return run


def start(submissions: DataFrame, table: str, checkpoint: str, now: Callable[[], str], **trigger) -> StreamingQuery:
    """Ingests a stream into ``table``, whose version 0 holds the records to begin with."""
    return submissions.writeStream.foreachBatch(merge_batch(table, now)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
