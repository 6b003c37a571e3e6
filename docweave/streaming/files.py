"""Table folders as streams, and the shared folder streaming jobs keep their state in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one job under ``spark.checkpoint.dir``, the folder all executors share.

    Only a local master may do without the setting: there one temporary folder serves the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """``df`` written once to a shared folder and read back: the cut of a lineage that survives lost executors."""
    folder = work_folder(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The parquet files of a table (a folder or one file) as a stream; every file is taken once.

    The last character is written as a glob because the file source accepts a single file only that way.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def run_batches(stream: DataFrame, folder: str, each, mode: str = "append") -> None:
    """Process what is available in micro-batches, ``each(batch, batch_id)``, and stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Append a stream to a parquet table and read the table."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def write_batch(rows: DataFrame, folder: str, batch_id: int, *partitions: str) -> None:
    """One folder per batch, overwritten when the batch is retried: replays change nothing."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{folder}/batch={batch_id}")
