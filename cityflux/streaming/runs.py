"""Start a bounded streaming run, let it finish, and find its output on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..sources import files


def read_stream(
    spark: SparkSession, directory: str, schema, pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Append-mode output as a table: the file sink commits each batch exactly once."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def run_update(stream: DataFrame, label: str) -> DataFrame:
    """Update-mode output: every changed row per batch, tagged with its ``epoch``.

    A batch that is tried again overwrites its own folder.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    schema = stream.schema.add("epoch", "long")
    return spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows")


def save_in_order(df: DataFrame, label: str, ts: str, parts: int = 4) -> str:
    """A derived table in slices of time, written one after the other, each by many tasks.

    The table is written once with every file holding a stretch of time, so a slice reads
    only its own files. Every slice has the same number of files: files of a slice are as old as
    each other, so a batch that ended inside one would bring its times in any order.
    ``stream_in_order`` reads a slice per batch, as a live source would have brought it.
    Rows without a time are left out.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    rows = spark.read.parquet(save_table(df.repartitionByRange(ts), f"{label}-whole"))
    us = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    cuts = rows.select(us.alias("us")).approxQuantile("us", [k / parts for k in range(1, parts)], 0.01)
    kind = rows.schema[ts].dataType
    borders = [F.timestamp_micros(F.lit(int(c))).cast(kind) for c in cuts]
    each = -(-rows.rdd.getNumPartitions() // parts)
    nothing = spark.createDataFrame([], rows.schema).coalesce(1)
    for k, (low, high) in enumerate(zip([None, *borders], [*borders, None]), 1):
        inside = F.col(ts).isNotNull()
        inside = inside if low is None else inside & (F.col(ts) >= low)
        inside = inside if high is None else inside & (F.col(ts) < high)
        rows.where(inside).repartitionByRange(each, ts).write.mode("append").parquet(path)
        for _ in range(_parquet_files(spark, path), k * each):  # equal times share a file
            nothing.write.mode("append").parquet(path)
    return path


def _parquet_files(spark: SparkSession, directory: str) -> int:
    return sum(name.endswith(".parquet") for name in files.children(spark, directory))


def stream_in_order(spark: SparkSession, directory: str, schema, batches: int = 4) -> DataFrame:
    """The files of a folder as a stream of about ``batches`` batches, oldest files first."""
    number = _parquet_files(spark, directory)
    return read_stream(spark, directory, schema, files_per_batch=max(1, -(-number // batches)))


def save_table(df: DataFrame, label: str) -> str:
    """A derived table written to shared storage, to be streamed from there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path
