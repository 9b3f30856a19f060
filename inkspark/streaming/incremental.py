"""The incremental operators as Structured Streaming queries.

Event times are cast to timestamps with a zone, which watermarks need. What is kept: of bursts and requests, those within the
watermark; of progress, a row for each file. Rows go to Parquet files in the shared folder, never to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkspark.sources.scratch import hadoop_path, scratch


def events(spark: SparkSession, folder: str, name: str = "events.parquet", ts: str | None = "ts") -> DataFrame:
    """A stream of the rows of a table of ``folder``, one file or a folder of files, with event time ``ts``."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    path, where = hadoop_path(spark, f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(f"{folder}/{name}") if where.getFileStatus(path).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def first_of_key(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """Concurrent requests for one key are one request while the watermark remembers it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def debounced(stream: DataFrame, key: str, value: str, gap: str, delay: str) -> DataFrame:
    """The last update of each burst; a burst ends with a gap."""
    burst = stream.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by(value, F.struct("ts", value)).alias("value"), F.count(F.lit(1)).alias("updates")).select(key, F.col("w.start").alias("burst_start"), "value", "updates")


def throttled(stream: DataFrame, key: str, every: str, delay: str) -> DataFrame:
    """One refill for each stretch of ``every`` in which something happened."""
    ticks = stream.withWatermark("ts", delay).groupBy(key, F.window("ts", every).alias("w"))
    return ticks.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("tick"), "n")


def file_progress(stream: DataFrame, key: str) -> DataFrame:
    """The latest loaded and total bytes of each (key, file)."""
    return stream.groupBy(key, "file").agg(F.max_by(F.struct("loaded", "total"), F.struct("ts", "seq")).alias("x"))


def with_ending(stream: DataFrame) -> tuple[DataFrame, str]:
    """``stream`` with a second source in a new folder, empty as yet. end() puts a row of the far future there, which lets the
    watermark pass all others; its columns are null but for ts."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    path, where = hadoop_path(spark, folder)
    where.mkdirs(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)), folder


def end(spark: SparkSession, schema: StructType, folder: str) -> None:
    row = spark.range(1).select(*[F.expr("TIMESTAMP '2200-01-01'" if f.name == "ts" else "NULL").cast(f.dataType).alias(f.name) for f in schema])
    row.write.mode("append").parquet(folder)


def run_to_end(stream: DataFrame, mode: str, name: str, checkpoint: str | None = None, ending: tuple[StructType, str] | None = None) -> DataFrame:
    """All rows that are there, through a streaming query into Parquet files in the shared folder: the executors write each
    micro-batch to a folder of its own (again, if it is run again). In mode complete the last batch is the result; in
    mode update rows have the number of their batch in the column ``batch``. With ``ending`` (schema and folder of
    with_ending()) the query goes on from its checkpoint once more after the end, so that open windows close."""
    spark, top, batches = stream.sparkSession, scratch(stream.sparkSession), []

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number).cast("long")) if mode == "update" else batch
        batch.write.mode("overwrite").parquet(f"{top}/rows/{number}")
        batches.append(f"{top}/rows/{number}")

    def run(part: str) -> None:
        writer = stream.writeStream.foreachBatch(write).queryName(f"{name}{part}").outputMode(mode).trigger(availableNow=True)
        writer.option("checkpointLocation", checkpoint or f"{top}/checkpoint").start().awaitTermination()

    run("")
    if ending:
        end(spark, *ending)
        run("_end")
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())]) if mode == "update" else stream.schema
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(batches[-1:] if mode == "complete" else dict.fromkeys(batches)))
