"""Structured Streaming over event files: running statistics, duplicates, windows, latest state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gneiss.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def source(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file; Spark's own listing says which of them a path is."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    files = table.inputFiles()
    if len(files) == 1 and files[0].rpartition("/")[2] == name:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over what there is; its state and progress are in the shared folder."""
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", shared_folder(stream.sparkSession, "stream")).foreachBatch(each).start()
    q.awaitTermination()


def result(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream has written once it is drained: all rows in append mode; in update mode the last batch's row of each of ``keys``."""
    spark = stream.sparkSession
    out = shared_folder(spark, "stream-out")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch_number=-1")  # so that a stream without rows has a result
    drain(stream, mode, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch_number={n}"))
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch_number", IntegerType())])).parquet(out)
    if mode == "append":
        return rows.select(*stream.columns)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch_number").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within, streams keep state in RocksDB, which processors of one key's state need: state lies on disk, not in the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; a row whose window ended ``late`` or more before the newest row seen, as of the batch before the last, is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def running(events: DataFrame) -> DataFrame:
    """Running totals by type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(events: DataFrame) -> DataFrame:
    """The newest value of each key."""
    return events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("version"))
