"""Streams of events: windows and sessions with watermarks, deduplication, and running a stream to its end.

Timestamps without a zone are read as UTC, as a watermark needs a timestamp with one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docweft.session import cuts_dir


def read_stream(spark: SparkSession, path: str, time: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet folder or file as a stream, time cast to a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    df = source.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else source.parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def tumbling(df: DataFrame, time: str, width: str, delay: str, *by: str) -> DataFrame:
    """(window_start, *by, n, total) per window, append mode: a window comes out once the watermark has passed it."""
    w = df.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, delay: str, by: str) -> DataFrame:
    """(by, session_start, session_end, n): runs of events without a pause of gap."""
    s = df.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count("*").alias("n"))
    return s.select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def distinct_within(df: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """The first row of each key; later ones within the watermark are dropped, and the state of old keys with it."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_end(df: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """All that the stream gives from what is there now, exactly once, written to the shared folder and read back.

    append: windows that the watermark has not passed stay open. update: every batch writes the rows that changed into a folder of its own, and the last state of
    each of the keys is read, so windows still open come out too, while the state behind the watermark is dropped. complete: the last state as a whole.
    """
    spark = df.sparkSession
    base = f"{cuts_dir(spark)}/{uuid.uuid4().hex}"
    out, state = f"{base}/out", f"{base}/state"
    writer = df.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).outputMode("append").start()
    elif mode == "update":
        # A batch that runs again overwrites its own folder.
        q = writer.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    else:
        q = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    if mode != "update":
        return spark.read.schema(df.schema).parquet(out)
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(out)
    rest = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("x"))
    return last.select(*[F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in df.columns])
