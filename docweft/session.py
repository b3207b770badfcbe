"""Session helpers: where to cut lineage, and how to read tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and the master is local
    (tests) does a temporary folder of this machine stand in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="docweft-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cuts_dir(spark: SparkSession) -> str:
    """Where this application cuts lineage and runs streams."""
    return f"{shared_dir(spark).rstrip('/')}/docweft/{spark.sparkContext.applicationId}"


def drop_cuts(spark: SparkSession) -> None:
    """Removes what cut wrote in this application; to be called once the results that read it are taken."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cuts_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df computed once and read back from the shared folder, its lineage cut; it survives lost executors.

    Written as Parquet, not as an RDD checkpoint, so that later reads still prune columns and the
    optimiser knows the size. The files lie under <shared dir>/docweft/<application>; drop_cuts removes them.
    """
    spark = df.sparkSession
    path = f"{cuts_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def tidy(spark: SparkSession) -> None:
    """For loops of many small jobs: plans, classes, broadcasts and shuffle files of past rounds go, which else stay until the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, by: str) -> str:
    """Where df lies in the shared folder, as cut writes it, with a folder by=value for each value; for tasks that read it by pyarrow."""
    path = f"{cuts_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "/", full)


def spread(df: DataFrame) -> DataFrame:
    """The distinct rows of df, hashed over at least four tasks a core, so that costly rows don't pile up in few tasks.

    A fixed number, as small tables of costly rows would else be coalesced. One shuffle serves both.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *df.columns).distinct()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
