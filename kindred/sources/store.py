"""Intermediates that end lineage: tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session (tests) without one gets a new one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kindred-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: lineage ends there, so no executor's loss brings back what was before."""
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles of plans that are done, which it does once the driver's garbage is collected. The threads that tell of a query's end hold its plan until they tell of another, so an empty one follows."""
    spark.sql("SELECT 1").collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession) -> None:
    """Removes all that this application has stored. For callers that have read or written their results: results of queries are lazy and read these tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(df: DataFrame, by: list[str], *order, name: str = "position", first: int = 0) -> DataFrame:
    """df with each row's number within its group, from `first`, in the given order (equal rows in any).

    Sorted once as a whole by ranges and stored; then counted in two levels, within a stretch of the sorted table (a task's
    rows) and over stretches, so that a group of any size is never in one task.
    """
    ranged = df.withColumn("_own", F.monotonically_increasing_id()).orderBy(*by, *order, "_own").drop("_own")
    rows = stored(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_stretch", F.shiftright("_at", 33))
    own = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy("_at"))
    counts = rows.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*by).orderBy("_stretch")) - F.col("_n")).alias("_before")
    counts = counts.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("_stretch").alias("_s"), before)
    same = F.col("_stretch") == F.col("_s")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    joined = rows.withColumn("_row", own).join(counts, same)
    return joined.withColumn(name, F.col("_row") + F.col("_before") + (first - 1)).select(*df.columns, name)
