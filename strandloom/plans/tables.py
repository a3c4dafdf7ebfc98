"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandloom.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("strandloom.shared.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("strandloom.shared.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """The path and its file system, of whatever kind, as the JVM has them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def place(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder, which goes when the application ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/strandloom-{context.applicationId}"
    if getattr(context, "_strandloom_folder", None) != folder:
        path, system = _file_system(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        context._strandloom_folder = folder
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df, written once as Parquet in the application's folder and read again: lineage ends there, and losing an executor loses nothing. `forget` removes the table."""
    spark = df.sparkSession
    ship(spark)
    path = place(spark, label)
    df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._strandloom_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; results that still refer to them can't be read afterwards."""
    for table in tables:
        path, system = _file_system(table.sparkSession, table._strandloom_path)
        system.delete(path, True)
