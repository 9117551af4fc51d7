"""Helpers shared by the training-data operators: tables, words, written cuts of the lineage."""

from __future__ import annotations

import ctypes
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a default.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + os.path.abspath("/tmp/checkpoints/weftgraph")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    p = _hadoop_path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store; missing ones are no error."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def give_back() -> None:
    """Returns a Python worker's free memory to the system, for the tasks that use the worker next."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def settle(spark: SparkSession) -> None:
    """Between the rounds of a loop: Spark's cleaner drops the broadcasts and shuffle files of rounds that are done, and
    the driver's free memory goes back to the system.

    The cleaner drops what the driver's garbage collector has found unused, which may not run for many rounds.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    # the server's class is not public, so its method is called by the interface's name
    of = jvm.Class.forName
    kinds = [of(k) for k in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *kinds))
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, commands, "systemTrimNativeHeap", None, None))
    except Py4JJavaError:  # a JVM without that command
        pass


class Cut:
    """A table written to the shared folder: it cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def columns_of(df: DataFrame, *needed: str) -> DataFrame:
    """Only the columns an operator reads, so that extra ones with clashing names do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
