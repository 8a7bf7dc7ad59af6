"""Durable tables that several passes read, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="foliant-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def release(spark: SparkSession) -> str:
    """Gives memory that the driver's JVM has freed back to the system; what the JVM says of it, or nothing where it can't.

    What its compiler and the threads of each exchange free stays in the C
    library's pools otherwise, outside the heap, and grows with every plan,
    whatever the rows.
    """
    with contextlib.suppress(Py4JError, AttributeError):
        jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
        # The server's own class isn't open to reflection, so its interface's method is called.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    return ""


def dealt(df: DataFrame) -> DataFrame:
    """The rows as a side of a join that deals both sides out by its key, and never sends one to the driver to be broadcast.

    Spark weighs a table by its files. Rows that repeat themselves take a
    hundredth of their size there, and exploded ones count as if they weren't,
    so it would take millions of rows for a small side.
    """
    return df.hint("merge")


def saved(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read again, so that later passes read these and don't make them anew."""
    path = f"{shared_folder(df.sparkSession)}/foliant-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
