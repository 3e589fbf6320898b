"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast; above either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: Bytes of a value by type, as a hash relation holds it, and those of any other type (strings, binaries, arrays).
_WIDTHS, _WIDE = {"tinyint": 8, "smallint": 8, "int": 8, "bigint": 8, "float": 8, "double": 8, "boolean": 8, "date": 8, "timestamp": 8}, 96


def local_session(cpus: int | str = 8, app: str = "faultloom") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    parts = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir.

    Where it is unset, a temporary folder is set once for a session in one process; on a cluster that is an error, as
    every executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="faultloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; label only helps a human reader."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def clean_up(spark: SparkSession) -> None:
    """Remove what this application has written to the shared folder; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most bound rows and some BROADCAST_BYTES, else as it is (the join then shuffles).

    The count runs df once: give it a materialised table, or a cheap plan.
    """
    row = 16 + sum(_WIDTHS.get(t, _WIDE) for _, t in df.dtypes)
    return F.broadcast(df) if df.count() <= min(bound, BROADCAST_BYTES // row) else df
