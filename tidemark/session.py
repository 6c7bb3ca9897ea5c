"""Session helpers: table access, checkpoints in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from atexit import register
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    The functions that run in Python workers refer to it by name, and a worker may neither share
    the driver's folders nor its working directory.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from an archive
        return
    folder = tempfile.mkdtemp(prefix="tidemark-")
    register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "tidemark_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input comes in fewer partitions than half of them.

    For work that costs much CPU per row. A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if 2 * have >= cores else df.repartition(cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, a
    single machine) does a folder of our own take its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    made = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    # Spark makes a folder of its own under the named one; it goes when the driver ends.
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Unlike a checkpoint, the table has a known size, so Spark may broadcast it below
    ``spark.sql.autoBroadcastJoinThreshold`` and joins it by a shuffle beyond that.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_files(df: DataFrame) -> list[str]:
    """Write ``df`` to the shared checkpoint folder and send its files to the executors.

    Gives the files' names for ``SparkFiles.get``: workers read what they need from disk, so the
    rows are never held by the driver.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = sorted(x.getPath().toString() for x in listed if x.getPath().getName().endswith(".parquet"))
    for file in files:
        spark.sparkContext.addFile(file)
    return [file.rsplit("/", 1)[1] for file in files]


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a small dimension; raise if it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it can't be held on the driver")
    return rows


def unicode_trim(col):
    """Strip white space of every kind (Java's \\s is ASCII only)."""
    space = r"[\s\u0085   -     　﻿\x1c-\x1f]+"
    return F.regexp_replace(col, f"^{space}|{space}$", "")
