"""Session and table helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the session comes from spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERWEAVE_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def with_package(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor the working directory has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if root in known or os.path.abspath(os.getcwd()) == root or getattr(spark.sparkContext, "_ledgerweave_sent", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "ledgerweave"), "zip", root, "ledgerweave")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._ledgerweave_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder, by any path Spark can read."""
    with_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names.

    In local mode (tests, benchmarks) a temporary one is set where none is named; on a cluster that is an error, as a
    folder of one machine would scatter the tables.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerweave-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def growing(df: DataFrame) -> DataFrame:
    """df, which grows with the input, for a join: by a shuffle, as ten megabytes of it on disk may be hundreds in the driver's memory."""
    return df.hint("merge")


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that no unfinished plan reads any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
            df._written_at = None
