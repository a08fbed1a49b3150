"""Cutting lineage so that a result with several readers is computed once."""

import tempfile
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The shared folder that spark.checkpoint.dir names.

    Only a single-machine session may go without the setting; it gets a folder of its own. A
    cluster session without one is refused, as a machine-local copy is lost with its executor.
    """
    sc = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir())
    if not folder and sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark):
    """What is written inside leaves no shuffle files: they go as soon as each write is done."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table below the shared folder and read again, for many later readers."""
    path = scratch(df.sparkSession, name)
    with tidied(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
