"""Frames that are written to the folder all executors share, so that lineage ends there and lost executors cost nothing."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCRATCH = "spark.ledgermill.scratch"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one if all tasks run on this machine, as in tests; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SCRATCH, None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(_SCRATCH, folder)
    return folder


@contextlib.contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """While it lasts, stages whose generated method is too long for the JVM to compile (8000 bytes) are made of shorter ones; the setting is put back after."""
    before = spark.conf.get(_METHOD_LIMIT)
    spark.conf.set(_METHOD_LIMIT, "8000")
    try:
        yield
    finally:
        spark.conf.set(_METHOD_LIMIT, before)


def cut(frame: DataFrame, by: str | None = None) -> DataFrame:
    """The frame, written and read again; by: a column of few values, each of which gets a folder, so that readers of some leave out the others."""
    path = f"{shared_folder(frame.sparkSession)}/cut-{uuid.uuid4().hex}"
    (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that shuffle files of frames that are no more are deleted; else they stay until it happens to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
