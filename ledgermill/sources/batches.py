"""Batches of imported rows in a folder: each is written once, whole or not at all, however often it is tried.

A batch has a name, made from its files unless given. Its rows go to parts of the tables that bear this name, so a second try overwrites what an interrupted one left; the merged
accounts go to a version of their own. Last, a line in the manifest says that the batch is there, and which version of the accounts is current. Readers take the parts that
the manifest names, so they never see half a batch, and a batch that the manifest names is not written again. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import Imported

TABLES = ("files", "transactions", "amount_details", "balances")
_MANIFEST = "batch string, position long, committed_at timestamp"


def batch_name(files: DataFrame) -> str:
    """A name that follows from the files' paths and contents, in whatever order they come; from counts and sums, not from the files themselves."""
    row = files.select(F.xxhash64("path", F.sha2("content", 256)).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).head()
    return f"{row['n']}-{(row['x'] or 0) & (1 << 64) - 1:016x}-{int(row['s'] or 0) & (1 << 64) - 1:016x}"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, position, committed_at) of the batches that are there; none in a new folder."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _MANIFEST)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table's rows of all batches that are there, or the current accounts; null before the first batch."""
    known = manifest(spark, folder)
    if table == "accounts":
        last = known.orderBy(F.desc("position")).select("batch").head()
        return None if last is None else spark.read.parquet(f"{folder}/accounts/{last[0]}")
    if known.isEmpty():
        return None
    rows = spark.read.parquet(f"{folder}/{table}")  # parts are directories batch=<name>, so others are pruned
    return rows.join(known.select("batch"), "batch", "left_semi").drop("batch")


def commit(imported: Imported, folder: str, batch: str) -> bool:
    """Writes a batch and then its line in the manifest; false if it was there."""
    spark = imported.files.sparkSession
    known = manifest(spark, folder)
    if not known.where(F.col("batch") == batch).isEmpty():
        return False
    position = (known.agg(F.max("position")).head()[0] or 0) + 1
    for name in TABLES:
        getattr(imported, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    imported.accounts.write.mode("overwrite").parquet(f"{folder}/accounts/{batch}")
    line = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(position).cast("long").alias("position"), F.current_timestamp().alias("committed_at"))
    line.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return True
