"""Shared helpers: scratch storage, table access, digests of text in SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and where it is unset a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillon-scratch"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    Operators discard() what they are done with; what a result still reads is deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files, p = _file_system(spark, path)
    files.deleteOnExit(p)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more; other frames are left alone."""
    for df in written:
        path = getattr(df, "_quillon_path", None)
        if path:
            files, p = _file_system(df.sparkSession, path)
            files.delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver find the exchanges that nothing refers to any more, so that executors delete their files now, not in half an hour."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "piece_bpe_32k.model", folder: str = "/opt/tokenizers") -> str:
    """A public tokenizer's vocabulary file; only the driver reads it."""
    return f"{folder}/{name}"


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
