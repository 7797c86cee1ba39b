"""Plumbing the operators share: the folder for cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose rows are a few dozen bytes wide is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes up to which a wide column is broadcast.
BROADCAST_BYTES = 32 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="evstrata-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    store, p = _store(spark, path)
    store.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Remove what ``cut`` wrote for ``df``, which nothing reads any more; the rest goes when the driver ends."""
    drop_path(df.sparkSession, df._scratch)


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system API, whichever store it lives in."""
    store, p = _store(spark, path)
    store.delete(p, True)


def text_key(text: str | Column = "text") -> Column:
    """What tells texts apart where ids are null or repeated: a digest, empty for a null text."""
    return F.coalesce(F.md5(text), F.lit(""))


def small(df: DataFrame, limit: int = BROADCAST_ROWS, wide: str | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``limit`` rows; otherwise leave the join to shuffle.

    Rows are narrow but for the column ``wide``, whose bytes are counted, too.
    """
    few = df.limit(limit + 1)
    n, size = few.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(wide)), F.lit(0)) if wide else F.lit(0)).first()
    return F.broadcast(df) if n <= limit and size <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
