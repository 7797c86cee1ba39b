"""Session settings, and cutting the lineage of iterative plans in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_session(name: str = "evstrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC, for local runs; on a cluster the launcher's settings stay."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return builder.config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, as in tests, a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="evstrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write and reread: later stages and lost executors start from the files."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    # The files go when the driver ends.
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a narrow side is broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` of ``rows`` rows if they are at most ``limit``; beyond that the join sorts and merges.

    Left to itself the planner goes by the bytes of files, in which millions of sorted numbers are few.
    """
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``sized`` by a count that ends beyond ``limit``."""
    return sized(df, df.limit(limit + 1).count(), limit)


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for ``rows`` of which one can hold ``each``, but at least one for each core.

    The number of shuffle partitions is fixed, and adaptive execution sizes them by compressed bytes, of which
    sorted numbers have few for many rows.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))
