"""Reading data sets of several files, and views of the driver's tables as hierarchical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import KEY
from ..plans.session import small


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain_path(path: Column) -> Column:
    """Local paths without their scheme, others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_files(spark: SparkSession, paths: list[str], skip_bad: bool = False, require: tuple[str, ...] = KEY) -> DataFrame:
    """Many files, or folders of files, in catalog order: ``file_no`` is the place in ``paths``, ``entry`` a row's place in its file.

    All are read at once, and each row finds its file's place by name.  Columns that only some files have are
    null for the others.  A row without one of the columns ``require`` is an error, which names the file; with
    ``skip_bad`` such files are left out, as are missing and corrupt ones.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    catalog = []
    for number, path in enumerate(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        store = p.getFileSystem(conf)
        if not skip_bad or store.exists(p):
            catalog.append((store.makeQualified(p).toString(), number))
    if not catalog:
        raise ValueError("no file could be read")
    reader = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", skip_bad)
    rows = reader.parquet(*(p for p, _ in catalog))
    missing = sorted(set(require) - set(rows.columns))
    if missing:
        raise ValueError(f"no file has {missing}")
    places = spark.createDataFrame(catalog, "_path string, file_no int").select(_plain_path(F.col("_path")).alias("_path"), "file_no")
    rows = rows.select("*", F.col("_metadata.row_index").alias("entry"), _plain_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("_file"))
    # A file is named itself, or the folder that it lies in is.
    named = F.explode(F.array("_file", F.regexp_replace("_file", "/[^/]*$", ""))).alias("_path")
    rows = rows.select("*", named).join(small(places), "_path")
    lacking = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in require))
    if skip_bad:
        return rows.filter(lacking == "").drop("_path", "_file")
    checked = F.when(lacking != "", F.raise_error(F.concat("_file", F.lit(" lacks "), lacking))).otherwise(F.col("file_no"))
    return rows.withColumn("file_no", checked).drop("_path", "_file")


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` by day as run and hour as sub-run."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        (F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) + 1).cast("int").alias("run"), F.hour("ts").cast("int").alias("subrun"), F.col("event_id").alias("event"), F.col("event_id").alias("entry"),
        F.col("event_type").alias("dataset"), (F.col("event_type") != "view").alias("is_real_data"), "ts", "user_id", "value", "props",
    )


EVENTS_SQL = """h1 as (select cast(date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as int) as run, cast(extract(hour from ts) as int) as subrun,
  event_id as event, event_id as entry, event_type as dataset, event_type <> 'view' as is_real_data, ts, user_id, value, props from events)"""


def split_events_view(spark: SparkSession, sf_dir: str, rows: int = 1700) -> DataFrame:
    """The same as if stored in files of ``rows`` events, so that sub-runs straddle files."""
    return events_view(spark, sf_dir).withColumn("file_no", F.expr(f"cast(event div {rows} as int)"))


SPLIT_SQL = EVENTS_SQL + ", h5 as (select *, cast(event // 1700 as int) as file_no from h1)"

#: The total order of ``copies_view`` within a file.
COPY_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def copies_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as events of four files in which IDs recur."""
    line = read_table(spark, sf_dir, "lineitem")
    return line.select(
        F.expr("cast(l_orderkey div 1000 + 1 as int)").alias("run"), F.expr("cast(l_orderkey % 1000 as int)").alias("subrun"), F.col("l_linenumber").cast("bigint").alias("event"), F.expr("cast(l_suppkey % 4 as int)").alias("file_no"), "l_orderkey", *COPY_ORDER,
    )


COPIES_SQL = """h2 as (select cast(l_orderkey // 1000 + 1 as int) as run, cast(l_orderkey % 1000 as int) as subrun, cast(l_linenumber as bigint) as event,
  cast(l_suppkey % 4 as int) as file_no, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus from lineitem)"""
COPY_ORDER_SQL = ", ".join(COPY_ORDER)
