"""Inspection reports: counts, sizes on disk, configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import RUN, SUBRUN
from ..functions.text import counted


def count_entries(events: DataFrame, file: str = "file_no", has_results: bool = False) -> DataFrame:
    """Runs and sub-runs (as fragments of the file), events, and whether there is a results record."""
    subruns = events.groupBy(file, RUN, SUBRUN).agg(F.count("*").alias("n"))
    runs = subruns.groupBy(file, RUN).agg(F.count("*").alias("s"), F.sum("n").alias("n"))
    return runs.groupBy(file).agg(F.count("*").alias("runs"), F.sum("s").cast("bigint").alias("subruns"), F.sum("n").cast("bigint").alias("events"), F.lit(int(has_results)).alias("results"))


def count_entries_text(counts: DataFrame, file: str = "file_no") -> DataFrame:
    parts = [counted(F.col(c), noun) for c, noun in (("runs", "run"), ("subruns", "subrun"), ("events", "event"))]
    results = F.when(F.col("results") == 1, ", 1 result").otherwise("")
    return counts.select(file, F.concat(F.concat_ws(", ", *parts), results).alias("report"))


def column_sizes(df: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Logical bytes of each column and its share of all, largest first (then by name), above ``fraction``."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction lies between 0 and 1")
    sizes = df.agg(*(F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).cast("bigint").alias(c) for c in df.columns))
    rows = sizes.unpivot([], df.columns, "column_name", "bytes")
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("fraction", F.col("bytes") / total).filter(F.col("fraction") > fraction)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("bytes").desc(), "column_name")
    return rows.withColumn("rank", F.row_number().over(order))


def stored_sizes(path: str) -> list[tuple[str, int, float]]:
    """Compressed bytes of each column of local Parquet files, from their footers, and its share; largest first."""
    import pyarrow.dataset as ds

    total: dict[str, int] = {}
    for fragment in ds.dataset(path, format="parquet").get_fragments():
        meta = fragment.metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                total[column.path_in_schema] = total.get(column.path_in_schema, 0) + column.total_compressed_size
    every = sum(total.values()) or 1
    return sorted(((n, b, b / every) for n, b in total.items()), key=lambda x: (-x[1], x[0]))


def configurations(sets: DataFrame, kind: str, label_filter: str = ".*") -> DataFrame:
    """Parameter sets of a kind by label, alphabetically; of equal labels the first stored counts.

    The label of a module is its own, that of a service its type or provider, that of a process its name.
    """
    label = {"module": F.col("module_label"), "service": F.coalesce("service_type", "service_provider"), "process": F.col("process_name")}[kind]
    rows = sets.withColumn("label", label).filter(F.col("label").isNotNull() & F.col("label").rlike(label_filter))
    first = rows.groupBy("label").agg(F.min_by("body", "id").alias("body"), F.min("id").alias("id"))
    return first.select("label", "id", "body")
