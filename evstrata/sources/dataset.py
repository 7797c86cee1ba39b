"""A data set on disk: a folder of Parquet tables for events, sub-runs, runs and results, with sidecar tables.

Sidecars hold the format, the index, products and their lineage, process histories, parameter sets,
range sets and catalog metadata; every one is a plain table that other tools can read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import KEY
from ..operators import output, ranges, scan

ERA, VERSION = "evstrata", 15
SIDECARS = ("format", "file_index", "products", "lineage", "parentage", "process_history", "parameter_sets", "event_ranges", "range_sets", "range_set_members", "catalog_metadata")


class DataSetError(ValueError):
    """A data set that cannot be read as one."""


def parentage_id(parents: list[int]) -> str:
    """The checksum by which a list of parents is named."""
    return hashlib.sha256(json.dumps(parents).encode()).hexdigest()


def write_dataset(
    events: DataFrame, path: str, products: DataFrame | None = None, lineage: DataFrame | None = None, histories: DataFrame | None = None, parameters: DataFrame | None = None, parents: list[list[int]] = (), results: DataFrame | None = None,
    metadata: dict[str, str] | None = None, run_type: str | None = None, drop_events: bool = False, drop_subruns: bool = False,
) -> None:
    """Write ``events`` (with ``file_no``, ``entry`` and ``ts``) and everything that describes them."""
    spark = events.sparkSession
    output.write_levels(events, path, drop_events, drop_subruns)
    if results is not None:
        results.limit(1).write.mode("overwrite").parquet(f"{path}/results")
    fragments = ranges.full_ranges(events, ("file_no", "run", "subrun"))
    event_ranges, range_sets, members = ranges.range_tables(fragments)
    tables = {
        "format": spark.createDataFrame([(ERA, VERSION)], "era string, version int"), "file_index": scan.file_index(events).orderBy("file_no", "position"), "event_ranges": event_ranges, "range_sets": range_sets, "range_set_members": members,
        "catalog_metadata": output.catalog_metadata(events, run_type=run_type, version=VERSION, extra=metadata), "parentage": spark.createDataFrame([(parentage_id(p), p) for p in parents], "parentage_id string, parents array<bigint>"),
        "products": products, "lineage": lineage, "process_history": histories, "parameter_sets": parameters,
    }
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/_{name}_")


@dataclass
class DataSet:
    spark: SparkSession
    path: str

    @staticmethod
    def open(spark: SparkSession, path: str) -> DataSet:
        """Check the format, that there is an index with entries, and the checksums of parentage."""
        self = DataSet(spark, path)
        form = self.sidecar("format")
        if form is None:
            raise DataSetError(f"{path} has no format table")
        era, version = form.first()
        if era != ERA:
            raise DataSetError(f"{path} is of era {era!r}, not {ERA!r}")
        if version > VERSION:
            raise DataSetError(f"{path} has format version {version}; the newest known is {VERSION}")
        index = self.sidecar("file_index")
        if index is None or index.isEmpty():
            raise DataSetError(f"{path} has no index entry")
        parentage = self.sidecar("parentage")
        if parentage is not None:
            named = F.sha2(F.concat(F.lit("["), F.array_join(F.col("parents").cast("array<string>"), ", "), F.lit("]")), 256)
            if not parentage.filter(named != F.col("parentage_id")).isEmpty():
                raise DataSetError(f"{path} has a parentage whose checksum differs")
        return self

    def _table(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def sidecar(self, name: str) -> DataFrame | None:
        """A sidecar table, None if the data set lacks it."""
        if name not in SIDECARS:
            raise DataSetError(f"no such table: {name}")
        return self._table(f"_{name}_")

    def level(self, name: str) -> DataFrame:
        """``events``, ``subruns`` or ``runs``; those that were dropped on output are empty."""
        found = self._table(name)
        keys = {"events": KEY, "subruns": KEY[:2], "runs": KEY[:1]}[name]
        return found if found is not None else self.spark.createDataFrame([], ", ".join(f"{k} bigint" for k in keys))

    def results(self) -> DataFrame | None:
        """The one results record, None without one."""
        found = self._table("results")
        return None if found is None else found.limit(1)

    def export(self, path: str) -> list[str]:
        """Copy the sidecar tables to another folder."""
        done = []
        for name in SIDECARS:
            df = self.sidecar(name)
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
                done.append(name)
        return done
