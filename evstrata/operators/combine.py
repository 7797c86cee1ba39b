"""Partial results that meet: ordered combination of fragments, availability, merged times, histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import EXPLICIT, FULL_RUN, FULL_SUBRUN, INVALID, joined_ranges, ranges_meet

#: How values of a product type are combined.
MERGES: dict[str, Callable[[Column, Column], Column]] = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
# Fixed value: the first format version with range sets.
RANGE_SETS_FROM = 9
# Fixed value: the category under which this error is known.
OVERLAP = "ProductCannotBeAggregated"


def combine_fragments(fragments: DataFrame, by: tuple[str, ...], merge: str | Callable[[Column, Column], Column] = "sum", strict: bool = False) -> DataFrame:
    """Fold the fragments of each product in entry order: ``kind, ranges, value, status``.

    A fragment is held against what has been accumulated so far: both invalid, nothing; one valid, that
    one; the same ranges, the newcomer is ignored; disjoint, values and ranges are combined; else the
    product cannot be aggregated, which is a status, or an error when ``strict``.  So A, A, B combine and A, B, A do not.
    ``merge`` is a name in ``MERGES`` or a function of two values.  Fragments of a product are those of one run or
    sub-run, one from each file, so an array holds them.
    """
    combine = MERGES[merge] if isinstance(merge, str) else merge
    items = F.array_sort(F.collect_list(F.struct("entry", "kind", "ranges", "value")))
    folded = fragments.groupBy(*by).agg(items.alias("_items"))
    ranges_type = fragments.schema["ranges"].dataType.simpleString()
    value_type = fragments.schema["value"].dataType.simpleString()
    start = F.struct(F.lit(INVALID).alias("kind"), F.array().cast(ranges_type).alias("ranges"), F.lit(None).cast(value_type).alias("value"), F.lit("ok").alias("status"))

    def step(m: Column, n: Column) -> Column:
        as_is = lambda x, status: F.struct(x["kind"].alias("kind"), x["ranges"].alias("ranges"), x["value"].alias("value"), F.lit(status).alias("status"))
        same = (m["kind"] == n["kind"]) & (m["ranges"] == n["ranges"])
        apart = (m["kind"] == EXPLICIT) & (n["kind"] == EXPLICIT) & ~ranges_meet(m["ranges"], n["ranges"])
        both = F.struct(F.lit(EXPLICIT).alias("kind"), joined_ranges(m["ranges"], n["ranges"]).alias("ranges"), combine(m["value"], n["value"]).alias("value"), F.lit("ok").alias("status"))
        return F.when((m["status"] != "ok") | (n["kind"] == INVALID) | ((m["kind"] != INVALID) & same), m).when(m["kind"] == INVALID, as_is(n, "ok")).when(apart, both).otherwise(as_is(m, OVERLAP))

    out = folded.select(*by, F.aggregate("_items", start, step).alias("_m")).select(*by, "_m.*")
    if strict:
        out = out.withColumn("status", F.when(F.col("status") == OVERLAP, F.raise_error(F.lit(OVERLAP))).otherwise(F.col("status")))
    return out


def first_of_old_files(fragments: DataFrame, by: tuple[str, ...], level: str, version: str = "version") -> DataFrame:
    """Fragments as ``combine_fragments`` takes them where files before range sets are among them.

    If the first fragment of a product is of such a file, it stands for the whole run or sub-run (``level``) and is all
    that is read.
    """
    first = fragments.groupBy(*by).agg(F.min_by(version, "entry").alias("_version"), F.min("entry").alias("_entry"))
    old = F.col("_version") < RANGE_SETS_FROM
    rows = fragments.join(first, list(by)).filter(~old | (F.col("entry") == F.col("_entry")))
    whole = FULL_RUN if level == "run" else FULL_SUBRUN
    nothing = F.array().cast(fragments.schema["ranges"].dataType.simpleString())
    return rows.withColumns({"kind": F.when(old, whole).otherwise(F.col("kind")), "ranges": F.when(old, nothing).otherwise(F.col("ranges"))}).drop("_version", "_entry")


def dummy_product(kind: str) -> Column:
    """What stands for a product of a type that is not there."""
    return F.lit(None).cast(kind)


def available(statuses: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A product is there after combination if any fragment has it."""
    return statuses.groupBy(*by).agg(F.bool_or(F.col("status") == "present").alias("available"))


def merge_auxiliary(parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The earliest begin and the latest end of a container's fragments."""
    return parts.groupBy(*by).agg(F.min("begin_ts").alias("begin_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n_fragments"))


def bin_number(x: Column, low: float, high: float, bins: int) -> Column:
    """0 below ``low``, 1 to ``bins`` inside, ``bins`` + 1 from ``high`` on."""
    return F.when(x < low, 0).when(x >= high, bins + 1).otherwise(F.least(F.lit(bins), F.floor((x - low) * bins / (high - low)).cast("int") + 1)).cast("int")


def histogram(df: DataFrame, axes: dict[str, tuple[Column, float, float, int]], by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Counts by bin, or sums of ``weight``; each axis is a value, its limits and a number of bins.  Empty bins have no row.

    A folder of histograms is one table with their names among ``by``.
    """
    bins = {name: bin_number(*axis) for name, axis in axes.items()}
    content = F.count("*") if weight is None else F.sum("_weight")
    one = F.lit(1) if weight is None else weight
    return df.select(*by, *(b.alias(n) for n, b in bins.items()), one.alias("_weight")).groupBy(*by, *bins).agg(content.alias("content"))


def merge_histograms(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Histograms of equal binning added bin by bin."""
    return parts.groupBy(*keys).agg(F.sum("content").cast("bigint").alias("content"))
