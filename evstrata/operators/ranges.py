"""Sets of half-open event ranges: which events of which sub-runs an accumulated value covers.

A range is ``(subrun, begin, end)`` of one run.  A range set has a kind besides its ranges:
``invalid``, ``full_run``, ``full_subrun`` or ``explicit``; null never stands for one of them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import EVENT, RUN, SUBRUN
from ..plans.session import tasks_for

# Kinds of range sets, and the statuses of products.
INVALID, FULL_RUN, FULL_SUBRUN, EXPLICIT = "invalid", "full_run", "full_subrun", "explicit"
PRESENT, DUMMY = "present", "dummyToPreventDoubleCount"
#: Event numbers by which ranges of one sub-run number are dealt out.
PART = 1 << 20
#: Fragments whose relations are counted by one task.
FRAGMENTS = 250_000
#: Pieces in which the events of a fragment are dealt out, so that a large one is not in one task.
PIECES = 64


def full_ranges(events: DataFrame, by: tuple[str, ...] = (RUN, SUBRUN)) -> DataFrame:
    """Runs of consecutive events as ranges: islands of equal event minus rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(EVENT))
    return events.withColumn("_g", F.col(EVENT) - rank).groupBy(*by, "_g").agg(F.min(EVENT).alias("begin"), (F.max(EVENT) + 1).alias("end")).drop("_g")


def compact_ranges(events: DataFrame, by: tuple[str, ...] = (RUN, SUBRUN)) -> DataFrame:
    """One range per sub-run, from its first event to one past its last."""
    return events.groupBy(*by).agg(F.min(EVENT).alias("begin"), (F.max(EVENT) + 1).alias("end"))


def merge_ranges(ranges: DataFrame, by: tuple[str, ...] = (RUN, SUBRUN)) -> DataFrame:
    """Overlapping or touching ranges of a sub-run become one."""
    order = Window.partitionBy(*by).orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("_new", F.coalesce((F.col("begin") > reach).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_island")


def merge_range_sets(parts: DataFrame, by: tuple[str, ...], order: str, compact: bool = False) -> DataFrame:
    """The sets of several files as one: ``by, run, subrun, begin, end``.

    All parts of a set are of one run.  In full, their ranges are kept as they are; compact, a sub-run has one range,
    and it is an error if one that is added meets what was gathered before it in the order of ``order``.
    """
    runs = parts.groupBy(*by).agg(F.min(RUN).alias("_low"), F.max(RUN).alias("_high"))
    clash = F.raise_error(F.concat(F.lit("range sets of different runs: "), "_low", F.lit(" and "), "_high"))
    one = F.when(F.col("_low") == F.col("_high"), F.col(RUN)).otherwise(clash)
    rows = parts.join(runs, list(by)).withColumn(RUN, one)
    if not compact:
        return rows.select(*by, RUN, SUBRUN, "begin", "end")
    before = Window.partitionBy(*by, SUBRUN).orderBy(order, "begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    meets = (F.col("begin") < F.max("end").over(before)) & (F.min("begin").over(before) < F.col("end"))
    rows = rows.withColumn("_meets", F.coalesce(meets, F.lit(False)))
    checked = F.when(F.col("_meets"), F.raise_error(F.concat(F.lit("ranges meet in sub-run "), SUBRUN))).otherwise(F.col("begin"))
    return rows.withColumn("begin", checked).groupBy(*by, RUN, SUBRUN).agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def relation_counts(fragments: DataFrame, by: tuple[str, ...] = (RUN, SUBRUN), file: str = "file_no") -> DataFrame:
    """For each sub-run how many pairs of its fragments, from different files, are the ``same``, ``overlap`` or are ``disjoint``.

    Nothing is paired: each fragment counts, by running counts over begins and ends in order, the fragments that
    ended before it began, that began before it and that are equal to it and before it, in all files less in its
    own.  Sub-runs are dealt once, to as many tasks as the number of fragments needs, and these sort and count
    them, so that their memory does not grow with the input.  Fragments without a file or part of their key, or
    of no event, are in no pair.
    """
    tasks = tasks_for(fragments.sparkSession, fragments.count(), FRAGMENTS)
    return _counted_relations(fragments.repartition(tasks, *by), by, file)


def event_relation_counts(events: DataFrame, by: tuple[str, ...] = (RUN, SUBRUN), file: str = "file_no") -> DataFrame:
    """``relation_counts`` of what ``compact_ranges`` makes of events in each file, for sub-runs of few events.

    For such, combining events as they are read saves hardly a row, but holds a table of a whole split.  So they are
    dealt by pieces of fragments, then pieces by sub-runs, to as many tasks as the number of events needs.
    """
    tasks = tasks_for(events.sparkSession, events.count(), FRAGMENTS)
    rows = events.select(*by, file, EVENT, (F.col(EVENT) % PIECES).alias("_piece")).repartition(tasks, *by, file, "_piece")
    pieces = compact_ranges(rows, (*by, file, "_piece")).repartition(tasks, *by)
    return _counted_relations(pieces.groupBy(*by, file).agg(F.min("begin").alias("begin"), F.max("end").alias("end")), by, file)


def _counted_relations(fragments: DataFrame, by: tuple[str, ...], file: str) -> DataFrame:
    """``relation_counts`` of fragments that are dealt by ``by``."""
    # An end comes before a begin at the same event, for ranges are half-open.
    ends, begins, none = 0, 1, -1
    mark = lambda at, kind, other: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), F.col(other).alias("other"))
    known = reduce(and_, (F.col(c).isNotNull() for c in (*by, file, "begin", "end")))
    marks = F.when(known, F.array(mark("begin", begins, "end"), mark("end", ends, "begin"))).otherwise(F.array(mark("begin", none, "end")))
    out = fragments.select(*by, file, F.inline(marks))
    for prefix, keys in (("own", (*by, file)), ("all", by)):
        order = Window.partitionBy(*keys).orderBy("at", "kind", "other")
        until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        count = lambda kind, until=until: F.sum((F.col("kind") == kind).cast("bigint")).over(until)
        out = out.withColumns({f"{prefix}_begun": count(begins), f"{prefix}_ended": count(ends), f"{prefix}_same": F.row_number().over(order) - F.rank().over(order)})
    more = lambda name: F.sum(F.when(F.col("kind") == begins, F.col(f"all_{name}") - F.col(f"own_{name}")).otherwise(0)).cast("bigint")
    counts = out.groupBy(*by).agg(more("begun").alias("pairs"), more("ended").alias("disjoint"), more("same").alias("same"))
    return counts.select(*by, "same", (F.col("pairs") - F.col("same") - F.col("disjoint")).alias("overlap"), "disjoint")


def invalidate_foreign(products: DataFrame, owners: DataFrame, by: tuple[str, ...] = (RUN, SUBRUN)) -> DataFrame:
    """A product whose first interval starts outside its owner's ranges becomes a dummy, so that it is not counted twice.

    Exempt are products made in this job, full or empty sets and those invalid already.
    """
    own = owners.select(*by, F.col("begin").alias("_b"), F.col("end").alias("_e"))
    inside = products.join(own, list(by), "left").groupBy(*products.columns).agg(F.coalesce(F.bool_or((F.col("begin") >= F.col("_b")) & (F.col("begin") < F.col("_e"))), F.lit(False)).alias("_in"))
    exempt = F.col("produced") | F.col("kind").isin(FULL_RUN, FULL_SUBRUN, INVALID) | F.col("begin").isNull()
    keep = exempt | F.col("_in")
    status = F.when(keep, PRESENT).otherwise(DUMMY)
    return inside.select(*(c for c in products.columns if c not in ("value", "kind")), F.when(keep, F.col("kind")).otherwise(INVALID).alias("kind"), F.when(keep, F.col("value")).alias("value"), status.alias("status"))


def range_tables(fragments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised range sets: distinct ranges with ids, sets with ids, and the link table between them.

    ``fragments`` has one row per range of a set named by ``(file_no, run)``.  Ids are dense and follow
    the order of the natural keys, sub-run by sub-run, so no task numbers all ranges.
    """
    from .scan import with_ordinal

    # All runs share the numbers of sub-runs, so a sub-run is numbered in parts by where ranges begin.
    part = F.expr(f"begin div {PART}").alias("_part")
    ranges = fragments.select(SUBRUN, "begin", "end", part).distinct()
    ranges = with_ordinal(ranges, ("begin", "end"), chunk=(SUBRUN, "_part"), name="range_id").drop("_part")
    sets = with_ordinal(fragments.select("file_no", RUN).distinct(), (RUN,), chunk=("file_no",), name="range_set_id")
    links = fragments.join(ranges, [SUBRUN, "begin", "end"]).join(sets, ["file_no", RUN]).select("range_set_id", "range_id").distinct()
    return ranges, sets, links


def resolve(ranges: DataFrame, links: DataFrame, range_set_id: int, compact: bool = False) -> DataFrame:
    """The ranges of one set, or one range per sub-run."""
    out = ranges.join(links.filter(F.col("range_set_id") == range_set_id), "range_id", "left_semi").select(SUBRUN, "begin", "end")
    return out.groupBy(SUBRUN).agg(F.min("begin").alias("begin"), F.max("end").alias("end")) if compact else out


def ranges_meet(a: Column, b: Column) -> Column:
    """Whether two arrays of ranges have an event in common."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["subrun"] == y["subrun"]) & (x["begin"] < y["end"]) & (y["begin"] < x["end"])))


def joined_ranges(a: Column, b: Column) -> Column:
    """Two disjoint arrays of ranges as one, sorted, with touching ranges merged."""
    every = F.array_sort(F.concat(a, b))
    touch = lambda x, y: (x["subrun"] == y["subrun"]) & (x["end"] == y["begin"])
    # A merged range goes from a range that nothing touches from before to one that touches nothing after it.
    first = F.filter(every, lambda x, i: (i == 0) | ~touch(F.get(every, i - 1), x))
    last = F.filter(every, lambda x, i: (i == F.size(every) - 1) | ~touch(x, F.get(every, i + 1)))
    return F.zip_with(first, last, lambda x, y: F.struct(x["subrun"].alias("subrun"), x["begin"].alias("begin"), y["end"].alias("end")))
