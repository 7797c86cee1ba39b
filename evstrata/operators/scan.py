"""Ordered scans: index, start positions, limits, duplicates, random access."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import EVENT, KEY, RUN, SUBRUN, EventID, id_struct
from ..plans.session import small


class Mode(Enum):
    """Which levels of the hierarchy are processed."""

    RUNS = 1
    RUNS_AND_SUBRUNS = 2
    ALL = 3


def file_index(events: DataFrame, file: str = "file_no") -> DataFrame:
    """One element per event and per fragment of a run or sub-run in a file, numbered in ID order; containers come first."""
    event = events.select(file, RUN, SUBRUN, EVENT, F.lit("event").alias("entry_type"), "entry")
    nothing = F.lit(None).cast("bigint")
    subrun = events.select(file, RUN, SUBRUN).distinct().select(file, RUN, SUBRUN, nothing.alias(EVENT), F.lit("subrun").alias("entry_type"), nothing.alias("entry"))
    run = events.select(file, RUN).distinct().select(file, RUN, F.lit(None).cast("int").alias(SUBRUN), nothing.alias(EVENT), F.lit("run").alias("entry_type"), nothing.alias("entry"))
    every = event.unionByName(subrun).unionByName(run)
    return with_ordinal(every, (EVENT,), within=(file,), name="position")


def with_ordinal(df: DataFrame, keys: tuple[str, ...], within: tuple[str, ...] = (), chunk: tuple[str, ...] = (RUN, SUBRUN), name: str = "ordinal") -> DataFrame:
    """Number rows from 1 by ``chunk`` then ``keys``, separately for each ``within``.

    Rows are ranked inside their chunk, and chunks are counted once: only one row per chunk is ever
    gathered, so a numbering of all rows needs no task that sees all rows.
    """
    groups = [*within, *chunk]
    sizes = _chunks(df, within, chunk)
    inside = Window.partitionBy(*groups).orderBy(*(F.col(c).asc_nulls_first() for c in keys or chunk))
    ranked = df.withColumn("_rank", F.row_number().over(inside))
    return _by_chunk(ranked, sizes, groups).withColumn(name, F.col("_before") + F.col("_rank")).drop("_n", "_before", "_rank")


def _chunks(df: DataFrame, within: tuple[str, ...], chunk: tuple[str, ...]) -> DataFrame:
    """Each chunk with its number of rows ``_n`` and that of all chunks ``_before`` it."""
    sizes = df.groupBy(*within, *chunk).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return sizes.withColumn("_before", F.sum("_n").over(order.orderBy(*(F.col(c).asc_nulls_first() for c in chunk))) - F.col("_n"))


def _by_chunk(df: DataFrame, sizes: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """``df`` beside the chunk that each row is in; a null is a value like any other."""
    named = sizes.select(*(F.col(c).alias(f"_chunk_{c}") for c in groups), "_n", "_before")
    same = F.lit(True)
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"_chunk_{c}"))
    return df.join(named, same, how).drop(*(f"_chunk_{c}" for c in groups))


def from_first(events: DataFrame, run: int = 0, subrun: int = 0, event: int = 0) -> DataFrame:
    """Events from the start position on: earlier runs, then earlier sub-runs of that run, then earlier events go."""
    return events.filter(id_struct() >= EventID(run, subrun, event).struct()).filter(F.col(RUN) >= run)


def skip_and_limit(events: DataFrame, skip: int = 0, limit: int | None = None, order: tuple[str, ...] = KEY) -> DataFrame:
    """``limit`` events after the first ``skip`` by run, sub-run and the rest of ``order``.

    Counts per sub-run tell which sub-runs the wanted ones lie in, and only those are ranked.
    """
    chunk, rest = order[:2], order[2:]
    sizes = _chunks(events, (), chunk).filter(F.col("_before") + F.col("_n") > skip)
    sizes = sizes if limit is None else sizes.filter(F.col("_before") < skip + limit)
    near = _by_chunk(events, sizes, list(chunk))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*chunk).orderBy(*(F.col(c).asc_nulls_first() for c in rest)))
    near = near.withColumn("_place", place).filter(F.col("_place") > skip)
    near = near if limit is None else near.filter(F.col("_place") <= skip + limit)
    return near.drop("_place", "_n", "_before")


def limit_subruns(events: DataFrame, n: int) -> DataFrame:
    """The events of the first ``n`` sub-runs."""
    first = events.select(RUN, SUBRUN).distinct().orderBy(RUN, SUBRUN).limit(n)
    return events.join(first, [RUN, SUBRUN], "left_semi")


def levels(events: DataFrame, mode: Mode) -> DataFrame:
    """What a processing mode visits: runs, sub-runs or events."""
    return events.select(RUN).distinct() if mode is Mode.RUNS else events.select(RUN, SUBRUN).distinct() if mode is Mode.RUNS_AND_SUBRUNS else events.select(*KEY)


class Duplicates(Enum):
    # The modes' names in configurations.
    KEEP = "noDuplicateCheck"
    EACH_FILE = "checkEachFile"
    EACH_REAL_FILE = "checkEachRealDataFile"
    ALL_FILES = "checkAllFilesOpened"


def drop_duplicates(events: DataFrame, mode: Duplicates, order: tuple[str, ...], file: str = "file_no", real: Column | None = None, file_order: tuple[str, ...] = ()) -> DataFrame:
    """The first row of every ID within its file or over all files, in reading order.

    In ``EACH_REAL_FILE`` a file's first entry by ``file_order`` tells whether the file is real data;
    files of simulated data pass unchecked.
    """
    if mode is Duplicates.KEEP:
        return events
    if mode is Duplicates.EACH_REAL_FILE:
        kind = events.groupBy(file).agg(F.min_by(real, F.struct(*file_order)).alias("_real"))
        marked = events.join(small(kind), file)
        checked = drop_duplicates(marked.filter("_real").drop("_real"), Duplicates.EACH_FILE, order, file)
        return checked.unionByName(marked.filter("NOT _real").drop("_real"))
    keys = [*KEY, file] if mode is Duplicates.EACH_FILE else list(KEY)
    reading = order if mode is Duplicates.EACH_FILE else (file, *order)
    # A minimum, unlike a rank, is combined before the shuffle.
    rest = [c for c in events.columns if c not in keys and c not in reading]
    lead = [c for c in reading if c not in keys]
    return events.groupBy(*keys).agg(F.min(F.struct(*lead, *rest)).alias("_row")).select(*keys, "_row.*").select(events.columns)


def last_in_subrun(events: DataFrame) -> DataFrame:
    """Flag each event that no other of its sub-run follows."""
    last = events.groupBy(RUN, SUBRUN).agg(F.max(EVENT).alias("_last"))
    return events.join(last, [RUN, SUBRUN]).withColumn("is_last_in_subrun", F.col(EVENT) == F.col("_last")).drop("_last")


def unsorted_order(events: DataFrame, first: EventID | None = None) -> DataFrame:
    """Reading order without event sorting: by run and sub-run, then as stored; a start event would be meaningless and is an error."""
    if first is not None:
        raise ValueError("a first event needs events in order")
    return with_ordinal(events, ("entry",), name="position")


def seek_exact(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted ID its entry, null where no file has it; the first file wins."""
    found = events.join(small(wanted), list(KEY), "left_semi").groupBy(*KEY).agg(F.min(F.struct("file_no", "entry")).alias("_at"))
    return wanted.join(found, list(KEY), "left").select(*wanted.columns, F.col("_at.file_no").alias("file_no"), F.col("_at.entry").alias("entry"))


def seek_next(events: DataFrame, wanted: list[EventID]) -> DataFrame:
    """For each wanted ID the first event at or after it; nulls beyond the end.  One pass, whatever the number wanted."""
    least = [F.min(F.when(id_struct() >= w.struct(), id_struct())).alias(f"_{i}") for i, w in enumerate(wanted)]
    one = events.agg(*least)
    rows = F.array(*(F.struct(F.lit(w.run).alias("w_run"), F.lit(w.subrun).alias("w_subrun"), F.lit(w.event).cast("bigint").alias("w_event"), F.col(f"_{i}").alias("found")) for i, w in enumerate(wanted)))
    return one.select(F.explode(rows).alias("_r")).select("_r.w_run", "_r.w_subrun", "_r.w_event", F.col("_r.found.run").cast("int").alias(RUN), F.col("_r.found.subrun").cast("int").alias(SUBRUN), F.col("_r.found.event").alias(EVENT))


def seek_container(events: DataFrame, wanted: DataFrame, file: str = "file_no") -> DataFrame:
    """For each wanted run, or sub-run if ``subrun`` is not null, the first file with it and its first event there; null where no file has it."""
    first = F.min(F.struct(file, SUBRUN, EVENT))
    runs = events.join(small(wanted.select(RUN).distinct()), RUN, "left_semi").groupBy(RUN, SUBRUN).agg(first.alias("_at"))
    per_run = runs.groupBy(RUN).agg(F.min("_at").alias("_at")).withColumn(SUBRUN, F.lit(None).cast("int"))
    found = runs.select(RUN, SUBRUN, "_at").unionByName(per_run.select(RUN, SUBRUN, "_at"))
    at = found.select(F.col(RUN).alias("_r"), F.col(SUBRUN).alias("_s"), "_at")
    out = wanted.join(at, (F.col(RUN) == F.col("_r")) & F.col(SUBRUN).eqNullSafe(F.col("_s")), "left")
    return out.select(RUN, SUBRUN, F.col(f"_at.{file}").alias(file), F.col(f"_at.{EVENT}").alias("first_event"))


def seek_offset(events: DataFrame, offset: int) -> DataFrame:
    """Each event with the one ``offset`` places on (back if negative) in reading order, null beyond either end.

    Most are found in the same sub-run; only the ``offset`` events next to a border are looked up by number.
    """
    chunk = [RUN, SUBRUN]
    inside = Window.partitionBy(*chunk).orderBy(EVENT)
    far = F.lead(F.struct(*KEY), offset) if offset >= 0 else F.lag(F.struct(*KEY), -offset)
    ranked = events.select(*KEY).withColumns({"_rank": F.row_number().over(inside), "_to": far.over(inside)})
    numbered = _by_chunk(ranked, _chunks(events, (), (RUN, SUBRUN)), chunk).withColumn("_place", F.col("_before") + F.col("_rank"))
    # What another sub-run's event leads to lies as near to the border on the other side.
    near = F.col("_rank") <= offset if offset >= 0 else F.col("_n") - F.col("_rank") < -offset
    landing = numbered.filter(near).select((F.col("_place") - offset).alias("_place"), F.struct(*KEY).alias("_land"))
    found = numbered.filter("_to IS NULL").select(*KEY, "_place").join(landing, "_place", "left").select(*KEY, F.col("_land").alias("_to"))
    out = numbered.filter("_to IS NOT NULL").select(*KEY, "_to").unionByName(found)
    return out.select(*KEY, *(F.col(f"_to.{c}").alias(f"to_{c}") for c in KEY))
