"""Weighted sampling from data sets: draws choose a set, whose next event is taken until one runs out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import EVENT, RUN, SUBRUN, EventID, id_struct
from .scan import with_ordinal

MODULUS, FACTOR = 2**31 - 1, 16807


@dataclass(frozen=True)
class DataSet:
    name: str
    weight: float
    skip_to: str = ""


def check(datasets: list[DataSet]) -> None:
    """No set, a negative weight and weights that sum to nothing are errors."""
    if not datasets:
        raise ValueError("no data set to sample from")
    if any(d.weight < 0 for d in datasets):
        raise ValueError("a weight is negative")
    if sum(d.weight for d in datasets) < 1e-300:
        raise ValueError("the weights sum to zero")


def generator_states(seed: int, steps: np.ndarray) -> np.ndarray:
    """States of the minimal standard generator after so many ``steps``, each in closed form."""
    out = np.full(len(steps), seed % MODULUS, np.int64)
    power = FACTOR
    for bit in range(int(steps.max(initial=0)).bit_length()):
        out = np.where(steps >> bit & 1, out * power % MODULUS, out)
        power = power * power % MODULUS
    return out


def choose(datasets: list[DataSet], seed: int, numbers: np.ndarray) -> np.ndarray:
    """The set of each draw by number from 1: two generator steps make a uniform number, looked up in cumulated weights."""
    check(datasets)
    used = [d for d in datasets if d.weight > 0]
    limits = np.cumsum([d.weight for d in used]) / sum(d.weight for d in used)
    span = MODULUS - 1
    a, b = generator_states(seed, 2 * numbers - 1), generator_states(seed, 2 * numbers)
    u = ((a - 1) + (b - 1) * span).astype(np.float64) / float(span * span)
    return np.array([d.name for d in used], object)[np.minimum(np.searchsorted(limits, u, "left"), len(used) - 1)]


def draws(spark: SparkSession, datasets: list[DataSet], seed: int, n: int) -> DataFrame:
    """``draw, dataset`` for ``n`` draws; tasks draw independently, for any draw can be computed alone."""
    check(datasets)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(choose(datasets, seed, numbers), pa.string())], ["draw", "dataset"])

    return spark.range(1, n + 1).withColumnRenamed("id", "draw").mapInArrow(run, "draw bigint, dataset string")


def _from_start(datasets: list[DataSet]) -> Column:
    """Events from the position on that their set starts at."""
    out = F.lit(True)
    for d in datasets:
        at = EventID.parse(d.skip_to)
        if at:
            out = out & ((F.col("dataset") != d.name) | (id_struct() >= at.struct()))
    return out


def sample(spark: SparkSession, events: DataFrame, datasets: list[DataSet], seed: int, n: int, first: EventID = EventID(1, 0, 1)) -> DataFrame:
    """Sampled events under new consecutive IDs with their old IDs, sets, weights and probabilities.

    Draws and events are joined by their ranks within each set; the sample ends before the first draw
    whose set has run out.
    """
    total = sum(d.weight for d in datasets)
    plan = draws(spark, datasets, seed, n).withColumn("_block", F.expr("draw div 100000"))
    plan = with_ordinal(plan, ("draw",), within=("dataset",), chunk=("_block",)).drop("_block")
    sets = spark.createDataFrame([(d.name, float(d.weight), d.weight / total) for d in datasets], "dataset string, weight double, probability double")
    ranked = with_ordinal(events.filter(_from_start(datasets)), (EVENT,), within=("dataset",))
    matched = plan.join(ranked.select("dataset", "ordinal", F.col(RUN).alias("old_run"), F.col(SUBRUN).alias("old_subrun"), F.col(EVENT).alias("old_event")), ["dataset", "ordinal"], "left")
    # One row: where the sample ends.
    end = matched.agg(F.coalesce(F.min(F.when(F.col("old_event").isNull(), F.col("draw"))), F.lit(n + 1)).alias("_end"))
    kept = matched.join(F.broadcast(end), F.col("draw") < F.col("_end"))
    # As many rows as data sets were configured.
    return kept.join(F.broadcast(sets), "dataset").select(
        F.lit(first.run).alias(RUN), F.lit(first.subrun).alias(SUBRUN), (F.col("draw") + first.event - 1).alias(EVENT), "dataset", "weight", "probability", "old_run", "old_subrun", "old_event",
    )


def next_events(events: DataFrame, sampled: DataFrame, datasets: list[DataSet]) -> DataFrame:
    """For each set the ID of the next event that it would have given, null if there is none."""
    sets = events.sparkSession.createDataFrame([(d.name,) for d in datasets], "dataset string")
    taken = sampled.groupBy("dataset").agg(F.count("*").alias("_taken"))
    wanted = sets.join(taken, "dataset", "left").select("dataset", (F.coalesce("_taken", F.lit(0)) + 1).alias("ordinal"))
    ranked = with_ordinal(events.filter(_from_start(datasets)), (EVENT,), within=("dataset",))
    at = ranked.select("dataset", "ordinal", F.col(RUN).alias("next_run"), F.col(SUBRUN).alias("next_subrun"), F.col(EVENT).alias("next_event"))
    return wanted.join(at, ["dataset", "ordinal"], "left").drop("ordinal")


def configuration(datasets: list[DataSet]) -> list[tuple[str, float, float, str]]:
    """Name, weight, probability and start of each set, as a job reports them."""
    check(datasets)
    total = sum(d.weight for d in datasets)
    return [(d.name, d.weight, d.weight / total, d.skip_to or "(first event)") for d in sorted(datasets, key=lambda d: d.name)]


def summary(sampled: DataFrame, spark: SparkSession, datasets: list[DataSet]) -> DataFrame:
    """Per set: draws, share of all draws, expected probability and weight."""
    total = sum(d.weight for d in datasets)
    sets = spark.createDataFrame([(d.name, float(d.weight), d.weight / total) for d in datasets], "dataset string, weight double, probability double")
    counts = sampled.groupBy("dataset").agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("_all"))
    out = sets.join(counts, "dataset", "left").join(F.broadcast(every), F.lit(True))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return out.select("dataset", "weight", "probability", n.alias("n_sampled"), (n / F.col("_all")).alias("fraction"), F.col("_all").cast("bigint").alias("n_total"))


def sampled_ids(events: DataFrame, level: tuple[str, ...]) -> DataFrame:
    """The distinct run or sub-run IDs of each set, in order."""
    return events.groupBy("dataset").agg(F.array_sort(F.collect_set(F.struct(*level))).alias("ids"))


def sampled_products(values: DataFrame, key: str) -> DataFrame:
    """For each product its values by set and ID, as sorted entries."""
    inner = values.groupBy(key, "dataset").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("entries"))
    return inner.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dataset", "entries"))).alias("sampled"))
