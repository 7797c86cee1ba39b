"""Which provenance a file keeps, ancestors of products, and listings of process histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut, sized, small

NONE, PRIOR, ALL = "NONE", "PRIOR", "ALL"


def retained(products: DataFrame, provenance: DataFrame, drop: str = NONE) -> DataFrame:
    """Per entry and kept product the status and parents that are stored.

    Provenance is kept if nothing is dropped, or for products of this process if only prior ones are.
    A kept product without provenance was never created if made here, else it is dropped.  An
    uninitialised status is an error.
    """
    keep = F.lit(drop == NONE) | (F.col("produced") & F.lit(drop == PRIOR))
    missing = F.when(F.col("produced"), "neverCreated").otherwise("dropped")
    joined = products.join(provenance, ["entry", "product_id"], "left")
    status = F.when(F.col("status") == "uninitialized", F.raise_error(F.lit("uninitialized provenance"))).otherwise(F.coalesce("status", missing))
    return joined.filter(keep).select("entry", "product_id", status.alias("status"), F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents"))


def kept_provenance(selected: DataFrame, descriptions: DataFrame, provenance: DataFrame, drop: str = NONE, drop_for_dropped: bool = False) -> tuple[DataFrame, DataFrame]:
    """What provenance an output file keeps, ancestors included, and whose descriptions.

    ``selected`` has the output's products by ``entry, product_id``, ``descriptions`` whether each known product was
    ``produced`` here, ``provenance`` the stored ``entry, product_id, status, parents``.  Provenance of a selected
    product is kept as in ``retained``.  Unless metadata of dropped products is dropped, too, the descriptions of
    its parents are kept, and if no metadata is dropped at all also the provenance of parents made here, from
    which the walk goes on.  The first result is ``entry, product_id, status, parents``, the second ``product_id``.
    """
    known = descriptions.select("product_id", "produced")
    chosen = selected.select("entry", "product_id").distinct().join(known, "product_id")
    kept = retained(chosen, provenance, drop)
    described = selected.select("product_id").distinct()
    keeps = drop == NONE or drop == PRIOR
    if not keeps or drop_for_dropped:
        return kept, described
    here = chosen if drop == NONE else chosen.filter("produced")
    front = cut(provenance.join(small(here.select("entry", "product_id")), ["entry", "product_id"]).select("entry", "product_id", "status", "parents"))
    reached = chosen.select("entry", "product_id")
    more = None
    while True:
        parents = front.select("entry", F.explode("parents").alias("product_id")).distinct().join(known, "product_id")
        described = described.unionByName(parents.select("product_id").distinct())
        if drop != NONE:
            break
        step = cut(parents.filter("produced").select("entry", "product_id").join(small(reached), ["entry", "product_id"], "left_anti"))
        front = cut(provenance.join(small(step), ["entry", "product_id"]).select("entry", "product_id", "status", "parents"))
        if front.isEmpty():
            break
        more = front if more is None else more.unionByName(front)
        reached = cut(reached.unionByName(front.select("entry", "product_id")))
    return (kept if more is None else kept.unionByName(more)), described.distinct()


def ancestors(parentage: DataFrame, start: DataFrame) -> DataFrame:
    """``product_id, ancestor_id``: all ancestors of each product in ``start``.

    The walk stops at products that were not made in this process, which are still named.
    """
    edges = parentage.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), F.col("child_produced").alias("_made"))
    front = start.select("product_id", F.col("product_id").alias("at"))
    # Each side is broadcast or not by the rows of its round, which are counted from what was cut.
    joined, found, total = small(front), None, 0
    while True:
        step = joined.join(edges.filter("_made"), F.col("at") == F.col("_c")).select("product_id", F.col("_p").alias("at")).distinct()
        step = cut(step if found is None else step.join(sized(found, total), ["product_id", "at"], "left_anti"))
        n = step.count()
        if n == 0:
            break
        found = step if found is None else cut(found.unionByName(step))
        joined, total = sized(step, n), total + n
    if found is None:
        found = front.limit(0)
    return found.select("product_id", F.col("at").alias("ancestor_id"))


def histories(history: DataFrame) -> DataFrame:
    """Each process history with its letter and its processes in order."""
    from .scan import with_ordinal

    lists = history.groupBy("history_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "process"))), lambda x: x["process"]), " -> ").alias("processes"), F.count("*").alias("n_processes"))
    return with_ordinal(lists, (), chunk=("history_id",), name="n").select("history_id", letters(F.col("n")).alias("letter"), "processes", "n_processes")


def letters(n: Column) -> Column:
    """A for 1 to Z for 26, then AA, AB and so on to ZZZ."""
    digit = lambda x: F.chr(F.pmod(x - 1, F.lit(26)) + 65)
    second, third = F.floor((n - 1) / 26), F.floor((n - 27) / 676)
    return F.concat(F.when(n > 702, digit(third)).otherwise(""), F.when(n > 26, digit(second)).otherwise(""), digit(n))
