"""Which products a job reads and writes: wildcard rules, lineage, lookups by type and tag."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut, sized

PARTS = ("type", "label", "instance", "process")


@dataclass(frozen=True)
class Rule:
    """``keep`` or ``drop`` products whose name ``type_label_instance_process`` fits wildcards."""

    keep: bool
    pattern: str

    @staticmethod
    def parse(text: str) -> Rule:
        """``keep PATTERN`` or ``drop PATTERN``; a lone ``*`` fits everything."""
        verb, _, pattern = text.strip().partition(" ")
        pattern = pattern.strip()
        if verb not in ("keep", "drop") or not pattern:
            raise ValueError(f"not a keep or drop rule: {text!r}")
        if pattern != "*" and pattern.count("_") != 3:
            raise ValueError(f"a pattern has the four parts type_label_instance_process: {pattern!r}")
        return Rule(verb == "keep", pattern)

    def fits(self, name: str) -> bool:
        return fnmatch.fnmatchcase(name, self.pattern)


def selected(names: Iterable[str], rules: Iterable[str]) -> list[str]:
    """The names that the last fitting rule keeps; what no rule fits is dropped."""
    parsed = [Rule.parse(r) for r in rules]
    return [n for n in names if next((r.keep for r in reversed(parsed) if r.fits(n)), False)]


def select_products(df: DataFrame, keys: tuple[str, ...], products: dict[str, str], rules: list[str]) -> DataFrame:
    """Key columns and the columns of selected products; ``products`` maps product names to columns."""
    return df.select(*keys, *(products[n] for n in selected(products, rules)))


def without_descendants(lineage: DataFrame, selected_products: DataFrame, dropped: DataFrame) -> DataFrame:
    """Selected products of which no ancestor is dropped; those that go for that reason are flagged.

    The closure runs level by level in the data and ends when nothing new is reached, at any depth.
    """
    reached = front = cut(dropped.select("product").distinct())
    n = total = front.count()
    while n > 0:
        children = lineage.join(sized(front.withColumnRenamed("product", "parent"), n), "parent").select(F.col("child").alias("product")).distinct()
        front = cut(children.join(sized(reached, total), "product", "left_anti"))
        n = front.count()
        if n > 0:
            reached, total = cut(reached.unionByName(front)), total + n
    return selected_products.join(sized(reached.withColumn("_lost", F.lit(True)), total), "product", "left").select("product", F.coalesce("_lost", F.lit(False)).alias("dropped_with_ancestor"))


def find_product(catalog: DataFrame, type_: str, label: str, instance: str = "", process: str | None = None) -> DataFrame:
    """The newest product of a type and tag; without a process any will do."""
    pattern = f"^{re.escape(type_)}_{re.escape(label)}_{re.escape(instance)}_{re.escape(process) if process else '.*'}\\.$"
    name = F.concat_ws("_", *(F.col(p) for p in PARTS))
    return catalog.filter(F.concat(name, F.lit(".")).rlike(pattern)).orderBy(F.col("position").desc()).limit(1)


def registry(products: DataFrame, stored: DataFrame) -> DataFrame:
    """Registered products with whether the file has them; registered but absent ones are dropped."""
    return products.join(stored.select("product").distinct().withColumn("_in", F.lit(True)), "product", "left").select("product", "branch_type", F.coalesce("_in", F.lit(False)).alias("present"), F.coalesce(~F.col("_in"), F.lit(True)).alias("dropped"))


def select_for_output(products: DataFrame, rules: list[str]) -> DataFrame:
    """Products that rules keep, but for transient ones and results that were not produced here."""
    name = F.concat_ws("_", *(F.coalesce(F.col(p), F.lit("")) for p in PARTS))
    kept = F.lit(False)
    for rule in map(Rule.parse, rules):
        pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in rule.pattern)
        kept = F.when(name.rlike(f"(?s)^{pattern}$"), rule.keep).otherwise(kept)
    persistent = ~F.coalesce("transient", F.lit(False)) & ((F.col("branch_type") != "InResults") | F.col("produced"))
    return products.filter(kept & persistent)


def fill_begin_time(containers: DataFrame, events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A run or sub-run without a begin time takes that of the next event in order: its own first, else the first of what follows.

    The search runs over one row per sub-run, inside runs, and over one row per run.
    """
    first = F.min_by("ts", F.struct("run", "subrun", "event"))
    if keys == ("run",):
        near = containers.select("run").distinct().join(events.groupBy("run").agg(first.alias("_ts")), "run", "full")
    else:
        rows = containers.select("run", "subrun").distinct().join(events.groupBy("run", "subrun").agg(first.alias("_ts")), ["run", "subrun"], "full")
        ahead = Window.partitionBy("run").orderBy("subrun").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        near = rows.withColumn("_ts", F.first("_ts", True).over(ahead))
    whole = near.groupBy("run").agg(F.min_by("_ts", F.struct(*keys)).alias("_ts"))
    later = Window.partitionBy(F.lit(0)).orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    whole = whole.select("run", F.first("_ts", True).over(later).alias("_later"))
    out = containers.join(near, list(keys), "left").join(whole, "run", "left")
    return out.withColumn("begin_ts", F.coalesce("begin_ts", "_ts", "_later")).drop("_ts", "_later")
