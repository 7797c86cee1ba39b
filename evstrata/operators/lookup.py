"""Looking values up elsewhere: fallback data sets, rows by position, the hierarchy above an event."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten_secondaries(tree: dict[str, list], primary: str) -> list[str]:
    """Secondary files of a primary in the order they are asked: each is followed by its own secondaries.

    The first list given for a name counts, and a cycle ends where it would repeat.
    """
    out: list[str] = []

    def walk(name: str, above: tuple[str, ...]) -> None:
        for s in tree.get(name, []):
            if s not in above:
                out.append(s)
                walk(s, (*above, s))

    walk(primary, (primary,))
    return out


def coalesce_lookup(primary: DataFrame, secondaries: list[DataFrame], keys: tuple[str, ...], column: str, default: Column | None = None) -> DataFrame:
    """The column from the primary, else from the first secondary that has the key and a value, else the default."""
    out = primary
    names = []
    for i, s in enumerate(secondaries):
        # One row per key: a secondary is not checked for duplicates, its first row by value counts.
        one = s.groupBy(*keys).agg(F.min(column).alias(f"_s{i}"))
        out = out.join(one, list(keys), "left")
        names.append(F.col(f"_s{i}"))
    first = [F.col(column)] if column in primary.columns else []
    return out.withColumn(column, F.coalesce(*first, *names, *([default] if default is not None else []))).drop(*(f"_s{i}" for i in range(len(secondaries))))


def read_positions(rows: DataFrame, positions: DataFrame, entry: str = "entry") -> DataFrame:
    """Rows by entry number in the order of the list ``(pos, entry)``; an entry named twice is given twice."""
    return positions.join(rows, entry)


def resolve_products(available: dict[str, str], wanted: list[str]) -> dict[str, str]:
    """For each wanted name ``type_label_instance_process``, the parts of which may hold wildcards, the column of the newest fitting product."""
    out = {}
    for name in wanted:
        fits = [p for p in available if fnmatch.fnmatchcase(p, name)]
        if not fits:
            raise LookupError(f"no product {name} in the secondary input")
        out[name] = available[fits[-1]]
    return out


def mixed(rows: DataFrame, positions: DataFrame, available: dict[str, str], wanted: list[str], auxiliary: tuple[str, ...] = ("run", "subrun", "event", "ts")) -> DataFrame:
    """What mixing reads: for each position the auxiliary of its entry and the wanted products."""
    columns = resolve_products(available, wanted)
    return read_positions(rows, positions).select("pos", "entry", *auxiliary, *dict.fromkeys(columns.values()))


def without_children(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Containers that hold nothing."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def neighbour_files(files: DataFrame, file: str = "file_no") -> DataFrame:
    """Each file with the one before and the one after it in catalog order, null at the ends.

    Files are few beside rows: one ordered task of file numbers.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(file)
    return files.select(file).distinct().select(file, F.lag(file).over(order).alias("previous_file"), F.lead(file).over(order).alias("next_file"))


def pairs_from_other_side(pairs: DataFrame, left: str, right: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A collection of pairs as the partner sees it: both directions come from one table."""
    return pairs.select(*by, F.col(right).alias(left), F.col(left).alias(right))
