"""Best-fit packing of token pieces into fixed-length sequences (operator 8).

Only how many pieces have each length matters, so the bins are planned on the driver from at most
``capacity`` counts: Martello-Toth dominance fixes bins that some best packing must have, and
best-fit-decreasing places the rest, whole runs of equal bins at a time.  Pieces are ranked within
their length by salted counts and looked up in the plan.

Defined results: a null or empty text is one piece of the separator alone; repeated rows, and rows
without an id, are packed each; a text is tokenised whole, however long, and only texts beyond the
capacity are cut; an empty table gives an empty result; extra columns are ignored; equal lengths are
told apart by any fixed order.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table
from .tokens import WordTokenizer, tokenizer_path

SEPARATOR_ID = 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_pieces(path: str, capacity: int):
    separator = np.array([SEPARATOR_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer.cached(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode.ids(part.column(1).to_pylist()), strict=True):
                    data = memoryview(ids + separator)
                    n = len(data) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        stop = min(n, start + capacity)
                        rows.append((doc, k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Sizes:
    """Lengths in hand with their counts; finds the longest one that still fits."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = dict(counts)
        self.order = sorted(counts)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect.bisect_left(self.order, size))

    def put(self, size: int, k: int) -> None:
        if size not in self.n:
            self.n[size] = 0
            bisect.insort(self.order, size)
        self.n[size] += k

    def fitting(self, room: int) -> int | None:
        i = bisect.bisect_right(self.order, room)
        return self.order[i - 1] if i else None


def _longest_pair(left: _Sizes, room: int) -> int:
    """The greatest sum up to ``room`` of two pieces in hand; 0 if no two fit."""
    order, best = left.order, 0
    i, j = 0, len(order) - 1
    while i <= j:
        if i == j and left.n[order[i]] < 2:
            break
        total = order[i] + order[j]
        if total > room:
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def _dominating(left: _Sizes, room: int) -> tuple[int, ...] | None:
    """The pieces that some best packing puts beside one that leaves ``room``, if dominance tells; () for none."""
    one = left.fitting(room)
    if one is None:
        return ()
    if one == room:
        return (one,)
    shortest = [s for s in left.order[:3] for _ in range(min(3, left.n[s]))][:3]
    if len(shortest) < 2 or shortest[0] + shortest[1] > room:
        return (one,)
    if len(shortest) == 3 and sum(shortest) <= room:
        return None
    if _longest_pair(left, room) <= one:
        return (one,)
    left.take(one, 1)
    two = left.fitting(room - one)
    left.put(one, 1)
    if two is None:
        return None
    above = bisect.bisect_right(left.order, two)
    longer = [s for s in left.order[above : above + 2] for _ in range(min(2, left.n[s]))][:2]
    return (one, two) if len(longer) < 2 or sum(longer) > room else None


def reduce_dominated(left: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins that some best packing has, by dominance; their pieces leave ``left``.

    From the longest piece down, the pieces beside it are fixed if every other choice could be
    exchanged for them: nothing fits; one fills the bin; no two fit and it is the longest; no three
    fit and it is as long as any two; no three fit and the longest with the longest beside it
    dominates every other two.
    """
    fixed = []
    for size in sorted(left.n, reverse=True):
        while left.n.get(size):
            left.take(size, 1)
            beside = _dominating(left, capacity - size)
            left.put(size, 1)
            if beside is None:
                break
            used = Counter((size, *beside))
            # As often as nothing that the decision looked at runs out.
            times = max(1, min((left.n[s] - 3) // k for s, k in used.items())) if beside else left.n[size]
            if len(beside) == 1 and beside[0] == capacity - size:
                times = min(left.n[s] // k for s, k in used.items())
            fixed.append(((size, *beside), times))
            for s, k in used.items():
                left.take(s, k * times)
    return fixed


def best_fit(left: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each piece goes to the fullest open bin with room; equal bins are held as one counted group."""
    groups: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, kinds: tuple[int, ...], times: int) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append([kinds, times])

    for size in sorted(left.n, reverse=True):
        n = left.n[size]
        while n:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                put(capacity - each * size, (size,) * each, n // each)
                put(capacity - n % each * size, (size,) * (n % each), 1 if n % each else 0)
                break
            room = rooms[i]
            kinds, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            each = room // size
            full = min(times, n // each)
            put(room - each * size, kinds + (size,) * each, full)
            n -= each * full
            times -= full
            if times and n:
                put(room - n * size, kinds + (size,) * n, 1)
                times, n = times - 1, 0
            put(room, kinds, times)
    return [(kinds, times) for held in groups.values() for kinds, times in held]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, how often)`` for every kind of bin."""
    left = _Sizes({s: n for s, n in counts.items() if n})
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first bin, offset) of its runs of places, by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for kinds, times in plan:
        at = 0
        for size in kinds:
            out.setdefault(size, []).append((ranks.get(size, 0), first, at))
            ranks[size] = ranks.get(size, 0) + times
            at += size
        first += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                mine = length == size
                rows = where[size]
                i = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
                sequence[mine] = rows[i, 1] + rank[mine] - rows[i, 0]
                offset[mine] = rows[i, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return place_pieces(texts.mapInArrow(_cut_pieces(vocabulary or tokenizer_path(), capacity), PIECE_SCHEMA), capacity)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    spark = pieces.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cut(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")), "pieces")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = cut(counts.select("length", "salt", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")), "before")
    plan = plan_bins({r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    slots = spark.sparkContext.broadcast(_slots(plan))
    # Rows equal in all these columns are interchangeable, so a rerun may rank them either way.
    local = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(local) - 1).join(before.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(_place(slots), PIECE_SCHEMA + ", sequence_id long, offset long")


def op8_martello_toth_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
