"""Near-duplicate detection with HyperMinHash registers (operator 5).

One hash per shingle picks a register by its top bits; the register keeps the smallest rest as a
leading-zero count and mantissa bits.  Empty registers borrow from filled ones in an order fixed by
their number, so short documents band like long ones.  Documents are collapsed to distinct sets
first; bands of registers propose links and whole sets decide.  An estimate of the similarity,
corrected for the collisions expected of sets of these sizes, spares large sets that are far apart
the comparison; where it could err with a probability above 1e-12 it is not asked.

Every bucket is settled completely without expanding it to pairs: its members are held against one
pivot, what that links becomes one component, and only buckets still holding several components are
examined further.  Small ones are compared pair by pair; of large ones, what lies outside the most
common component is compared, in blocks, with everything, intersections coming from one matrix
product.  Of a block only links that join components leave the task.

Defined results: a null or wordless text has no shingles and is linked with nothing; fewer words
than ``k`` make one shingle of the whole sequence; texts of equal sets are linked; rows repeating a
``doc_id`` share its node whatever their texts are, and each gets its own result row; a null
``doc_id`` is in no component and kept; a text is read whole, however long; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .components import connected_components
from .shared import cut, small, table, text_key

U64 = np.uint64


@dataclass(frozen=True)
class Registers:
    """Sketch shape: 2**index_bits registers of a leading-zero count and ``mantissa_bits``, in bands of ``rows``."""

    index_bits: int = 8
    mantissa_bits: int = 10
    rows: int = 4

    @property
    def count(self) -> int:
        return 1 << self.index_bits

    @property
    def bands(self) -> int:
        return self.count // self.rows


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union of the k-word shingles."""

    k: int = 5
    percent: int = 75
    #: Sets of fewer shingles leave registers empty, and are compared whatever the estimate says.
    estimate_from: int = 2048
    #: Estimates err by so much only with a probability below this.
    error: float = 1e-12
    #: Buckets of more members are compared in blocks of ``block`` documents.
    pair_limit: int = 32
    block: int = 512


def _borrow_order(n: int) -> np.ndarray:
    return np.argsort(np.random.default_rng(n).random((n, n)), axis=1)


def registers(s: np.ndarray, shape: Registers, order: np.ndarray) -> np.ndarray:
    """Registers of one sorted, non-empty shingle set, as 16-bit codes."""
    shift = U64(64 - shape.index_bits)
    index = np.arange(shape.count, dtype=np.uint64)
    at = np.searchsorted(s, index << shift)
    least = s[np.minimum(at, len(s) - 1)]
    filled = (at < len(s)) & ((least >> shift) == index)
    rest = (least << U64(shape.index_bits)) | U64(1)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    mantissa = ((fraction - 0.5) * (2 << shape.mantissa_bits)).astype(np.uint16)
    zeros = np.minimum(64 - exponent, (1 << (16 - shape.mantissa_bits)) - 1)
    out = (np.maximum(zeros, 0).astype(np.uint16) << shape.mantissa_bits) | np.minimum(mantissa, (1 << shape.mantissa_bits) - 1)
    if not filled.all():
        hole = np.flatnonzero(~filled)
        wanted = order[hole]
        out[hole] = out[wanted[np.arange(len(hole)), filled[wanted].argmax(axis=1)]]
    return out.astype(np.uint16)


def band_keys(regs: np.ndarray, shape: Registers) -> np.ndarray:
    """One 64-bit key for each band of each row of ``regs``."""
    used = regs[:, : shape.bands * shape.rows].reshape(len(regs), shape.bands, shape.rows).astype(np.uint64)
    total = np.arange(shape.bands, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(1)
    for j in range(shape.rows):
        total = hashing.mix64(total + (used[:, :, j] + U64(1)) * hashing._PLACE[j])
    return total.view(np.int64)


@lru_cache(maxsize=1 << 14)
def _chance(a: int, b: int, shape: Registers) -> float:
    """Probability that filled registers of unrelated sets are equal; sizes in quarters of a doubling."""
    n, m = 2 ** (a / 4), 2 ** (b / 4)
    levels = 1 << shape.mantissa_bits
    octave = np.arange((1 << (16 - shape.mantissa_bits)) - 1)
    # Code c of an octave holds the minima of a register between these shares of its range.
    edge = 2.0 ** -(octave[:, None] + 1) * (1 + np.arange(levels + 1) / levels)

    def mass(size: float) -> np.ndarray:
        below = -np.expm1(size * np.log1p(-edge / shape.count))
        return np.diff(below, axis=1) / -np.expm1(size * np.log1p(-1 / shape.count))

    return float((mass(n) * mass(m)).sum())


def chance(n: int, m: int, shape: Registers) -> float:
    """How often registers of two disjoint sets of ``n`` and ``m`` shingles collide."""
    return _chance(round(4 * math.log2(n)), round(4 * math.log2(m)), shape)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int, shape: Registers) -> float:
    """Share of equal registers, less what unequal minima of sets of these sizes agree by chance."""
    c = chance(n, m, shape)
    return max(0.0, (float(np.mean(a == b)) - c) / (1 - c))


@lru_cache(maxsize=16)
def sure_below(rule: Rule, shape: Registers) -> float:
    """The greatest estimate that a linked pair falls below with a probability of at most ``rule.error`` (Chernoff)."""
    share = rule.percent / 100
    if not 0 < share < 1:
        return -1.0
    lo, hi = 0.0, share
    for _ in range(60):
        x = (lo + hi) / 2
        gap = (x * math.log(x / share) if x else 0.0) + (1 - x) * math.log((1 - x) / (1 - share))
        lo, hi = (x, hi) if shape.count * gap >= -math.log(rule.error) else (lo, x)
    return lo - 2 / shape.count


def _fingerprint(s: np.ndarray) -> bytes:
    mixed = hashing.mix64(s ^ U64(0x5851F42D4C957F2D))
    return np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed), len(s)], np.uint64).tobytes()


def _sketch(k: int, shape: Registers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _borrow_order(shape.count)
        for batch in batches:
            data, at = hashing.strings(batch.column(1))
            ids = batch.column(0)
            for i, j in hashing.slices(at, 8 << 20):
                sizes, prints, found, where = [], [], [], []
                row = i
                for x, y in hashing.slices(at[i : j + 1]):
                    for s in hashing.shingle_sets(data, at[i + x : i + y + 1], k):
                        sizes.append(len(s))
                        prints.append(_fingerprint(s) if len(s) else None)
                        if len(s):
                            found.append(registers(s, shape, order))
                            where.append(row - i)
                        row += 1
                keys: list = [None] * (j - i)
                if found:
                    for place, value in zip(where, band_keys(np.array(found), shape), strict=True):
                        keys[place] = value
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "print", "keys"])

    return run


def _payload(k: int, shape: Registers):
    """Registers and whole set of each document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _borrow_order(shape.count)
        for batch in batches:
            data, at = hashing.strings(batch.column(1))
            for i, j in hashing.slices(at):
                sets = list(hashing.shingle_sets(data, at[i : j + 1], k))
                # A doc_id may also carry a text without words.
                held = [x for x in range(j - i) if len(sets[x])]
                regs = [registers(sets[x], shape, order).tobytes() for x in held]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(held, pa.int64())), pa.array(regs, pa.binary()), pa.array([sets[x].tobytes() for x in held], pa.binary())], ["id", "regs", "shingles"])

    return run


def linked(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, rule: Rule, shape: Registers) -> bool:
    """Whether two sorted sets link: by their sizes, by the estimate where it is sure, and by themselves."""
    small_, large = sorted((len(x), len(y)))
    if 100 * small_ < rule.percent * large:
        return False
    if small_ >= rule.estimate_from and estimate(rx, ry, len(x), len(y), shape) < sure_below(rule, shape):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = int((x[at] == y).sum())
    return 100 * common >= rule.percent * (len(x) + len(y) - common)


def _verify(rule: Rule, shape: Registers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, sa, rb, sb = (batch.column(i) for i in (2, 3, 4, 5))
            sets = lambda c, i: np.frombuffer(c[i].as_buffer(), np.uint64)
            codes = lambda c, i: np.frombuffer(c[i].as_buffer(), np.uint16)
            keep = [i for i in range(batch.num_rows) if linked(sets(sa, i), sets(sb, i), codes(ra, i), codes(rb, i), rule, shape)]
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])

    return run


def linked_in_block(ids: np.ndarray, comps: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components that documents of sides 0 and 1, or of side 0 alone, link: a forest of all links.

    Intersections are exact: products of 0/1 incidence columns of the shingles that several documents have.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    pick = shared[column]
    owner, column = owner[pick], number[column[pick]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    common = np.zeros((len(left), len(right)), np.float64)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        x, y = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[x:y], column[x:y] - lo] = 1
        common += part[left] @ part[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    good = (100 * common >= percent * union) & (comps[left][:, None] != comps[right][None, :])
    i, j = np.nonzero(good)
    one, two = comps[left[i]], comps[right[j]]
    _, first = np.unique(np.stack((np.minimum(one, two), np.maximum(one, two)), axis=1), axis=0, return_index=True)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    out = []
    for k in sorted(first.tolist()):
        a, b = find(int(one[k])), find(int(two[k]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[left[i[k]]]), int(ids[right[j[k]]])))
    return out


def _block_links(rule: Rule):
    def run(table_: pa.Table) -> pa.Table:
        seen = table_.column("side").to_numpy()
        found = linked_in_block(table_.column("id").to_numpy(), table_.column("comp").to_numpy(), seen, [np.frombuffer(x.as_buffer(), np.uint64) for x in table_.column("shingles")], rule.percent)
        links = sorted({(min(p), max(p)) for p in found})
        return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), shape: Registers = Registers()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, text_key``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = texts.select("doc_id", "text", text_key().alias("text_key"))
    sketches = cut(sketches.mapInArrow(_sketch(rule.k, shape), "doc_id long, text_key string, n_shingles long, print binary, keys array<long>"), "sketches")
    known = sketches.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    reps = known.groupBy("print").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"))
    reps = cut(reps, "reps")
    placed = cut(known.select("doc_id", "text_key", "n_shingles", "print").join(reps.select("print", "rep"), "print").drop("print"), "placed")
    # A doc_id with several texts is one node.
    shared = placed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("doc_id", "low")
    same = placed.join(shared, "doc_id").filter("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()

    # Minima and maxima shrink before the shuffle, so a key that many documents have costs no task more than others.
    rows = reps.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).filter("pivot < top").select("key", "pivot")
    members = cut(rows.join(buckets, "key").select("key", "id", "pivot"), "members")

    # The payload of a node is every text that has its doc_id, each once.
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    payload = texts.join(small(wanted), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    payload = cut(payload.mapInArrow(_payload(rule.k, shape), "id long, regs binary, shingles binary"), "payload")

    stars = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    first = cut(_verified(stars, payload, rule, shape).unionByName(same), "links")
    labels = connected_components(first)

    of_node = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    parts = of_node.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("most")).filter("comps > 1").select("key", "size", "most.comp", "most.n")
    sizes = sizes.select("key", "size", F.col("comp").alias("main"), F.col("n").alias("in_main"))
    mixed = cut(of_node.join(sizes, "key").select("key", "id", "comp", "size", "main", "in_main"), "mixed")

    few = mixed.filter(F.col("size") <= rule.pair_limit)
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.id < y.id AND x.comp <> y.comp")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    second = _verified(pairs.join(stars, ["a", "b"], "left_anti"), payload, rule, shape)
    third = _blocks(mixed.filter(F.col("size") > rule.pair_limit), payload, rule)
    labels = connected_components(first.unionByName(cut(second.unionByName(third), "links")))

    out = placed.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    columns = ["doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "text_key"]
    rest = sketches.filter(F.col("print").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    out = out.select(*columns).unionByName(rest)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")


def _verified(pairs: DataFrame, payload: DataFrame, rule: Rule, shape: Registers) -> DataFrame:
    left = payload.select(F.col("id").alias("a"), F.col("regs").alias("ra"), F.col("shingles").alias("sa"))
    right = payload.select(F.col("id").alias("b"), F.col("regs").alias("rb"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ra", "sa", "rb", "sb")
    return both.mapInArrow(_verify(rule, shape), "a long, b long")


def _blocks(mixed: DataFrame, payload: DataFrame, rule: Rule) -> DataFrame:
    """Links inside large buckets, blocks by a hash of the id, each pair of blocks one unit of work.

    Blocks ``0 .. few - 1`` hold what is outside the bucket's most common component, the others that component,
    whose blocks are not compared with each other: it is linked already.
    """
    some = lambda n: F.ceil(n / rule.block).cast("int")
    others, main = some(F.col("size") - F.col("in_main")), some(F.col("in_main"))
    mine = F.col("comp") == F.col("main")
    block = F.when(mine, others + F.pmod(F.xxhash64("id"), main)).otherwise(F.pmod(F.xxhash64("id"), others)).cast("int")
    units = mixed.select("key", "id", "comp", block.alias("block"), F.explode(F.sequence(F.lit(0), F.when(mine, others).otherwise(others + main) - 1)).alias("other"))
    units = units.select("key", "id", "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
    return units.join(payload.select("id", "shingles"), "id").groupBy("key", "lo", "hi").applyInArrow(_block_links(rule), "a long, b long")


def op5_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
