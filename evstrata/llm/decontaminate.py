"""Benchmark decontamination by spaced seeds (operator 6).

A seed is a hash of the words at the cared-for positions of a fixed mask, so a few substituted words
leave seeds around them intact.  Documents are scanned against a bit table of fixed size that holds
the benchmark's seeds; what passes is joined with the seeds themselves, and each (text, item,
diagonal) found is verified word by word over the whole overlap.  Equal texts are verified once, and
so are items of equal words.

An overlap counts from ``least`` matching words on, of which ``share`` of a stretch have to match; of
a shorter item all but one in every ``spare`` words.  Items too short for the masks are also sought
by their first and last halves, one of which a single substitution leaves intact.

Defined results: a null or wordless text is clean; an item without words matches nothing; repeated
items are all named, and those without an id as nothing, so that ``contaminated`` holds with no
``item_ids``; verdicts are of the text alone, so documents with null, repeated or different ids but
equal texts get equal rows each; of overlaps with equally many matches the first of the document
counts; texts and items are read whole, however long; with an empty benchmark every document is clean;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .shared import BROADCAST_ROWS, cut, small, table, text_key

U64 = np.uint64


@dataclass(frozen=True)
class SeedRule:
    """Masks, and what counts as an overlap: at least ``least`` matching words, ``share`` of a stretch."""

    masks: tuple[str, ...] = ("11101011", "110110011", "1100101101", "10101000111")
    least: int = 12
    share: float = 0.75
    #: Items shorter than ``least`` may lack one in so many words.
    spare: int = 8
    #: Bits of the table that documents are scanned against, as a power of two; it is what workers get.
    table_bits: int = 25

    @property
    def spans(self) -> int:
        return max(map(len, self.masks))

    def needed(self, n_words: int) -> int:
        """Matching words that make an overlap with an item of ``n_words``."""
        return min(self.least, n_words - n_words // self.spare)

    @property
    def short(self) -> int:
        """Items of fewer words are sought by halves, too: up to here one substitution may break every mask."""
        return max(self.spans, 2 * self.spare)


def _seeds(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, number + 1, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            total += h[j : n + j] * hashing._PLACE[j]
    return hashing.mix64(total)


def _item_masks(n_words: int, rule: SeedRule) -> list[tuple[int, str]]:
    """The masks for an item; a short one is also sought by its halves, or as a whole if no word may differ, numbered apart."""
    out = [(k, m) for k, m in enumerate(rule.masks) if len(m) <= n_words]
    return out if n_words >= rule.short else [*out, _run_mask(n_words, rule)]


def _run_mask(n_words: int, rule: SeedRule) -> tuple[int, str]:
    n = n_words // 2 if rule.needed(n_words) < n_words else n_words
    return 100 + n, "1" * n


def _item_seeds(rule: SeedRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = hashing.strings(batch.column(1))
            prints, words_of = [], []
            for i, j in hashing.slices(at):
                h, bounds = hashing.words(data, at[i : j + 1])
                for k in range(j - i):
                    w = h[bounds[k] : bounds[k + 1]]
                    words_of.append(w.tobytes())
                    prints.append([])
                    for number, mask in _item_masks(len(w), rule) if len(w) else []:
                        found = _seeds(w, mask, number).view(np.int64)
                        # Of the runs of a short item the first and the last do.
                        places = range(len(found)) if number < 100 else {0, len(found) - 1}
                        prints[-1] += [(int(found[p]), p) for p in places]
            kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.binary()), pa.array([[{"seed": s, "at": p} for s, p in x] for x in prints], kind)], ["item_id", "item_words", "seeds"])

    return run


def _scan(shared, short_lengths: list[int], rule: SeedRule):
    wanted = [*enumerate(rule.masks), *sorted({_run_mask(n, rule) for n in short_lengths})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch in batches:
            data, at = hashing.strings(batch.column(1))
            for i, j in hashing.slices(at):
                h, bounds = hashing.words(data, at[i : j + 1])
                seeds, places = [], []
                doc_of = np.searchsorted(bounds, np.arange(len(h)), "right") - 1
                for number, mask in wanted:
                    s = _seeds(h, mask, number)
                    first = np.flatnonzero(bits[(s >> U64(64 - rule.table_bits)).astype(np.int64)])
                    first = first[bits[(s[first] & U64((1 << rule.table_bits) - 1)).astype(np.int64)]]
                    first = first[doc_of[first] == doc_of[first + len(mask) - 1]]
                    seeds.append(s[first])
                    places.append(first)
                seed, place = np.concatenate(seeds).view(np.int64), np.concatenate(places)
                owner = doc_of[place] if len(place) else place
                hits: list = [None] * (j - i)
                words_of: list = [None] * (j - i)
                for k in np.unique(owner).tolist():
                    mine = owner == k
                    lo, hi = bounds[k], bounds[k + 1]
                    hits[k] = [{"seed": s, "at": p} for s, p in zip(seed[mine].tolist(), (place[mine] - lo).tolist(), strict=True)]
                    words_of[k] = h[lo:hi].tobytes()
                kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(words_of, pa.binary()), pa.array(hits, kind)], ["doc_id", "text_key", "doc_words", "hits"])

    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, rule: SeedRule) -> tuple[int, int, int]:
    """The best stretch where ``doc[i + shift]`` meets ``item[i]``: matches, first and last word of the document.

    Among stretches of which ``share`` match, the one of most matches; none is (0, 0, -1).
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return 0, 0, -1
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, -1
    # Stretches begin and end at matches i and j: (j - i + 1) >= share * (at[j] - at[i] + 1).  The greatest
    # excess from j on never rises with j, so the last j that serves an i is found by bisection.
    excess = np.arange(len(at)) - rule.share * at
    highest = np.maximum.accumulate(excess[::-1])[::-1]
    last = len(at) - 1 - np.searchsorted(highest[::-1], excess - 1 + rule.share - 1e-9)
    matches = last - np.arange(len(at)) + 1
    i = int(matches.argmax())
    return int(matches[i]), int(at[i] + lo + shift), int(at[last[i]] + lo + shift)


def _verify(rule: SeedRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            doc, item, shift = batch.column("doc_words"), batch.column("item_words"), batch.column("shift").to_pylist()
            for i in range(batch.num_rows):
                d, w = np.frombuffer(doc[i].as_buffer(), np.uint64), np.frombuffer(item[i].as_buffer(), np.uint64)
                matched, first, last = overlap(d, w, shift[i], rule)
                if matched >= rule.needed(len(w)):
                    keep.append(i)
                    found.append((matched, first, last))
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("text_key", "item")), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], ["text_key", "item", "matched", "first_word", "last_word"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, rule: SeedRule = SeedRule()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents as ``doc_id, text_key``; verified overlaps by ``text_key, item``; items as ``item, item_id``.

    ``item`` is a digest of an item's words, so that repeated items are one.
    """
    spark = docs.sparkSession
    kind = "array<struct<seed: long, at: int>>"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).mapInArrow(_item_seeds(rule), f"item_id long, item_words binary, seeds {kind}")
    items = cut(items.withColumn("item", F.md5("item_words")), "items")
    once = items.filter(F.octet_length("item_words") > 0).dropDuplicates(["item"])
    seeds = once.select("item", F.inline("seeds").alias("seed", "item_at"))
    # Bit places, not seeds, reach the driver: at most 2 ** table_bits of them.
    bits = np.zeros(1 << rule.table_bits, bool)
    top = F.shiftrightunsigned("seed", 64 - rule.table_bits).cast("int")
    low = F.col("seed").bitwiseAND((1 << rule.table_bits) - 1).cast("int")
    places = seeds.select(F.explode(F.array(top, low)).alias("place")).distinct()
    bits[places.toPandas()["place"].to_numpy(np.int64)] = True
    short = sorted(r[0] for r in once.select((F.octet_length("item_words") / 8).cast("int").alias("n")).filter(F.col("n") < rule.short).distinct().collect())
    shared = spark.sparkContext.broadcast(np.packbits(bits).tobytes())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), text_key().alias("text_key"))
    scanned = cut(texts.mapInArrow(_scan(shared, short, rule), f"doc_id long, text_key string, doc_words binary, hits {kind}"), "scanned")
    hit = cut(scanned.filter("hits is not null").dropDuplicates(["text_key"]).select("text_key", "doc_words", "hits"), "hit")
    met = hit.select("text_key", F.inline("hits").alias("seed", "doc_at")).join(small(seeds), "seed").select("text_key", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    candidates = met.join(hit.select("text_key", "doc_words"), "text_key").join(small(once.select("item", "item_words"), wide="item_words"), "item")
    found = candidates.mapInArrow(_verify(rule), "text_key string, item string, matched long, first_word long, last_word long")
    return scanned.select("doc_id", "text_key"), found, items.select("item", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: SeedRule = SeedRule()) -> DataFrame:
    """``doc_id, contaminated, item_ids, matched_words, text_key`` for each document, by its longest overlap."""
    every, found, items = overlaps(docs, benchmark, rule)
    found = cut(found.groupBy("text_key", "item").agg(F.max("matched").alias("matched")), "overlaps")
    by_text = found.join(small(items), "item").groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("matched").alias("matched_words"))
    # As many ids as rows of what was found.
    by_text = F.broadcast(by_text) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else by_text
    out = every.join(by_text, "text_key", "left")
    return out.select("doc_id", F.col("matched_words").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("matched_words", F.lit(0)).cast("long").alias("matched_words"), "text_key")


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
