"""Language identification with Kneser-Ney character models (operator 3).

Each language has an interpolated Kneser-Ney model over 4-grams of lower-cased letters, every run of
other characters being one space.  Counts cover all training documents but those that calibrate the
rejection, and are summed per task before they are shuffled; discounts, continuation counts and
probabilities are DataFrame aggregations.  N-grams are addressed by whole 64-bit hashes, and none is
merged with another or dropped.  A model of up to ``CELLS`` n-grams times languages is broadcast, in
arrays sorted by hash with one column per language; a larger one stays a table that is joined with
the texts' n-grams.  The language of lowest cross-entropy per character wins, and the score is its
share of the likelihoods of the whole text.  A document is rejected if its cross-entropy lies beyond
what labelled documents of its language and length show that are left out of the counts.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is
every text when nothing can be learned from; of equal cross-entropies the first language in
alphabetical order wins; repeated rows get equal rows each; a null ``doc_id`` is never trained on;
a text is counted and scored whole, however long; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix64
from .shared import cut, table, text_key

U64 = np.uint64
ORDER = 4
#: Rows times languages up to which a model is broadcast; each language counts as a few at least, for what a row itself takes.
CELLS = 1 << 23
LEAST_LANGS = 4
PAD, SPACE = 1, 32
_M = [pow(0xF1357AEA2E62A9C5, j, 1 << 64) for j in range(ORDER)]
#: Characters counted or scored at a time.
CHUNK = 1 << 17


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """For every code point the symbol it is read as: itself if a letter, else a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    letters = [i for i in range(0x110000) if chr(i).isalpha()]
    out[letters] = letters
    out[0] = PAD
    return out


def read_symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, each text after ORDER - 1 pads, and where each text's pads begin."""
    lead = "\0" * (ORDER - 1)
    joined = "".join([lead + t.replace("\0", " ").lower() for t in texts])
    s = _symbols()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = s != SPACE
    keep[1:] |= s[:-1] != SPACE
    s = s[keep]
    pads = np.flatnonzero(s == PAD)
    return s, pads[:: ORDER - 1]


def codes(s: np.ndarray) -> list[np.ndarray]:
    """For k = 1..ORDER the hashes of the k-grams ending at each symbol from the ORDER-th on."""
    wide = s.astype(np.uint64)
    n = len(s) - ORDER + 1
    total = np.zeros(n, np.uint64)
    out = []
    for k in range(ORDER):
        total = total + wide[ORDER - 1 - k : len(s) - k] * U64(_M[k])
        out.append(mix64(total + U64(k + 1)))
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    i, size, held = 0, 0, []
    for j, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield i, held
            i, size, held = j + 1, 0, []
    if held:
        yield i, held


class _Counts:
    """Counts of top-order n-grams of one language, with the hashes of their parts."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, s: np.ndarray) -> None:
        g = codes(s)
        scored = np.flatnonzero((s[ORDER - 1 :] != PAD)[1:]) + 1 if len(s) > ORDER else np.zeros(0, np.int64)
        top = g[-1][scored]
        keys, at, n = np.unique(top, return_index=True, return_counts=True)
        i = scored[at]
        self.held.append((keys, g[2][i], g[1][i], g[0][i], g[2][i - 1], g[1][i - 1], g[0][i - 1], n.astype(np.int64)))
        self.rows += len(keys)
        if len(self.held) > 1 and self.rows > 1 << 20:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        keys, at, inverse = np.unique(columns[0], return_index=True, return_inverse=True)
        n = np.bincount(inverse, columns[-1], len(keys)).astype(np.int64)
        self.held = [(keys, *(c[at] for c in columns[1:-1]), n)]
        self.rows = len(keys)
        return self.held[0]


_COUNT_NAMES = ["g4", "g3", "g2", "g1", "x4", "x3", "x2", "n"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, _Counts] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for t, lang in zip(texts, langs, strict=True):
            if t:
                by.setdefault(lang, []).append(t)
        for lang, mine in by.items():
            for _, part in _chunks(mine):
                # One more pad in front gives the first symbol a context of its own.
                s, _ = read_symbols(part)
                found.setdefault(lang, _Counts()).add(np.concatenate(([PAD], s)).astype(np.uint32))
    for lang, c in found.items():
        *parts, n = c.merge()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *(pa.array(p.view(np.int64)) for p in parts), pa.array(n)], ["lang", *_COUNT_NAMES])


@dataclass
class Model:
    """``slots[k]`` sorted, ``rows[k]`` log probabilities by language; ``back_slots``/``back`` the weights of unseen continuations."""

    langs: list[str]
    slots: list[np.ndarray]
    rows: list[np.ndarray]
    back_slots: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray

    def _find(self, slots: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(slots):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(slots, wanted), len(slots) - 1)
        return at, slots[at] == wanted

    def logs(self, g: list[np.ndarray], x: list[np.ndarray], k: int) -> np.ndarray:
        """Log probabilities, one column per language, of k + 1-grams with slots ``g`` (by order) after contexts ``x``."""
        if k < 0:
            return np.broadcast_to(self.floor, (len(g[0]), len(self.langs)))
        at, seen = self._find(self.slots[k], g[k])
        out = self.rows[k][at] if len(self.slots[k]) else np.zeros((len(g[0]), len(self.langs)), np.float32)
        missing = np.flatnonzero(~seen)
        if len(missing):
            lower = self.logs([a[missing] for a in g], [a[missing] for a in x], k - 1)
            if k:
                where, known = self._find(self.back_slots[k], x[k][missing])
                weight = np.where(known[:, None], self.back[k][where] if len(self.back_slots[k]) else 0.0, 0.0)
            else:
                weight = 0.0
            out[missing] = lower + weight
        return out


@dataclass
class Levels:
    """``share``: per ``k, lang, g`` the context ``x``, suffix ``s``, direct probability ``p`` and weight ``spare`` of what is unseen; ``context``: that weight per ``k, lang, x``."""

    share: DataFrame
    context: DataFrame


def count_levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Levels:
    """Counts and discounted shares of every n-gram of every language among the rows of ``docs``."""
    pairs = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    raw = pairs.mapInArrow(_count, "lang string, " + ", ".join(f"{c} long" for c in _COUNT_NAMES))
    keys = _COUNT_NAMES[:-1]
    grams = cut(raw.groupBy("lang", "g4").agg(*(F.first(c).alias(c) for c in keys[1:]), F.sum("n").alias("n")), "grams")
    three = grams.groupBy("lang", "g3").agg(F.first("x3").alias("x3"), F.first("g2").alias("g2"), F.first("x2").alias("x2"), F.first("g1").alias("g1"), F.count("*").alias("n"))
    two = three.groupBy("lang", "g2").agg(F.first("x2").alias("x2"), F.first("g1").alias("g1"), F.count("*").alias("n"))
    one = two.groupBy("lang", "g1").agg(F.count("*").alias("n"))
    levels = [
        one.select("lang", F.col("g1").alias("g"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("s"), "n"),
        two.select("lang", F.col("g2").alias("g"), F.col("x2").alias("x"), F.col("g1").alias("s"), "n"),
        three.select("lang", F.col("g3").alias("g"), F.col("x3").alias("x"), F.col("g2").alias("s"), "n"),
        grams.select("lang", F.col("g4").alias("g"), F.col("x4").alias("x"), F.col("g3").alias("s"), "n"),
    ]
    every = None
    for k, level in enumerate(levels):
        level = level.withColumn("k", F.lit(k))
        every = level if every is None else every.unionByName(level)
    every = cut(every, "levels")
    # Absolute discount by order and language: n1 / (n1 + 2 n2), as Kneser and Ney give it.  Broadcast: four rows a language.
    discount = every.groupBy("k", "lang").agg(((F.count_if(F.col("n") == 1) + 0.5) / (F.count_if(F.col("n") == 1) + 2 * F.count_if(F.col("n") == 2) + 1)).alias("d"))
    context = every.groupBy("k", "lang", "x").agg(F.sum("n").alias("t"), F.count("*").alias("kinds")).join(F.broadcast(discount), ["k", "lang"])
    context = cut(context.select("k", "lang", "x", "t", "d", (F.col("d") * F.col("kinds") / F.col("t")).alias("spare")), "contexts")
    share = every.join(context, ["k", "lang", "x"]).select("k", "lang", "g", "x", "s", "n", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("t")).alias("p"), "spare")
    return Levels(share, context)


def _collect(levels: Levels) -> Model:
    share = levels.share.select("k", "g", "lang", "x", "s", "p", "spare").toArrow()
    weight = levels.context.filter("k > 0").select("k", "x", "lang", "spare").toArrow()
    return _assemble(share, weight)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of every language among the rows of ``docs``, on the driver."""
    return _collect(count_levels(docs, text_col, lang_col))


@dataclass
class Tables:
    """A model too large to broadcast: ``logs[k]`` with ``g`` and a map from languages to log probabilities, ``back[k]`` with ``x`` and one to weights."""

    langs: list[str]
    logs: list[DataFrame]
    back: list[DataFrame | None]
    floor: list[float]


def tabulate(levels: Levels) -> Tables:
    """What ``_assemble`` makes, as tables."""
    share = cut(levels.share, "shares")
    langs = sorted(r["lang"] for r in share.select("lang").distinct().collect())
    floor = -float(np.log(4.0 * max(2, int(share.filter("k = 0").count() / max(1, len(langs))))))
    unseen = dict(share.filter("k = 0").groupBy("lang").agg((F.log(F.max("spare")) + floor).alias("log")).collect())
    logs, back, below = [], [None], None
    by_lang = lambda c: F.map_from_entries(F.collect_list(F.struct("lang", c)))
    for k in range(ORDER):
        mine = share.filter(F.col("k") == k)
        if below is None:
            mine = mine.withColumn("lower", F.lit(floor))
        else:
            mine = mine.join(below.select("lang", F.col("g").alias("s"), F.col("log").alias("lower")), ["lang", "s"])
        below = cut(mine.select("lang", "g", F.log(F.col("p") + F.col("spare") * F.exp("lower")).alias("log")), f"logs{k}")
        logs.append(below.groupBy("g").agg(by_lang("log").alias("logs")))
        if k:
            back.append(levels.context.filter(F.col("k") == k).groupBy("x").agg(by_lang(F.log("spare")).alias("back")))
    return Tables(langs, logs, back, [unseen[x] for x in langs])


def learn_any(docs: DataFrame, cells: int = CELLS) -> Model | Tables:
    """The model by whole hashes, as arrays if it is small and as tables if not."""
    levels = count_levels(docs)
    levels = Levels(cut(levels.share, "shares"), levels.context)
    size = levels.share.agg(F.count("*").alias("rows"), F.count_distinct("lang").alias("langs")).first()
    return _collect(levels) if size["rows"] * max(LEAST_LANGS, size["langs"]) <= cells else tabulate(levels)


def _columns(rows: pa.Table, langs: list[str]) -> dict[str, np.ndarray]:
    """The columns of ``rows`` as arrays, languages by their place in ``langs``."""
    out = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "lang"}
    out["lang"] = pc.index_in(rows.column("lang"), pa.array(langs, pa.string())).to_numpy()
    return out


def _assemble(share: pa.Table, weight: pa.Table) -> Model:
    langs = sorted(pc.unique(share.column("lang")).to_pylist())
    share, weight = _columns(share, langs), _columns(weight, langs)
    alphabet = max(2, int((share["k"] == 0).sum() / max(1, len(langs))))
    empty = np.zeros(0, np.int64)
    blank = np.zeros((0, len(langs)), np.float32)
    # An unseen symbol has its part of what the seen ones leave.
    floor = np.full(len(langs), -np.log(4.0 * alphabet))
    floor[share["lang"][share["k"] == 0]] = np.log(share["spare"][share["k"] == 0]) - np.log(4.0 * alphabet)
    m = Model(langs, [empty] * ORDER, [blank] * ORDER, [empty] * ORDER, [blank] * ORDER, floor.astype(np.float32))
    for k in range(1, ORDER):
        mine = weight["k"] == k
        slots, at = np.unique(weight["x"][mine], return_inverse=True)
        rows = np.zeros((len(slots), len(langs)), np.float32)
        rows[at, weight["lang"][mine]] = np.log(weight["spare"][mine])
        m.back_slots[k], m.back[k] = slots, rows
    for k in range(ORDER):
        mine = share["k"] == k
        lang, p = share["lang"][mine], share["p"][mine]
        slots, first, at = np.unique(share["g"][mine], return_index=True, return_inverse=True)
        direct = np.zeros((len(slots), len(langs)))
        direct[at, lang] = p
        if k:
            x, s = share["x"][mine][first], share["s"][mine][first]
            lower = _lower(m, s, k - 1)
            where, known = m._find(m.back_slots[k], x)
            spare = np.where(known[:, None], m.back[k][where] if len(m.back_slots[k]) else 0.0, 0.0)
        else:
            lower, spare = np.broadcast_to(m.floor, direct.shape), 0.0
        m.slots[k], m.rows[k] = slots, np.log(direct + np.exp(spare + lower)).astype(np.float32)
    return m


def _lower(m: Model, s: np.ndarray, k: int) -> np.ndarray:
    """Rows of the (k + 1)-grams ``s``; every suffix of a counted n-gram is itself counted."""
    at, seen = m._find(m.slots[k], s)
    return np.where(seen[:, None], m.rows[k][at], m.floor)


def score_texts(m: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol by language, and the number of symbols, of each text."""
    entropy, size = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), np.int64)
    for i, part in _chunks(texts):
        s, begin = read_symbols(part)
        s = np.concatenate(([PAD], s)).astype(np.uint32)
        all_slots = [c.view(np.int64) for c in codes(s)]
        scored = np.flatnonzero(s[ORDER:] != PAD) + 1
        g = [c[scored] for c in all_slots]
        x = [all_slots[0][scored]] + [c[scored - 1] for c in all_slots[:-1]]
        logs = m.logs(g, x, ORDER - 1)
        bounds = np.searchsorted(scored + ORDER - 1, np.append(begin + 1, len(s)))
        total = np.zeros((len(logs) + 1, len(m.langs)))
        np.cumsum(logs, axis=0, out=total[1:])
        n = np.diff(bounds)
        size[i : i + len(part)] = n
        entropy[i : i + len(part)] = -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)[:, None]
    return entropy, size


def _has_letter(text: str | None) -> bool:
    return bool(text) and (text[0].isalpha() or any(map(str.isalpha, text)))


def _score(shared, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column("text").to_pylist()
                n = len(texts)
                letter = np.array([_has_letter(t) for t in texts], bool)
                if m.langs:
                    entropy, size = score_texts(m, texts)
                    best = entropy.argmin(axis=1)
                    weighed = -(entropy - entropy.min(axis=1, keepdims=True)) * size[:, None]
                    score = 1 / np.exp(weighed).sum(axis=1)
                    least = entropy.min(axis=1)
                else:
                    best, score, least, size, letter = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
                langs = [m.langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), pa.array(langs), pa.array(np.where(letter, score, 0.0)), pa.array(least), pa.array(size)], [*extra, "lang_pred", "score", "entropy", "symbols"])

    return run


def identify(docs: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, lang_pred, score, entropy, symbols``; the columns ``keys`` are carried along unread."""
    spark = docs.sparkSession
    rows = docs.select(*keys, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model), keys), f"{kinds}, lang_pred string, score double, entropy double, symbols long")


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct 4-grams of each text with the hashes of their parts and their number."""
    for batch in batches:
        for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # A long text gives several groups of rows; they are added up later.
            s, _ = read_symbols([t or ""])
            s = np.concatenate(([PAD], s)).astype(np.uint32)
            for lo in range(0, max(1, len(s) - ORDER), CHUNK):
                part = s[lo : lo + CHUNK + ORDER]
                g = codes(part)
                scored = np.flatnonzero(part[ORDER:] != PAD) + 1
                keys, at, n = np.unique(g[-1][scored], return_index=True, return_counts=True)
                i = scored[at]
                parts = (keys, g[2][i], g[1][i], g[0][i], g[2][i - 1], g[1][i - 1], g[0][i - 1])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(keys), pa.int64()), *(pa.array(c.view(np.int64)) for c in parts), pa.array(n.astype(np.int64)), pa.array([_has_letter(t)] * len(keys), pa.bool_())], ["row", *_COUNT_NAMES, "letter"])


def identify_by_join(docs: DataFrame, tables: Tables, keys: list[str], text_col: str = "text") -> DataFrame:
    """As ``identify``, with the texts' n-grams joined to the tables; every distinct n-gram is resolved once."""
    rows = cut(docs.select(*keys, F.col(text_col).alias("text")).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = rows.select("_row", "text").mapInArrow(_text_grams, "row long, " + ", ".join(f"{c} long" for c in _COUNT_NAMES) + ", letter boolean")
    found = cut(found, "text-grams")
    grams = found.select(*_COUNT_NAMES[:-1]).distinct()
    for k in range(ORDER):
        grams = grams.join(tables.logs[k].select(F.col("g").alias(f"g{k + 1}"), F.col("logs").alias(f"log{k}")), f"g{k + 1}", "left")
        if k:
            grams = grams.join(tables.back[k].select(F.col("x").alias(f"x{k + 1}"), F.col("back").alias(f"back{k}")), f"x{k + 1}", "left")
    columns = []
    for i, lang in enumerate(tables.langs):
        log = F.lit(tables.floor[i])
        for k in range(ORDER):
            log = F.coalesce(F.col(f"log{k}")[lang], (log + F.coalesce(F.col(f"back{k}")[lang], F.lit(0.0))) if k else log)
        columns.append(log.alias(f"l{i}"))
    grams = cut(grams.select("g4", *columns), "resolved")
    sums = found.select("row", "letter", "g4", "n").join(grams, "g4").groupBy("row").agg(F.sum("n").alias("symbols"), F.max("letter").alias("letter"), F.array(*(-F.sum(F.col("n") * F.col(f"l{i}")) / F.sum("n") for i in range(len(tables.langs)))).alias("e"))
    out = rows.drop("text").join(sums.withColumnRenamed("row", "_row"), "_row", "left")
    least = F.array_min("e")
    best = F.element_at(F.array(*map(F.lit, tables.langs)), F.array_position("e", least).cast("int"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp((F.array_min("e") - x) * F.col("symbols")))
    letter = F.coalesce("letter", F.lit(False))
    return out.select(*keys, F.when(letter, best).otherwise("und").alias("lang_pred"), F.when(letter, 1 / total).otherwise(0.0).alias("score"), F.when(F.col("symbols") > 0, least).otherwise(0.0).alias("entropy"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


def with_rejection(found: DataFrame, sure: str = "calibrates AND lang = lang_pred", enough: int = 30, times: float = 6.0, least: float = 0.05) -> DataFrame:
    """Add ``rejected``: entropy too far beyond what the rows ``sure``, which the model was not learned from, show.

    Entropies are taken as shares of the median of their language.  The limit of a language and length is
    the median share and ``times`` the way from it to the 0.9 quantile (``least`` at least), neither of
    which a tenth of bad rows moves.  Classes of fewer than ``enough`` rows take the limit of their length
    in all languages, and if that is as rare, one over all lengths whose spread is that of a mean of so
    many symbols.
    """
    # What is broadcast has a row for each language, or for each language and power of two of symbols.
    length = F.floor(F.log2(F.greatest(F.col("symbols"), F.lit(1)))).cast("int")
    found = found.withColumn("length_class", length)
    good = found.filter(F.expr(sure)).filter("lang_pred <> 'und'")
    centres = good.groupBy("lang_pred").agg(F.percentile_approx("entropy", 0.5, 1000).alias("own"), F.count("*").alias("rows"))
    usual = good.agg(F.percentile_approx("entropy", 0.5, 1000).alias("usual"))
    # A median of one or two rows does not lower the centre.
    centre = F.when(F.col("rows") >= 3, F.col("own")).otherwise(F.greatest("own", "usual"))
    shares = good.join(F.broadcast(centres), "lang_pred").join(F.broadcast(usual), F.lit(True)).withColumn("share", F.col("entropy") / F.greatest(centre, F.lit(1e-9)))

    def limits(name: str, *by: str) -> DataFrame:
        q = F.percentile_approx("share", [0.5, 0.9], 1000)
        out = shares.groupBy(*by).agg(q.alias("q"), F.count("*").alias("n")).filter(F.col("q").isNotNull())
        if by:
            out = out.filter(F.col("n") >= enough)
        return F.broadcast(out.select(*by, F.col("q")[0].alias(f"{name}_mid"), F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(least)).alias(f"{name}_way")))

    out = found.join(F.broadcast(centres), "lang_pred", "left").join(F.broadcast(usual), F.lit(True), "left")
    out = out.join(limits("class", "lang_pred", "length_class"), ["lang_pred", "length_class"], "left").join(limits("length", "length_class"), "length_class", "left").join(limits("all"), F.lit(True), "left")
    by_size = F.greatest("all_way", 1 / F.sqrt(F.greatest(F.col("symbols"), F.lit(1))))
    limit = F.coalesce(*(F.col(f"{c}_mid") + times * F.col(f"{c}_way") for c in ("class", "length")), F.col("all_mid") + times * by_size)
    beyond = F.col("entropy") > limit * F.coalesce(centre, F.col("usual"))
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | F.coalesce(beyond, F.lit(False))).select(*(c for c in found.columns if c != "length_class"), "rejected")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def calibrating(id_col: str = "doc_id") -> Column:
    """A fifth of the documents that are not held out."""
    return ~held_out(id_col) & F.coalesce(F.expr(f"crc32(cast({id_col} as string)) div 5 % 5 = 0"), F.lit(False))


def language_of(docs: DataFrame, spare: int = 5, cells: int = CELLS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, symbols, rejected, text_key``, learned from the documents that are not held out.

    A fifth of those is not counted either but tells what the language's entropies are; a language that
    has fewer than ``spare`` other documents is learned from all of them.
    """
    docs = docs.select("doc_id", "text", "lang", text_key().alias("text_key"), held_out().alias("held_out"), calibrating().alias("_apart"))
    counted = docs.filter("NOT held_out AND lang IS NOT NULL").groupBy("lang").agg(F.count_if(~F.col("_apart")).alias("n"))
    plenty = F.broadcast(counted.filter(F.col("n") >= spare).select("lang", F.lit(True).alias("_plenty")))
    docs = docs.join(plenty, "lang", "left").withColumn("calibrates", F.col("_apart") & F.coalesce("_plenty", F.lit(False)))
    model = learn_any(docs.filter("NOT held_out AND NOT calibrates"), cells)
    found = cut((identify if isinstance(model, Model) else identify_by_join)(docs, model, ["doc_id", "held_out", "lang", "calibrates", "text_key"]), "languages")
    return with_rejection(found).select("doc_id", "held_out", "lang_pred", "score", "entropy", "symbols", "rejected", "text_key")


def op3_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))
