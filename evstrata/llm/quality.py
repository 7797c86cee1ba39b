"""Quality by weak supervision (operator 7): rules vote, expectation-maximisation weighs them.

Every rule votes good (1), bad (-1) or abstains (0).  A two-class latent model with one vote
distribution per rule and class is fitted to the counts of vote patterns over all documents; the
posterior probability of the good class replaces a list of conditions that all must hold.  Only the
pattern counts, at most 3 ** (number of rules) rows, reach the driver.

Defined results: a null or empty text has no words and fails the base; equal texts get equal
results, whether their ids are repeated, null or different; a text is measured whole, however long;
an empty table gives an empty result; extra columns are ignored; a posterior of exactly one half
keeps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table, text_key

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class VoteRule:
    """Votes bad beyond ``bad``, good from ``good`` on (None: never), and abstains in between."""

    name: str
    ratio: str
    bad: float
    good: tuple[float, float] | None = None

    def vote(self) -> Column:
        x = F.expr(self.ratio)
        out = F.when(x > self.bad, -1)
        if self.good:
            out = out.when(x.between(*self.good), 1)
        return out.otherwise(0).cast("int")


#: Defect rules vote bad or abstain: a text free of one defect is not good for that alone.
RULES = (
    VoteRule("letters", "1 - n_letters / greatest(word_chars, 1)", 0.10, (0.0, 0.05)),
    VoteRule("symbols", "n_symbols / greatest(n_words, 1)", 0.10),
    VoteRule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", 0.30),
    VoteRule("repeated_words", "n_repeat_words / greatest(n_words, 1)", 0.40),
    VoteRule("capitals", "n_upper / greatest(word_chars, 1)", 0.40),
    VoteRule("word_length", "abs(word_chars / greatest(n_words, 1) - 6.0)", 4.5),
)


def _count(text: Column, chars: str) -> Column:
    """How many characters of the class ``chars`` the text has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The base counts of every text, in built-in functions only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    base = docs.select(*keep, text.alias("t"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1)).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    base = base.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).alias("n_symbols"),
        _count(F.col("t"), "A-Z").alias("n_upper"),
        _count(F.col("t"), r"\p{L}\p{N}").alias("n_letters"),
        lines.alias("l"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_letters"]
    window = F.when(F.size("h") >= 3, F.transform(F.slice("h", 1, F.size("h") - 2), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))))
    base = base.select(*keep, *counts, F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), window.alias("g"))
    counts += ["n_lines", "n_dup_lines"]
    base = base.select(*keep, *counts, "g", (F.size(F.array_distinct("g")) < F.size("g")).alias("again"))
    # Where a window recurs: windows with their places, sorted, so that equal ones are neighbours.
    places = F.when(F.col("again"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("p")))))
    base = base.select(*keep, *counts, places.alias("r"))
    twice = F.expr("sort_array(filter(transform(r, (x, i) -> if((i > 0 and get(r, i - 1).g = x.g) or coalesce(get(r, i + 1).g = x.g, false), x.p, null)), p -> p is not null))")
    base = base.select(*keep, *counts, twice.alias("d"))
    covered = F.expr("coalesce(aggregate(d, named_struct('n', 0L, 'last', -3), (s, p) -> named_struct('n', s.n + least(3, p - s.last), 'last', p), s -> s.n), 0L)")
    return base.select(*keep, *counts, covered.alias("n_repeat_words"))


def fit_votes(counts: list[tuple[tuple[int, ...], int]], rounds: int = 100, smooth: float = 1.0, prior: float = 0.1) -> dict[tuple[int, ...], float]:
    """Posterior of the good class for each vote pattern, by expectation-maximisation."""
    if not counts:
        return {}
    n_rules = len(counts[0][0])
    # Defects are rare and speak for themselves: one outweighs any praise until the counts say otherwise.
    post = {p: 1 / (1 + math.exp(-(1 + 0.5 * p.count(1) - 6 * p.count(-1)))) for p, _ in counts}
    total = sum(n for _, n in counts)
    for _ in range(rounds):
        mass = [smooth, smooth]
        seen = [[{v: smooth for v in (-1, 0, 1)} for _ in range(n_rules)] for _ in (0, 1)]
        # Prior beliefs, worth ``prior`` of the documents, keep the classes what they are called even
        # where one is empty: bad documents get bad votes or none, good ones good votes or none.
        for r in range(n_rules):
            seen[0][r][-1] += prior * total
            seen[0][r][0] += prior * total
            seen[1][r][0] += prior * total
            seen[1][r][1] += prior * total
        mass[1] += prior * total
        for p, n in counts:
            for c, share in ((0, 1 - post[p]), (1, post[p])):
                mass[c] += n * share
                for r, v in enumerate(p):
                    seen[c][r][v] += n * share
        logs = [[{v: math.log(x / sum(d.values())) for v, x in d.items()} for d in seen[c]] for c in (0, 1)]
        new = {}
        for p, _ in counts:
            odds = math.log(mass[1] / mass[0]) + sum(logs[1][r][v] - logs[0][r][v] for r, v in enumerate(p))
            new[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        moved = max(abs(new[p] - post[p]) for p in new)
        post = new
        if moved < 1e-9:
            break
    return post


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[VoteRule, ...] = RULES) -> DataFrame:
    """``id, counts, base_failed, kept, quality`` (posterior) ``, text_key`` for each row of ``docs``."""
    spark = docs.sparkSession
    found = measures(docs.select(F.col(id_col), F.col(text_col).alias("text"), text_key(text_col).alias("text_key")), "text", (id_col, "text_key"))
    found = cut(found.withColumns({f"v_{r.name}": r.vote() for r in rules}), "measures")
    votes = [f"v_{r.name}" for r in rules]
    counts = [(tuple(x[v] for v in votes), x["n"]) for x in found.groupBy(*votes).agg(F.count("*").alias("n")).orderBy(*votes).collect()]
    posterior = spark.createDataFrame([(*p, q) for p, q in fit_votes(counts).items()], ", ".join(f"{v} int" for v in votes) + ", quality double")
    out = found.join(F.broadcast(posterior), votes, "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "text_key")


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
