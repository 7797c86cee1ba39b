"""Licence scans with a trained paragraph classifier (operator 4).

A multinomial logistic regression over word 1- to 3-grams, sparse by an L1 penalty, tells licence
families apart.  What it gives less than a threshold is unknown; the threshold is set on rows that
the model it judges them by was not trained on.  A family is confirmed when the paragraph holds
enough of one of its templates.

A paragraph ends at a blank line and where a line ends a sentence, so notices wrapped over lines are
whole.  One can be other than unknown only if it holds an n-gram that speaks for some family against
unknown, and every such n-gram holds one of a few words, which are derived from the trained model;
what has none of them is unknown without being scored, and only the rest is counted.  Equal
paragraphs are scored once.

Defined results: a null or empty text has no licence; results are of the text alone, so documents
with null, repeated or different ids but equal texts get equal rows each; an empty table gives an
empty result; extra columns are ignored; of equally probable families the first in alphabetical order
wins; texts and paragraphs are read whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, small, table, text_key

# Usual notices of the licence families, and sentences that are none.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: AGPL-3.0-or-later", "Distributed under the AGPLv3.", "Released under the GNU Affero General Public License."),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0.", "Apache License, Version 2.0", "Dual licensed under Apache 2.0."),
    "bsd": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Distributed under the BSD license.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.", "SPDX-License-Identifier: CC0-1.0", "Released under CC0."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Released under the GPL version 2.", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under GPLv3.", "Licensed under the GPLv3.", "Licensed under GPLv2 or later.", "Released under the GNU General Public License."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only", "Distributed under the LGPLv3.", "Released under the GNU Lesser General Public License."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT", "Released under MIT.", "Distributed under the MIT License.", "Dual licensing: MIT.", "The MIT License (MIT)"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Distributed under the MPL 2.0."),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.", "This software is proprietary and confidential."),
}
OTHERS = (
    "He lost his driver license on the way to the city.", "The license plate of the car was covered with mud.", "A fishing license costs ten euros a year.", "The bar got its liquor license back.",
    "Students apply to MIT in the autumn.", "The apache helicopter landed near the river.", "Copyright law is taught in the second year.", "Permission to land was given by the tower.",
    "The commons of the village were open to everyone.", "The gnu is a large antelope.", "The mozilla browser was open on his desk.", "Creative people like to work at night.",
    "Redistribution of wealth was the subject of the debate.", "The museum charges no fee and asks for no permission.", "The licence of the radio station ends in March.", "Proprietary trading was banned at the bank.",
    "She was licensed as a nurse in 1998.", "Warranty claims have to be sent by post.", "The version under discussion was released last year.", "The public works department is closed.",
)
# Usual words, which speak for nothing; the last is one of German.
COMMON = (
    "the of and to in is that it was for on are with as his they be at this have from or had by not but what all were when we there can an your which their said if do will each about how up out "
    "them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little "
    "very after called just where most know any must under list part possible related later open above a i you your without back second ten mit"
).split()
_COMMON = frozenset(COMMON)
UNKNOWN = "unknown"
NO_WORD = "[^a-z0-9]+"
#: What ends a paragraph: the end of a line that ends a sentence, or a blank line.
PARAGRAPH_END = r"(?<=[.!?])[ \t\r]*\n|\n[ \t\r]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split() if w]


def grams(words: list[str], upto: int = 3) -> set[str]:
    """All n-grams but those of common words and digits alone, which speak for nothing."""
    return {" ".join(words[i : i + n]) for n in range(1, upto + 1) for i in range(len(words) - n + 1) if any(w not in _COMMON and (len(w) > 1 or w.isalpha()) for w in words[i : i + n])}


@dataclass(frozen=True)
class Classifier:
    """Weights by n-gram, which are relative to those of the unknown class; ``words`` are in every n-gram that speaks for a family."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    threshold: float
    words: tuple[str, ...]


class _Rows:
    """Training rows as sparse features; feature 0 is the intercept, which every row has."""

    def __init__(self, rows: list[tuple[set[str], int]], n_classes: int) -> None:
        self.names = sorted(set().union(*(g for g, _ in rows)))
        place = {g: i + 1 for i, g in enumerate(self.names)}
        self.held = [np.array([0, *(place[t] for t in sorted(g))]) for g, _ in rows]
        self.y = np.eye(n_classes)[[c for _, c in rows]]
        of_notices = set().union(*(grams(word_list(t)) for ts in NOTICES.values() for t in ts))
        self.silent = np.array([False, *(g not in of_notices for g in self.names)])

    def probabilities(self, w: np.ndarray, which: np.ndarray) -> np.ndarray:
        feature = np.concatenate([self.held[i] for i in which])
        begin = np.concatenate(([0], np.cumsum([len(self.held[i]) for i in which])[:-1]))
        return _softmax(np.add.reduceat(w[feature], begin))

    def fit(self, which: np.ndarray, rounds: int, rate: float, sparsity: float) -> np.ndarray:
        """Proximal gradient descent on the rows ``which``: steps, then weights are drawn towards nought."""
        held = [self.held[i] for i in which]
        feature = np.concatenate(held)
        begin = np.concatenate(([0], np.cumsum([len(h) for h in held])[:-1]))
        order = np.argsort(feature, kind="stable")
        owner = np.repeat(np.arange(len(held)), [len(h) for h in held])[order]
        used, first = np.unique(feature[order], return_index=True)
        y = self.y[which]
        w = np.zeros((len(self.names) + 1, y.shape[1]))
        for _ in range(rounds):
            g = (_softmax(np.add.reduceat(w[feature], begin)) - y) * (10 / len(held))
            step = w[used] - rate * np.add.reduceat(g[owner], first)
            step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * sparsity, 0)
            w[used] = step
        w -= w[:, -1:]
        # What no notice holds can only speak against them.
        w[self.silent] = np.minimum(w[self.silent], 0)
        return w


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _training_rows(classes: tuple[str, ...], copies: int, seed: int) -> tuple[list[tuple[set[str], int]], list[int]]:
    """The notices and other sentences (fold -1), copies of them in odd surroundings with a word missing, and mixed words.

    All n-grams of the notices and other sentences are features.
    """
    rng = np.random.default_rng(seed)
    filler = [w for s in OTHERS for w in word_list(s)] + COMMON + list("0123456789")
    features = set().union(*(grams(word_list(t)) for t in (*OTHERS, *(t for ts in NOTICES.values() for t in ts))))
    some = lambda n: [str(rng.choice(filler)) for _ in range(n)]
    rows, folds = [], []
    for y, name in enumerate(classes):
        for text in OTHERS if name == UNKNOWN else NOTICES[name]:
            words = word_list(text)
            rows.append((grams(words), y))
            folds.append(-1)
            for k in range(copies):
                kept = list(words)
                if len(kept) > 4 and rng.random() < 0.5:
                    kept.pop(int(rng.integers(len(kept))))
                around = some(int(rng.integers(0, 9)))
                at = int(rng.integers(len(around) + 1))
                rows.append((grams(around[:at] + kept + around[at:]) & features, y))
                folds.append(k % 3)
    for k in range(len(rows) // 4):
        rows.append((grams(some(int(rng.integers(0, 60)))) & features, len(classes) - 1))
        folds.append(k % 3)
    return rows, folds


@lru_cache(maxsize=1)
def train(copies: int = 12, rounds: int = 300, rate: float = 0.5, sparsity: float = 2e-3, seed: int = 7) -> Classifier:
    """Fit on all rows; the threshold comes from three models that each leave out a third of the copies."""
    classes = (*sorted(NOTICES), UNKNOWN)
    rows, folds = _training_rows(classes, copies, seed)
    data, fold = _Rows(rows, len(classes)), np.array(folds)
    y = np.array([c for _, c in rows])
    right, wrong = [], []
    for k in range(3):
        out = np.flatnonzero(fold == k)
        p = data.probabilities(data.fit(np.flatnonzero(fold != k), rounds, rate, sparsity), out)
        known = y[out] < len(classes) - 1
        right.append(p[known, y[out][known]])
        wrong.append(p[~known, :-1].max(1))
    # Midway between what nearly all notices reach and what no other sentence does; above one half, so that unknown never has more.
    low, high = np.quantile(np.concatenate(wrong), 0.995), np.quantile(np.concatenate(right), 0.02)
    threshold = float(np.clip((low + high) / 2, 0.51, 0.95))
    w = data.fit(np.arange(len(rows)), rounds, rate, sparsity)
    used = {g: w[i + 1] for i, g in enumerate(data.names) if np.abs(w[i + 1]).max() > 0}
    if w[0].max() > 0:
        raise ValueError("a family is more probable than unknown without any evidence")
    return Classifier(classes, {g: tuple(map(float, x)) for g, x in used.items()}, tuple(map(float, w[0])), threshold, _words_of([g for g, x in used.items() if x.max() > 0]))


def _words_of(speaking: list[str]) -> tuple[str, ...]:
    """Words of which every n-gram has one: single words, then the longest word of what has none yet."""
    out: set[str] = set()
    for gram in sorted(speaking, key=lambda g: (g.count(" "), g)):
        words = gram.split()
        if not out & set(words):
            out.add(max((w for w in words if grams([w])), key=lambda x: (len(x), x)))
    return tuple(sorted(out))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for texts that have one of the words, whole; words are held by their first characters."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    ways = "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in sorted(by_first.items()))
    return f"(?i)(?<![a-z0-9])(?=[{''.join(sorted(by_first))}])(?:{ways})(?![a-z0-9])"


def _runs(n: int) -> Column:
    """All runs of ``n`` words of the array ``w``."""
    some = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return F.when(F.size("w") >= n, some).otherwise(F.array().cast("array<string>"))


def licence_paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Paragraphs that hold a word of the classifier: ``text_key, paragraph, words, id`` (a digest of the words); of equal texts once."""
    gate = any_of(train().words)
    text = F.col(text_col)
    rows = docs.filter(text.rlike(gate)).select(text_key(text).alias("text_key"), F.transform(F.split(text, PARAGRAPH_END, -1), lambda x, i: F.struct(i.alias("paragraph"), x.alias("text"))).alias("all"))
    rows = rows.select("text_key", F.inline(F.filter("all", lambda x: x["text"].rlike(gate))).alias("paragraph", "text"))
    words = F.filter(F.split(F.translate("text", UPPER, LOWER), NO_WORD, -1), lambda x: x != "")
    return rows.select("text_key", "paragraph", F.array_join(words, " ").alias("words")).withColumn("id", F.md5("words")).dropDuplicates(["text_key", "paragraph", "id"])


def classify(paragraphs: DataFrame, confirm: float = 0.6) -> DataFrame:
    """``id, family, probability, confirmed`` of each of the distinct ``words``."""
    spark = paragraphs.sparkSession
    model = train()
    k = len(model.classes) - 1
    weights = F.broadcast(spark.createDataFrame([(t, list(w[:k])) for t, w in model.weights.items()], "gram string, weight array<double>"))
    templates = []
    for family, notices in NOTICES.items():
        for i, text in enumerate(notices):
            words = word_list(text)
            parts = {" ".join(words[j : j + 3]) for j in range(len(words) - 2)} or {" ".join(words)}
            templates += [(f"{family}/{i}", family, part, len(parts)) for part in parts]
    templates = F.broadcast(spark.createDataFrame(templates, "template string, family string, gram string, parts int"))
    once = cut(paragraphs.select("id", "words").dropDuplicates(["id"]), "paragraphs")
    every = once.select("id", F.split("words", " ", -1).alias("w"))
    parts = every.select("id", F.explode(F.array_distinct(F.concat(*(_runs(n) for n in (1, 2, 3))))).alias("gram"))
    logits = parts.join(weights, "gram").groupBy("id").agg(*(F.sum(F.col("weight")[i]).alias(f"z{i}") for i in range(k)))
    z = [F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + F.lit(model.bias[i]) for i in range(k)] + [F.lit(0.0)]
    top = F.greatest(*z)
    best = F.lit(UNKNOWN)
    for i in reversed(range(k)):
        best = F.when(z[i] == top, model.classes[i]).otherwise(best)
    total = sum((F.exp(x - top) for x in z), F.lit(0.0))
    judged = once.select("id").join(small(logits), "id", "left").select("id", best.alias("best"), F.round(1 / total, 6).alias("probability"))
    judged = judged.withColumn("family", F.when((F.col("best") != UNKNOWN) & (F.col("probability") >= model.threshold), F.col("best")).otherwise(UNKNOWN)).drop("best")
    held = parts.join(templates, "gram").groupBy("id", "template", "family").agg((F.count("*") / F.first("parts")).alias("held")).groupBy("id", "family").agg(F.max("held").alias("held"))
    return judged.join(small(held), ["id", "family"], "left").select("id", "family", "probability", (F.coalesce("held", F.lit(0.0)) >= confirm).alias("confirmed"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, families, n_licence_paragraphs, n_confirmed, n_unknown`` for each document."""
    paragraphs = cut(licence_paragraphs(docs, text_col), "licences")
    found = paragraphs.select("text_key", "id").join(small(cut(classify(paragraphs), "classified")), "id")
    known = F.col("family") != UNKNOWN
    by_text = found.groupBy("text_key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("family")))), ",").alias("families"), F.count_if(known).alias("n_licence_paragraphs"), F.count_if(known & F.col("confirmed")).alias("n_confirmed"), F.count_if(~known).alias("n_unknown")
    )
    out = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key")).join(small(cut(by_text, "by-text")), "text_key", "left")
    return out.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_licence_paragraphs", "n_confirmed", "n_unknown")))


def op4_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
