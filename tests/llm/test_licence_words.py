"""Every paragraph is classified as the model alone would, wrapped or not, and whatever words it has."""

import math
import random
import re

import pytest

from evstrata.llm import licences
from evstrata.llm.shared import table

LINES = {
    "granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Released under MIT.": "mit",
    "Distributed under GPLv3": "gpl",
    "Lesser General Public License": "lgpl",
    "Affero General Public License": "agpl",
    "Students of MIT like apples": "",
}


def test_lines_outside_any_list(spark):
    docs = spark.createDataFrame(list(enumerate(LINES)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    assert [rows[i]["families"] for i in range(len(LINES))] == list(LINES.values())
    assert all(rows[i]["n_licence_paragraphs"] + rows[i]["n_unknown"] == 1 for i in rows)


def words_of(text):
    return re.findall("[a-z0-9]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def judged(text):
    """The family of a paragraph from all its n-grams, whether it is confirmed, and whether any n-gram speaks for a family."""
    model, words = licences.train(), words_of(text)
    held = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    z = [b + sum(model.weights[g][c] for g in held if g in model.weights) for c, b in enumerate(model.bias)]
    p = math.exp(max(z)) / sum(map(math.exp, z))
    family = model.classes[z.index(max(z))] if p >= model.threshold else "unknown"
    share = 0.0
    for notice in licences.NOTICES.get(family, ()):
        w = words_of(notice)
        parts = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
        share = max(share, sum(" ".join(x) in held for x in parts) / len(parts))
    return family, share >= 0.6, any(max(model.weights[g]) > 0 for g in held if g in model.weights)


def check(docs):
    got = licences.scan_licences(docs).collect()
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    for r, text in zip(sorted(got, key=lambda r: r["doc_id"]), texts, strict=True):
        # A line that ends a sentence ends the paragraph, and so does a blank one.
        all_ = [judged(x) for x in re.split(r"(?<=[.!?])[ \t\r]*\n|\n[ \t\r]*\n", text or "")]
        known = [x for x in all_ if x[0] != "unknown"]
        assert all(x[2] for x in known)
        assert (r["families"], r["n_licence_paragraphs"], r["n_confirmed"]) == (",".join(sorted({x[0] for x in known})), len(known), sum(x[1] for x in known)), text[:200]
        assert r["n_unknown"] >= sum(x[2] for x in all_) - len(known)


def test_tables_equal_brute_force(spark, sf_dir):
    check(table(spark, sf_dir, "documents").select("doc_id", "text"))


def test_mixed_words_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [w for ts in licences.NOTICES.values() for t in ts for w in t.split()] + list(licences.COMMON) + [w for t in licences.OTHERS for w in t.split()]
    texts = ["".join(rng.choice(pool) + rng.choice((" ", " ", " ", "\n", ".\n", "\n\n", ", ")) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


@pytest.mark.parametrize("width", [24, 40, 72])
def test_wrapped_notices_are_whole(width, spark):
    import textwrap

    rows = [(i, "Some text before.\n\n  " + "\n  ".join(textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False)) + "\n\nMore text after it.", f) for i, (f, t) in enumerate((f, t) for f, ts in licences.NOTICES.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, family string")
    got = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    for i, text, family in rows:
        # A notice of several sentences may be wrapped between them; each part is then judged by itself.
        if re.search(r"[.!?]\n", text.strip().removeprefix("Some text before.").rstrip().removesuffix("More text after it.").strip()) is None:
            assert (got[i]["families"], got[i]["n_confirmed"], got[i]["n_unknown"]) == (family, 1, 0), text


def test_null_and_repeated_ids_are_judged_by_text(spark):
    mit, gpl = "Released under the MIT License.", "Licensed under GPLv2 or later."
    docs = spark.createDataFrame([(None, mit), (1, gpl), (1, mit), (1, mit), (2, "no"), (None, None)], "doc_id bigint, text string")
    rows = sorted(((r["doc_id"], r["families"]) for r in licences.scan_licences(docs).collect()), key=str)
    assert rows == sorted([(None, "mit"), (1, "gpl"), (1, "mit"), (1, "mit"), (2, ""), (None, "")], key=str)


def test_all_ngrams_of_notices_are_features_and_gated():
    model = licences.train()
    assert {"lesser", "affero", "mit license"} <= set(model.weights)
    for gram, w in model.weights.items():
        if max(w) > 0:
            assert set(gram.split()) & set(model.words)
