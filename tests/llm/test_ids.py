"""Null and repeated ids: every row gets the result of its text, whatever its id is."""

from collections import Counter

import pytest
from conftest import LONG, PROSE
from pyspark.sql import functions as F

from evstrata.llm import decontaminate, language, licences, near_dup, packing, quality, token_counts
from evstrata.llm.shared import table

ROWS = [(None, PROSE * 4), (None, PROSE * 4), (None, None), (None, ""), (7, PROSE * 4), (7, PROSE * 4), (7, "something else"), (7, None), (8, PROSE * 4), (8, LONG), (None, LONG), (9, "Released under the MIT License."), (None, "Released under the MIT License.")]


def run(name, docs, spark, sf_dir):
    """``doc_id`` and what the operator says of the row."""
    if name == "language":
        # Odd rows have no label, so they are never learned from.
        known = table(spark, sf_dir, "documents").select(F.col("doc_id") + 10**9, "text", "lang")
        out = language.language_of(docs.withColumn("lang", F.lit(None).cast("string")).unionByName(known.toDF("doc_id", "text", "lang"))).filter(F.coalesce("doc_id", F.lit(0)) < 10**9)
        return out.select("doc_id", F.struct("lang_pred", F.round("score", 9), "symbols", "rejected"))
    if name == "decontaminate":
        out = decontaminate.decontaminate(docs, spark.createDataFrame([(1, PROSE)], "item_id bigint, text string"))
        return out.select("doc_id", F.struct("contaminated", "item_ids", "matched_words"))
    if name == "quality":
        return quality.judge(docs).select("doc_id", F.struct("n_words", "n_repeat_words", "base_failed", "kept", F.round("quality", 9)))
    if name == "licences":
        return licences.scan_licences(docs).select("doc_id", F.struct("families", "n_confirmed", "n_unknown"))
    if name == "near_dup":
        return near_dup.near_duplicates(docs).select("doc_id", F.struct("n_shingles", "text_key"))
    if name == "packing":
        return packing.pack(docs).select("doc_id", F.struct("piece", "start", "length", "ids_crc32"))
    return token_counts.count_tokens(docs).select("doc_id", F.struct("n_tokens"))


@pytest.mark.parametrize("name", ["language", "decontaminate", "quality", "licences", "near_dup", "packing", "token_counts"])
def test_rows_get_what_their_text_gets(name, spark, sf_dir):
    odd = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    plain = spark.createDataFrame([(100 + i, t) for i, (_, t) in enumerate(ROWS)], "doc_id bigint, text string")
    got = Counter((r[0], str(tuple(r[1]))) for r in run(name, odd, spark, sf_dir).collect())
    want = Counter((ROWS[r[0] - 100][0], str(tuple(r[1]))) for r in run(name, plain, spark, sf_dir).collect())
    assert got == want
    assert run(name, odd.limit(0), spark, sf_dir).count() == 0
