"""A training corpus from raw documents, in stages that each read what the last one wrote.

All stages ignore extra columns, whatever their names are, and all but the last return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evstrata.llm.decontaminate import decontaminate
from evstrata.llm.language import language_of
from evstrata.llm.near_dup import near_duplicates
from evstrata.llm.packing import pack
from evstrata.llm.quality import judge
from evstrata.llm.shared import cut, small, table, text_key

_KEY = "_text_key"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not among the ``text_key`` of ``gone``, whatever ids they have."""
    keyed = docs.select(*docs.columns, text_key("text").alias(_KEY))
    return keyed.join(small(gone.select(F.col("text_key").alias(_KEY)).distinct()), _KEY, "left_anti").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language stay.

    The verdict is of the text alone: rows with a null or repeated ``doc_id`` are judged each by its text,
    and repeated rows share their fate.  A null text and one without a letter go.  An empty table stays empty.
    """
    return _without(docs, language_of(docs).filter("rejected"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and are more probably good than not stay.

    The verdict is of the text alone, as in ``language_id``; a text of fewer than 50 words goes, and a very
    long one is judged whole.
    """
    return _without(docs, judge(docs).filter("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Of rows equal in ``doc_id`` and text one stays; rows that share the ``doc_id`` but not the text stay or go
    together.  Rows without an id are in no group, and stay but for repeated texts.  Texts without words stay.
    """
    keyed = docs.select(*docs.columns, text_key("text").alias(_KEY))
    # First, so that repeated rows shrink before the shuffle; the join finds them dealt out as it wants them.
    once = keyed.dropDuplicates(["doc_id", _KEY])
    gone = near_duplicates(docs).filter("NOT kept").select("doc_id", F.col("text_key").alias(_KEY)).distinct()
    return once.join(gone, ["doc_id", _KEY], "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, by their texts as in ``language_id``; without a benchmark all stay."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences; every row is packed, with or without text or id."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Model fitting and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
