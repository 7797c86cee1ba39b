"""Chat formatting by multi-party perspective rotation (operator 10).

Every speaker of a conversation in turn is the assistant of a dialogue in which the others are named
users, and only that speaker's words are trained on.  The result has one row per conversation,
perspective and turn, with the place of the turn's text in the rendered dialogue, so that even a
conversation that holds a large part of all rows is never gathered in one task: offsets are sums
over blocks of turns, and inside a block over its turns, roles and 256 parts by digest, so that
turns of equal or missing number are dealt out, too.

Defined results: ``system`` turns are rendered in every perspective and are nobody's; a conversation
of system turns alone has no perspective and no rows; a null role speaks as ``unknown``, a null text
is empty, null conversation ids are one conversation and null turns come first; turns of equal
number are ordered by role and by a digest of what is rendered, and repeated rows are rendered each;
marks of the template inside texts and names are broken up; texts are rendered whole, however long; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

#: Turns whose lengths are summed in one window.
BLOCK_TURNS = 256
END = "<|end|>\n"
_FIRST = -(2**62)


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which nulls are equal."""
    named = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, same).drop(*(f"_{k}" for k in keys))


def rotate(conversations: DataFrame) -> DataFrame:
    """``conv_id, perspective, turn, role, rendered, start, mask_start, mask_length`` by code points of the dialogue."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), _plain(F.col("text")).alias("text"))
    speakers = rows.filter("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers")).withColumnRenamed("conv_id", "conv")
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", "turn", "role", "text", F.explode("speakers").alias("perspective"))
    mine = F.col("role") == F.col("perspective")
    name = F.replace(F.replace(F.col("role"), F.lit("<|"), F.lit("< |")), F.lit("\n"), F.lit(" "))
    head = F.when(F.col("role") == "system", "<|system|>\n").when(mine, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user|>"), name, F.lit("\n")))
    seen = seen.select("conv_id", "perspective", "turn", "role", F.length(head).alias("lead"), mine.alias("mine"), F.length("text").alias("words"), F.concat(head, F.col("text"), F.lit(END)).alias("rendered"))
    seen = seen.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), F.lit(_FIRST)))
    seen = seen.withColumn("digest", F.md5("rendered")).withColumn("part", F.substring("digest", 1, 2))
    size = F.length("rendered").cast("long")
    keys = ["conv_id", "perspective", "block", "turn", "role", "part"]
    upto = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c)
    parts = seen.groupBy(*keys).agg(F.sum(size).alias("total"))
    parts = parts.withColumn("inner", upto("total", Window.partitionBy(*keys[:3]).orderBy(F.col("turn").asc_nulls_first(), "role", "part")))
    blocks = parts.groupBy(*keys[:3]).agg(F.sum("total").alias("whole"))
    blocks = blocks.withColumn("base", upto("whole", Window.partitionBy(*keys[:2]).orderBy("block")))
    parts = _beside(parts, blocks.select(*keys[:3], "base"), keys[:3]).select(*keys, (F.col("base") + F.col("inner")).alias("base"))
    local = seen.withColumn("size", size).withColumn("before", upto("size", Window.partitionBy(*keys).orderBy("digest", "rendered")))
    out = _beside(local, parts, keys).withColumn("start", F.col("base") + F.col("before"))
    # The closing mark is learned with the words before it.
    return out.select("conv_id", "perspective", "turn", "role", "rendered", "start", F.when(F.col("mine"), F.col("start") + F.col("lead")).alias("mask_start"), F.when(F.col("mine"), F.col("words") + len(END) - 1).otherwise(0).cast("long").alias("mask_length"))


def dialogues(rotated: DataFrame) -> DataFrame:
    """Whole dialogues with their masks, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "rendered", "mask_start", "mask_length")))
    out = rotated.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    masks = F.transform(F.filter("parts", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_length"].alias("length")))
    return out.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda x: x["rendered"]), "").alias("dialogue"), masks.alias("masks"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
with r as (select conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
s as (select distinct conv_id as conv, role as perspective from r where role <> 'system'),
h as (select conv_id, perspective, turn, role, text,
        case when role = 'system' then '<|system|>' || chr(10) when role = perspective then '<|assistant|>' || chr(10)
             else '<|user|>' || replace(replace(role, '<|', '< |'), chr(10), ' ') || chr(10) end as head
      from r join s on conv_id is not distinct from conv),
t as (select *, head || text || '<|end|>' || chr(10) as rendered from h),
o as (select *, cast(sum(length(rendered)) over (partition by conv_id, perspective order by turn nulls first, role, md5(rendered), rendered rows unbounded preceding) - length(rendered) as bigint) as start from t)
select conv_id, perspective, turn, role, rendered, start,
  case when role = perspective then start + length(head) end as mask_start,
  cast(case when role = perspective then length(text) + 8 - 1 else 0 end as bigint) as mask_length
from o
"""
