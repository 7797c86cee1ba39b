"""WARC archives written and read with boundary-chain verification (operator 1).

A reader task may start anywhere in a file, where the magic ``WARC/1.1`` can be payload.  So every
task only proposes: each place with the magic is a candidate with the offset where its record would
end.  Candidates in a row that confirm each other form runs; pointer jumping over the runs from the
start of the file keeps what the chain of records really reaches, and magic inside payloads drops out.

The text reader splits files at the magic, so proposals need one pass and offsets are running sums
of lengths.  Payloads are digested where they are read; only those that contain the magic, known
after verification, are put together from their pieces.

Defined results: a null payload is empty; of equal payloads the record of the largest ``page_id`` is
the response, and of rows that share it each is one; a null ``page_id`` is neither revisit nor referred
to; a payload may be as long as a value can be, 2^31 - 1 bytes, and a longer one in an archive is an
error; a corrupt record ends its file's chain, and what follows is not returned; an empty archive gives
no records; an empty table gives an empty result; repeated pages make a record each; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, drop_path, scratch_path, small, table

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
#: Bytes of a file by which pieces find the record they belong to.
BIN = 1 << 20
LONGEST = 2**31 - 1


def _urn(page: Column) -> Column:
    d = F.md5(page.cast("string").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(d, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = REVISIT_BYTES) -> None:
    """One record per row of ``page_id, url, html``: of equal payloads from ``least`` bytes the largest page's is kept."""
    salts = 32
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), body.alias("body"), F.sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).alias("size"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("low")).filter("low < kept")
    # A digest may be shared by a large part of all pages: its group is repeated for every salt.
    groups = groups.select("digest", "kept", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    narrow = rows.filter(F.col("size") >= least).select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int").alias("salt"))
    again = cut(narrow.join(groups, ["digest", "salt"]).filter("page_id < kept").select("page_id", "digest", "kept").distinct(), "revisits")
    out = rows.join(small(again), ["page_id", "digest"], "left")
    revisit = F.col("kept").isNotNull()
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), F.coalesce(_urn(F.col("page_id")), F.lit("<urn:uuid:none>")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("kept")), F.lit("\r\nX-Refers-To-Page: "), F.col("kept").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, 0).otherwise(F.col("size")).cast("string"),
        F.lit(BREAK),
    )
    # The text writer ends every value with its line separator, which is what ends a record.
    out.select(F.concat(head, F.when(revisit, "").otherwise(F.col("body"))).alias("value")).write.option("lineSep", BREAK).text(path)


def _pieces(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """What lies between occurrences of the magic, in order: file, split, place in the split, length and proposal."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    raw = raw.select("file", "block", "id", F.octet_length("value").cast("long").alias("size"), F.substring_index("value", BREAK, 1).alias("head"), F.col("value").cast("binary").alias("bytes"))
    length = F.expr(r"try_cast(nullif(regexp_extract(head, '(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]+)', 1), '') as bigint)")
    raw = raw.withColumn("length", F.when(F.octet_length("head") < F.col("size"), length)).withColumn("body_at", F.octet_length("head") + len(BREAK))
    body = F.expr("substring(bytes, cast(body_at + 1 as int), cast(least(length, 2147483647) as int))")
    raw = raw.withColumn("digest", F.when(F.col("length").isNotNull(), F.sha1(body)))
    return raw.select("file", "block", "id", "size", "head", "length", "body_at", "digest", *(["bytes"] if payload else []))


def _with_offsets(pieces: DataFrame) -> DataFrame:
    """Add ``start``, the offset of the magic before each piece; the text before a file's first magic starts at minus its length.

    The pieces are written first: how files are split may change when executors come and go, and places
    and lengths have to come from one and the same reading.
    """
    pieces = cut(pieces, "pieces")
    inside = Window.partitionBy("file", "block").orderBy("id")
    step = F.col("size") + len(MAGIC)
    local = pieces.withColumn("before", F.sum(step).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - step)
    splits = pieces.groupBy("file", "block").agg(F.sum(step).alias("total"))
    splits = splits.select("file", "block", (F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")).alias("base"))
    return local.join(small(splits), ["file", "block"]).withColumn("start", F.col("base") + F.col("before") - len(MAGIC)).drop("before", "base")


def _reached(candidates: DataFrame) -> DataFrame:
    """Of candidates ``file, block, start, next`` those that the chain from the file's start reaches.

    Within a split, candidates whose ``next`` is the following candidate join into runs; a run is entered
    somewhere and left at its end, so pointers lead from run to run and are doubled until none moves.
    """
    inside = Window.partitionBy("file", "block").orderBy("start")
    broken = F.coalesce(F.lag("next").over(inside) != F.col("start"), F.lit(True))
    runs = candidates.withColumn("run", F.max(F.when(broken, F.col("start"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = cut(runs, "runs")
    ends = runs.groupBy("file", "run").agg(F.max_by("next", "start").alias("next"))
    # The run that each exit lands in, and where in it.
    place = runs.select("file", F.col("start").alias("next"), F.col("run").alias("to_run"))
    hops = cut(ends.join(place, ["file", "next"]).select("file", "run", "to_run", F.col("next").alias("entry")), "hops")
    entered = runs.filter("start = 0").select("file", "run", F.col("start").alias("entry"))
    entered, jump = cut(entered, "entered"), hops
    while True:
        # What is entered so far, and all that 2 ** i hops lead to from there.
        more = entered.join(jump, ["file", "run"]).select("file", F.col("to_run").alias("run"), jump["entry"].alias("entry"))
        after = cut(entered.unionByName(more).groupBy("file", "run").agg(F.min("entry").alias("entry")), "entered")
        if after.count() == entered.count():
            break
        entered = after
        on = jump.select("file", "run", F.col("to_run").alias("via"))
        to = jump.select("file", F.col("run").alias("via"), "to_run", "entry")
        jump = cut(on.join(to, ["file", "via"]).select("file", "run", "to_run", "entry"), "jump")
    # Runs of a verified chain are entered once: two records cannot lead to one offset.
    return runs.join(entered, ["file", "run"]).filter("start >= entry").select("file", "block", "start", "next")


def _header(name: str) -> Column:
    return F.expr(rf"nullif(regexp_extract(head, '(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)', 1), '')")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``: file, start, headers of interest, payload digest and length.

    With ``payload`` also the payload; without it payloads are only digested and never shuffled.
    """
    facts = cut(_with_offsets(_pieces(spark, path, False)), "facts")
    candidates = facts.filter("length is not null and start >= 0").withColumn("next", F.col("start") + len(MAGIC) + F.col("body_at") + F.col("length") + len(BREAK))
    reached = cut(_reached(candidates.select("file", "block", "start", "next")), "reached")
    # Pieces that end before their record does are continued by the pieces after them.
    records = candidates.join(reached.select("file", "start"), ["file", "start"])
    too_long = F.raise_error(F.concat(F.lit("payload of more than 2^31 - 1 bytes in "), "file"))
    records = records.withColumn("length", F.when(F.col("length") > LONGEST, too_long).otherwise(F.col("length")))
    # The last record of a file may lack its final break.
    whole = F.col("start") + len(MAGIC) + F.col("size") >= F.col("next") - len(BREAK)
    columns = ["file", "start", "length", "head", "digest"]
    if payload:
        own = _with_offsets(_pieces(spark, path, True)).select("file", "start", "bytes")
        single = records.filter(whole).join(own, ["file", "start"]).withColumn("payload", F.expr("substring(bytes, cast(body_at + 1 as int), cast(length as int))")).select(*columns, "payload")
    else:
        single = records.filter(whole).select(*columns)
    split = cut(records.filter(~whole).select("file", "start", "next", "body_at", "length", "head"), "split")
    if not split.isEmpty():
        single = single.unionByName(_joined(spark, path, split, columns + (["payload"] if payload else [])))
    return single.select(
        "file", "start", _header("WARC-Type").alias("record_type"), _header("WARC-Record-ID").alias("record_id"), _header("WARC-Target-URI").alias("url"), _header("WARC-Payload-Digest").alias("stated_digest"),
        F.expr(r"try_cast(regexp_extract(head, '(?i)\r\nX-Payload-Length:[ \t]*([0-9]+)', 1) as bigint)").alias("stated_length"),
        F.expr(r"try_cast(nullif(regexp_extract(head, '(?i)\r\nX-Page-Id:[ \t]*(-?[0-9]+)', 1), '') as bigint)").alias("page_id"),
        F.expr(r"try_cast(nullif(regexp_extract(head, '(?i)\r\nX-Refers-To-Page:[ \t]*(-?[0-9]+)', 1), '') as bigint)").alias("refers_to"),
        "length", "digest", *(["payload"] if payload else []),
    )


def _joined(spark: SparkSession, path: str, split: DataFrame, columns: list[str]) -> DataFrame:
    """Records whose payload holds the magic, put together from their pieces; only their files are read again."""
    pieces = _pieces(spark, path, True).join(small(split.select("file").distinct()), "file", "left_semi")
    pieces = _with_offsets(pieces).select("file", "start", "bytes")
    # A piece belongs to the record whose bytes it starts among; a record is listed in every bin that it reaches into.
    spans = split.select("file", F.col("start").alias("owner"), F.col("next").alias("end"), F.explode(F.sequence(F.expr(f"start div {BIN}"), F.expr(f"(next - 1) div {BIN}"))).alias("bin"))
    owned = pieces.withColumn("bin", F.expr(f"start div {BIN}")).join(spans, ["file", "bin"]).filter("start >= owner and start < end")
    glued = owned.groupBy("file", F.col("owner").alias("start")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("at"), F.col("bytes").cast("string").alias("text")))).alias("parts"))
    # Bytes stay what they are in a string, and joining an array copies each once.
    text = F.array_join(F.transform("parts", lambda x: x["text"]), MAGIC).cast("binary")
    out = split.join(glued, ["file", "start"]).withColumn("payload", F.substring(text, F.col("body_at").cast("int") + 1, F.col("length").cast("int")))
    return out.withColumn("digest", F.sha1("payload")).select(*columns)


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` under ``path``, read them back, and report each page's record."""
    write_pages(pages, path)
    found = read_archives(pages.sparkSession, path, payload=False)
    revisit = F.col("record_type") == "revisit"
    return found.select(
        "page_id", F.when(revisit, F.col("stated_length")).otherwise(F.col("length")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.substring_index("stated_digest", ":", -1)).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )


def op1_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    out = cut(archived(table(spark, sf_dir, "pages"), path), "records")
    drop_path(spark, path)
    return out


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
r as (select *, max(page_id) over (partition by payload_digest) as kept from q)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < kept then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < kept then kept end as refers_to
from r
"""
