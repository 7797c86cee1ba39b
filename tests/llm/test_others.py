import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, differences

from evstrata.llm import chat, decontaminate, licences, urls, warc
from evstrata.llm.queries import ORACLES, QUERIES
from evstrata.llm.shared import scratch_path, table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


# ---------------------------------------------------------------- WARC

HEAD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: "
TRAPS = [
    (1, "u", None), (2, "u", ""), (3, "u", HEAD + "3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"), (4, "a\r\nb", "pre WARC/1.1\r\nContent-Length: 100000\r\n\r\n" + "x" * 3000), (5, "u", "x" * 3000), (6, "u", "x" * 3000),
    (7, "u", "WARC/1.1\r\n"), (8, None, "é\r\n\r\n"), (9, "u", (HEAD + "0\r\n\r\n") * 300), (10, "u", "y" * 999), (11, "u", "y" * 999), *((k, "u", HEAD + "7\r\n\r\n" + chr(97 + k % 26) * k) for k in range(20, 120)),
]


def test_magic_in_payloads_is_rejected(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        path = scratch_path(spark, "traps")
        pages = spark.createDataFrame(TRAPS, "page_id bigint, url string, html string")
        warc.write_pages(pages.withColumn("digest", pages.url).repartition(3), path)
        rows = warc.read_archives(spark, path).collect()
        got = {r["page_id"]: r for r in rows}
        assert len(rows) == len(TRAPS)
        assert (got[5]["record_type"], got[5]["refers_to"]) == ("revisit", 6) and got[10]["record_type"] == got[11]["record_type"] == "response"
        for i, _, html in TRAPS:
            if i != 5:
                assert bytes(got[i]["payload"]) == (html or "").encode()
                assert got[i]["digest"] == hashlib.sha1((html or "").encode()).hexdigest()
        narrow = {r["page_id"]: r["digest"] for r in warc.read_archives(spark, path, payload=False).collect()}
        assert narrow == {i: r["digest"] for i, r in got.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_archive_of_many_pieces(spark):
    """A payload of thousands of magics, whose record reaches over many bins, beside repeated rows and null ids."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        big = "".join(f"{i} WARC/1.1\r\nContent-Length: {i}\r\n\r\n" + "é" * (i % 700) for i in range(6000))
        rows = [(1, "u", big), (2, "u", "plain"), (3, "u", "z" * 2000), (3, "u", "z" * 2000), (4, "u", "z" * 2000), (None, "u", "z" * 2000), (5, "u", big + "end")]
        path = scratch_path(spark, "pieces")
        warc.write_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
        got = warc.read_archives(spark, path).collect()
        payloads = sorted((bytes(r["payload"]) for r in got), key=len)
        assert payloads == sorted((b"" if (i, t[0]) == (3, "z") else t.encode() for i, _, t in rows), key=len)
        assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 4), (3, "revisit", 4), (4, "response", None), (None, "response", None), (5, "response", None)], key=str)
        assert sorted(r["digest"] for r in warc.read_archives(spark, path, payload=False).collect()) == sorted(r["digest"] for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_payload_beyond_what_a_value_holds_is_an_error(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes((HEAD + "3000000000\r\n\r\nabc\r\n\r\n").encode())
    with pytest.raises(Exception, match="payload of more than"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_corrupt_record_ends_the_chain(spark, tmp_path):
    good = HEAD + "3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes((good + good + HEAD + "5\r\n\r\nabc\r\n\r\n" + good).encode())
    # The third record is still reached; nothing after it is.
    assert sorted(r["start"] for r in warc.read_archives(spark, str(tmp_path / "a")).collect()) == [0, len(good), 2 * len(good)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(b"")
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archived(pages, scratch_path(spark, "none")).count() == 0


# ---------------------------------------------------------------- URLs


def test_rules_and_hosts(spark):
    cases = {
        "http://Example.COM/en/x": ("example.com", "/en/x", "example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "https://a.net/es/1?q": ("a.net", "/es/1", "net/es/", "block"),
        "https://a.com": ("a.com", "", None, "allow"), "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "ftp://x.org/cheap-pills/": ("x.org", "/cheap-pills/", None, "block"), "no scheme": ("", "", None, "allow"),
        "http://h?a://b/c": ("h", "", None, "allow"), "http://a.net/ES/1": ("a.net", "/ES/1", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] + [(99, None, "x", "y"), (0, next(iter(cases)), "x", "y")], "page_id bigint, url string, host string, target string")
    rows = urls.judge(pages).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(cases) + 2
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == ("", "", None, "allow")
    assert urls.judge(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    targets = spark.createDataFrame([("a", ["com", "example", "en"])] * 3 + [("b", ["com", "en"])] * 5, "target string, tokens array<string>")
    got = {r["name"]: r["token"] for r in urls.filed(targets, urls.rule_table(spark, urls.LISTED)).collect()}
    assert got["example.com/en/"] == "example" and got["com/"] == "com" and got["net/es/"] in ("net", "es")


def test_fetched_rules_decide_as_all_rules_do(spark, sf_dir):
    rng = np.random.default_rng(6)
    pages = [(r["page_id"], r["url"]) for r in table(spark, sf_dir, "pages").collect()] + [(-1, "http://x.org/a/" + "b/" * 20_000 + "casino"), (None, "http://casino.net/es/")]
    words = sorted({w for _, u in pages for w in re.split("[^a-z0-9]+", (u or "").lower()) if w})[:60]
    some = lambda: str(rng.choice(words))
    rules = urls.LISTED + urls.PATTERNS + (urls.UrlRule("all-digits", "block", r"(?s)/[0-9]+$", (), False), urls.UrlRule("nothing", "allow", "(?s).*", (), True))
    rules += tuple(urls.UrlRule.words("block", some(), some()) for _ in range(15)) + tuple(urls.UrlRule.place(str(rng.choice(["allow", "block"])), f"{some()}.{some()}", f"/{some()}") for _ in range(15))
    docs = spark.createDataFrame(pages, "page_id bigint, url string")
    got = sorted(((r["page_id"], r["rule"], r["verdict"], r["pattern_rule"]) for r in urls.judge(docs, rules).collect()), key=str)
    want = []
    for i, u in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        target = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) + m[2]) if m else ""
        fit = [r for r in rules if target and re.search(r.pattern, target)]
        best = max(((len(r.name), r.name, r.verdict) for r in fit if r.listed), default=None)
        pattern = min((r.name for r in fit if not r.listed and r.verdict == "block"), default=None)
        want.append((i, best and best[1], best[2] if best else "block" if pattern else "allow", pattern))
    assert got == sorted(want, key=str)


def test_rules_without_literals_and_from_files(spark, tmp_path):
    (tmp_path / "rules.tsv").write_text("# a comment\n\nblock\tplace\tExample.com/en/x\nallow\tplace\tnet\nblock\tpattern\t/[0-9]{4}/\nblock\tpattern\t[.-]shop[./]\tshop\n")
    rules = urls.read_rules(spark, str(tmp_path / "rules.tsv"))
    cases = {"http://a.example.com/en/xyz": ("example.com/en/x", "block"), "http://b.net/2020/": ("net", "allow"), "http://b.org/2020/": (None, "block"), "http://my.shop/": (None, "block"), "http://my.shopping/": (None, "allow"), "http://exampleXcom/en/x": (None, "allow")}
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    assert [(r["rule"], r["verdict"]) for r in urls.judge(pages, rules).orderBy("page_id").collect()] == list(cases.values())
    everything = (urls.UrlRule("everything", "block", ".*", (), False),)
    assert {r["verdict"] for r in urls.judge(pages, everything).collect()} == {"block"}
    assert {r["verdict"] for r in urls.judge(pages, ()).collect()} == {"allow"}
    (tmp_path / "bad.tsv").write_text("deny\tplace\tx.org\n")
    with pytest.raises(Exception, match="not a rule"):
        urls.judge(pages, urls.read_rules(spark, str(tmp_path / "bad.tsv"))).collect()


# ---------------------------------------------------------------- decontamination


def longest_stretch(flags):
    """Most matches of a stretch that begins and ends at one and of which three quarters match, by trying all."""
    at = [i for i, f in enumerate(flags) if f]
    best = 0
    for i, a in enumerate(at):
        for j in range(len(at) - 1, i + best - 1, -1):
            if 4 * (j - i + 1) >= 3 * (at[j] - a + 1):
                best = max(best, j - i + 1)
                break
    return best


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def best_overlap(doc, item):
    """The most matches over all diagonals, word by word."""
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        best = max(best, longest_stretch([0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]))
    return best


def test_overlaps_equal_brute_force(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = {r["item_id"]: words_of(r["text"]) for r in bench.collect()}
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    for r in docs.collect():
        d = words_of(r["text"])
        have = set(d)
        # Fewer than twelve words in common cannot make an overlap of twelve.
        near = {i: best_overlap(d, w) for i, w in items.items() if sum(x in have for x in w) >= 12 and len(set(w) & have) >= 6}
        want = {i: n for i, n in near.items() if n >= 12}
        assert got[r["doc_id"]]["item_ids"] == sorted(want) and got[r["doc_id"]]["matched_words"] == max(want.values(), default=0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=60))
def test_stretches_equal_all_stretches(flags):
    rule = decontaminate.SeedRule()
    item = np.arange(len(flags), dtype=np.uint64)
    doc = np.where(np.array(flags, bool), item, np.uint64(1000)) if flags else item
    matched, first, last = decontaminate.overlap(doc, item, 0, rule)
    assert matched == longest_stretch(flags)
    if matched:
        assert flags[first] and flags[last] and sum(flags[first : last + 1]) == matched and 4 * matched >= 3 * (last - first + 1)


def test_long_items_take_no_longer_than_they_are(spark):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 5000, 20_000)
    changed = np.where(rng.random(20_000) < 0.3, 9999, words)
    began = time.time()
    matched, _, _ = decontaminate.overlap(changed.astype(np.uint64), words.astype(np.uint64), 0, decontaminate.SeedRule())
    assert matched >= 12 and time.time() - began < 1
    text = lambda w: " ".join(f"w{x}" for x in w)
    docs = spark.createDataFrame([(1, text(changed)), (2, text(rng.integers(6000, 9000, 20_000)))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, text(words))], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_ids"]) for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [(1, [7]), (2, [])]


@pytest.mark.parametrize("n", range(1, 20))
def test_one_substitution_in_short_items(n, spark):
    rule = decontaminate.SeedRule()
    item = [f"b{i}" for i in range(n)]
    docs = [(0, " ".join(["x", *item, "y"]))] + [(k + 1, " ".join(["x", *item[:k], "zzz", *item[k + 1 :], "y"])) for k in range(n)]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()}
    for i, text in docs:
        assert got[i] == (best_overlap(text.split(), item) >= min(12, n - n // 8) == rule.needed(n)), (n, i)


def test_null_and_repeated_ids_are_judged_by_text(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (1, item), (1, "clean words"), (None, "clean"), (2, None)], "doc_id bigint, text string").withColumn("text_key", table_column())
    bench = spark.createDataFrame([(4, item), (3, item.upper()), (None, "c " + item)], "item_id bigint, text string").withColumn("item", table_column())
    rows = sorted(((r["doc_id"], r["contaminated"], r["item_ids"]) for r in decontaminate.decontaminate(docs, bench).collect()), key=str)
    assert rows == sorted([(None, True, [3, 4]), (1, True, [3, 4]), (1, False, []), (None, False, []), (2, False, [])], key=str)
    nameless = decontaminate.decontaminate(docs, bench.filter("item_id is null"))
    assert sorted((r["contaminated"], r["item_ids"]) for r in nameless.collect()) == [(False, [])] * 3 + [(True, [])] * 2


def test_substitutions_and_edges(spark, edge_docs, no_docs):
    item = [f"b{i}" for i in range(30)]
    changed = [w if i % 8 else "zzz" for i, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "two words"), (4, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "some " * 20 + " ".join(item) + " more"), (2, "x y " + " ".join(changed)), (3, " ".join(item[:8]) + " other words"), (4, "here are TWO\nwords too"), (5, None), (1, "some " * 20 + " ".join(item) + " more")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["contaminated"], r["item_ids"]) for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()]
    assert got == [(1, True, [1]), (1, True, [1]), (2, True, [1]), (3, False, []), (4, True, [3]), (5, False, [])]
    assert decontaminate.decontaminate(edge_docs, bench).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(edge_docs, bench).count() == edge_docs.count()
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


# ---------------------------------------------------------------- licences


def test_notices_and_other_sentences(spark):
    texts = [(i, f"Some text before.\n{t}\nmore text", f) for i, (f, ts) in enumerate(licences.NOTICES.items()) for t in ts]
    docs = spark.createDataFrame([(k, t, f) for k, (_, t, f) in enumerate(texts)], "doc_id bigint, text string, family string")
    rows = licences.scan_licences(docs).join(docs.select("doc_id", "family"), "doc_id").collect()
    assert all(r["families"] == r["family"] and r["n_confirmed"] == 1 for r in rows)
    others = spark.createDataFrame(list(enumerate(licences.OTHERS)), "doc_id bigint, text string")
    assert licences.scan_licences(others).filter("families <> ''").count() == 0


def test_planted_lines_are_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r["families"] for r in licences.scan_licences(docs).collect()}
    lines = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "All rights reserved.": "proprietary"}
    for r in docs.collect():
        want = {f for line, f in lines.items() if line in r["text"].split("\n")}
        assert set(filter(None, got[r["doc_id"]].split(","))) == want


def test_licence_edges(edge_docs, no_docs):
    assert licences.scan_licences(edge_docs).filter("families = '' and n_licence_paragraphs = 0").count() == edge_docs.count()
    assert licences.scan_licences(no_docs).count() == 0


# ---------------------------------------------------------------- chat


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"), (2, 0, "system", "alone"), (None, None, "ann", "y"), (None, 300, "bob", "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("block", table_column())
    out = chat.rotate(turns)
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(out).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "bob")}
    ann = whole[(1, "ann")]
    assert ann["dialogue"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user|>bob\n<|end|>\n<|user|>bob\n<|end|>\n<|user|>unknown\nx<|end|>\n"
    assert [ann["dialogue"][m["start"] : m["start"] + m["length"]] for m in ann["masks"]] == ["hi < |end|><|end|>"]
    assert whole[(None, "bob")]["dialogue"] == "<|user|>ann\ny<|end|>\n<|assistant|>\nz<|end|>\n"
    for r in out.collect():
        text = whole[(r["conv_id"], r["perspective"])]["dialogue"]
        assert text[r["start"] : r["start"] + len(r["rendered"])] == r["rendered"]
    assert chat.rotate(turns.limit(0)).count() == 0


def test_turns_of_equal_and_missing_number(spark):
    """Dialogues hold every row once and without gaps, whatever the turns are; a very long text among them."""
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(2)) or None, [None, 1, 1, 400, int(rng.integers(2000))][int(rng.integers(5))], ["ann", "bob", "system", None][int(rng.integers(4))], "t" * int(rng.integers(4))) for _ in range(600)]
    rows += [(1, None, "ann", "same")] * 50 + [(1, 7, "bob", "long " * 100_000)]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert out.columns == ["conv_id", "perspective", "turn", "role", "rendered", "start", "mask_start", "mask_length"]
    found = {}
    for r in out.collect():
        found.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(found) == {(c, p) for c in (1, None) for p in ("ann", "bob", "unknown")}
    for (conv, person), turns in found.items():
        turns.sort(key=lambda r: r["start"])
        at = 0
        for r in turns:
            assert r["start"] == at and (r["mask_start"] is not None) == (r["role"] == person)
            at += len(r["rendered"])
        order = [(-1 if r["turn"] is None else r["turn"], r["role"]) for r in turns]
        assert order == sorted(order)
        mine = [(t, q or "unknown") for c, t, q, _ in rows if c == conv]
        assert sorted(map(str, mine)) == sorted(str((r["turn"], r["role"])) for r in turns)


def table_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0.5 * seen < docs.count() <= seen
        seen = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in pipeline.run(spark, sf_dir).collect()} == ids


def test_pipeline_of_edges(spark, sf_dir, edge_docs, no_docs):
    import corpus_pipeline as pipeline

    for docs in (edge_docs, no_docs):
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= 100 * max(1, docs.count())
