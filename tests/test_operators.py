import datetime
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evstrata.functions import text
from evstrata.functions.keys import EventID
from evstrata.operators import combine, lookup, output, ranges, report, sampling, scan, select
from evstrata.sources.tables import read_files

RANGES = "array<struct<subrun:int,begin:bigint,end:bigint>>"


def events(spark, rows, columns="run int, subrun int, event bigint, entry bigint, file_no int"):
    return spark.createDataFrame(rows, columns)


def test_event_ids():
    assert EventID.parse(" 1:2 : 3") == EventID(1, 2, 3)
    assert EventID.parse("") is None
    assert EventID(1, 2, 3) < EventID(1, 3, 0) < EventID(2, 0, 0)
    assert EventID(1, 2, 3).next() == EventID(1, 2, 4)
    for bad in ("1:2", "1:2:x", "1:2:3:4"):
        with pytest.raises(ValueError):
            EventID.parse(bad)


def test_closing_criteria():
    assert not output.ClosingCriteria(events=5, age_s=100).reached(events=4, age_s=99)
    assert output.ClosingCriteria(events=5, age_s=100).reached(age_s=100)
    assert not output.ClosingCriteria().reached(events=10**9)


def test_switching_by_event_gives_five_and_four(spark):
    rows = events(spark, [(1, 0, i, i, 0) for i in range(9)])
    counts = output.switch_by_event(rows, 5).groupBy("output_file").count().orderBy("output_file").collect()
    assert [r["count"] for r in counts] == [5, 4]


def test_switching_by_subrun_gives_six_and_three(spark):
    rows = events(spark, [(1, i // 6, i, i, 0) for i in range(9)])
    got = output.switch_by_subrun(rows, 5).orderBy("subrun").collect()
    assert [(r["events"], r["output_file"]) for r in got] == [(6, 1), (3, 2)]


def test_switching_by_any_criterion(spark):
    # input file, run, sub-run, events, KiB, seconds
    rows = [(0, 1, 0, 4, 10, 1), (0, 1, 1, 4, 10, 1), (0, 2, 0, 4, 90, 1), (1, 2, 0, 1, 1, 1), (1, 2, 1, 1, 1, 100), (2, 3, 0, 1, 1, 1)]
    parts = spark.createDataFrame(rows, "input_file int, run int, subrun int, events bigint, size_kib bigint, seconds bigint")

    def files(at="subrun", **limits):
        got = output.switch_files(parts, output.ClosingCriteria(**limits), at).orderBy("input_file", "run", "subrun").collect()
        return [r["output_file"] for r in got]

    assert files() == [1] * 6
    assert files(events=8) == [1, 1, 2, 2, 2, 2]
    assert files(subruns=1) == [1, 2, 3, 3, 4, 5]
    assert files(runs=2) == [1, 1, 1, 1, 2, 2]
    assert files(input_files=2) == [1, 1, 1, 1, 2, 2]
    assert files(size_kib=100) == [1, 1, 1, 2, 2, 2]
    assert files(age_s=100) == [1, 1, 1, 1, 1, 2]
    assert files("run", subruns=1) == [1, 1, 2, 2, 2, 3]
    assert files("input_file", events=1) == [1, 1, 1, 2, 2, 3]
    assert output.switch_files(parts.limit(0), output.ClosingCriteria(events=1)).count() == 0


# Severity, place, message and class as the handler is known to treat them.
TRUTH = [
    (3000, "Fill", "attempt to fill branch foo while addresss is not set", "throw"), (3000, "TCling::AutoParse", 'Error parsing payload code for class foo with content:\n\n#line 1 "lib_some_dict dictionary payload"', "throw"), (3000, "TNetXNGFile::Open", "[FATAL]", "throw"),
    (1000, "A::B", "Richard Strauss was a German composer", "info"), (3000, "TClass::TClass", "no dictionary for class x::Transient<x::ProductRegistry::Transients> is available", "suppress"), (3000, "TClass::TClass", "no dictionary for class x::DoNotRecordParents is available", "suppress"),
    (3000, "TTree::ReadStream", "Ignoring trailing stuff while reading data", "info"), (3000, "TBranchElement::Bronch", "Cannot find dictionary for class foo", "info"), (3000, "TClassTable::Add", "class foo already in TClassTable", "info"), (3000, "TUnixSystem::DispatchSignals", "SIGUSR2", "error"),
    (3000, "TUnixSystem::SetDisplay", "DISPLAY not set", "info"), (3000, "TUnixSystem::GetHostByName", "getaddrinfo failed: Temporary failure in name resolution", "info"), (3000, "TNetXNGFile::Open", "[INFO]", "info"), (3000, "TF1::SetFitResult", "Invalid Fit result passed", "info"),
    (3000, "TDecompChol::Solve", "matrix is singular", "info"), (3000, "THistPainter::PaintInit", "cannot set x axis to log scale", "info"), (3000, "TGClient::GetFontByName", "couldn't retrieve font", "info"), (0, "A::B", "This is less important than information", "info"), (2000, None, None, "throw"),
]


def test_message_classes(spark):
    rows = spark.createDataFrame([t[:3] for t in TRUTH], "severity int, place string, message string")
    got = rows.select(text.classify(F.col("severity"), F.col("place"), F.col("message"))).collect()
    assert [r[0] for r in got] == [t[3] for t in TRUTH]


def test_json_values_are_json(spark):
    values = ["a\nb", "tab\there", "\x01\x1f", 'q"\\', "é", "", "12", "nan", "x}"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.json_value(F.col("v"))).collect()]
    assert [json.loads(g) for g in got] == [12 if v == "12" else v for v in values]


def test_letters_go_on(spark):
    from evstrata.operators import provenance

    got = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 53, 702, 703, 18278)], "n bigint").select(provenance.letters(F.col("n"))).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ"]


def test_provenance_of_ancestors(spark):
    from evstrata.operators import provenance as p

    # 4 is selected; 4 <- 3 <- 2 <- 1, and 4 <- 9 of which nothing is known; 1 comes from the input, 3 has no provenance in entry 2.
    stored = spark.createDataFrame([(e, i, "present", parents) for e in (1, 2) for i, parents in ((4, [3, 9]), (3, [2]), (2, [1]), (1, [0])) if (e, i) != (2, 3)], "entry bigint, product_id bigint, status string, parents array<bigint>")
    known = spark.createDataFrame([(1, False), (2, True), (3, True), (4, True), (5, False)], "product_id bigint, produced boolean")
    chosen = spark.createDataFrame([(1, 4), (2, 4), (1, 5)], "entry bigint, product_id bigint")

    def got(**options):
        kept, described = p.kept_provenance(chosen, known, stored, **options)
        return sorted((r["entry"], r["product_id"], r["status"]) for r in kept.collect()), sorted(r[0] for r in described.distinct().collect())

    assert got() == ([(1, 2, "present"), (1, 3, "present"), (1, 4, "present"), (1, 5, "dropped"), (2, 4, "present")], [1, 2, 3, 4, 5])
    assert got(drop=p.PRIOR) == ([(1, 4, "present"), (2, 4, "present")], [3, 4, 5])
    assert got(drop=p.ALL) == ([], [4, 5])
    assert got(drop_for_dropped=True) == ([(1, 4, "present"), (1, 5, "dropped"), (2, 4, "present")], [4, 5])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1), st.integers(0, 8), st.integers(1, 4)), max_size=14))
def test_relation_counts_equal_pairs(spark, parts):
    rows = spark.createDataFrame([(f, 1, s, b, b + n) for f, s, b, n in parts], "file_no int, run int, subrun int, begin bigint, end bigint")
    want = {s: [0, 0, 0] for _, s, _, _ in parts}
    for i, (f, s, b, n) in enumerate(parts):
        for g, t, c, m in parts[:i]:
            if s == t and f != g:
                want[s][0 if (b, n) == (c, m) else 1 if b < c + m and c < b + n else 2] += 1
    assert {r["subrun"]: [r["same"], r["overlap"], r["disjoint"]] for r in ranges.relation_counts(rows).collect()} == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 9)), max_size=14, unique=True), st.integers(-4, 4))
def test_offsets_and_skips(spark, ids, offset):
    rows = spark.createDataFrame(ids, "run int, subrun int, event bigint")
    order = sorted(ids)
    want = {i: order[k + offset] if 0 <= k + offset < len(order) else (None,) * 3 for k, i in enumerate(order)}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in scan.seek_offset(rows, offset).collect()} == want
    assert sorted(map(tuple, scan.skip_and_limit(rows, abs(offset), 3).collect())) == order[abs(offset) : abs(offset) + 3]
    assert sorted(map(tuple, scan.skip_and_limit(rows, abs(offset)).collect())) == order[abs(offset) :]


def test_old_files_stand_for_the_whole(spark):
    rows = [("p", 0, 8, "explicit", A, 2.0), ("p", 1, 15, "explicit", B, 3.0), ("q", 0, 15, "explicit", A, 2.0), ("q", 1, 8, "explicit", B, 3.0)]
    fragments = spark.createDataFrame(rows, f"product string, entry bigint, version int, kind string, ranges {RANGES}, value double")
    got = {r["product"]: (r["kind"], r["value"]) for r in combine.combine_fragments(combine.first_of_old_files(fragments, ("product",), "run"), ("product",)).collect()}
    assert got == {"p": ("full_run", 2.0), "q": ("explicit", 5.0)}


def test_user_merges_and_long_arrays(spark):
    n = 2000
    rows = [("p", 0, "explicit", [(0, 4 * i, 4 * i + 1) for i in range(n)], 2.0), ("p", 1, "explicit", [(0, 4 * i + 1, 4 * i + 2) for i in range(n)], 3.0)]
    r = combine.combine_fragments(spark.createDataFrame(rows, f"product string, entry bigint, kind string, ranges {RANGES}, value double"), ("product",), lambda a, b: a * b).first()
    assert r["value"] == 6.0 and [tuple(x) for x in r["ranges"]] == [(0, 4 * i, 4 * i + 2) for i in range(n)]


def test_plugins_add_metadata(spark):
    import datetime as d

    rows = spark.createDataFrame([(1, 0, 1, 0, 0, d.datetime(2024, 1, 1))], "run int, subrun int, event bigint, entry bigint, file_no int, ts timestamp")
    got = {r["name"]: r["value"] for r in output.catalog_metadata(rows, plugins=(lambda e: {"n": str(e.count()), "event_count": "0"},), extra={"n": "given"}).collect()}
    assert got["n"] == "given" and got["event_count"] == "0"


def test_range_sets_of_several_files(spark):
    schema = "part int, run int, subrun int, begin bigint, end bigint"
    rows = [(0, 1, 0, 1, 5), (0, 1, 1, 1, 3), (1, 1, 0, 5, 9), (2, 1, 0, 20, 22)]
    got = ranges.merge_range_sets(spark.createDataFrame([("s", *r) for r in rows], "s string, " + schema), ("s",), "part", compact=True)
    assert sorted((r["subrun"], r["begin"], r["end"]) for r in got.collect()) == [(0, 1, 22), (1, 1, 3)]
    full = ranges.merge_range_sets(spark.createDataFrame([("s", *r) for r in rows], "s string, " + schema), ("s",), "part")
    assert full.count() == 4
    # Between what was gathered already, and of another run.
    for bad, text_ in (((3, 1, 0, 10, 12), "meet in sub-run 0"), ((3, 2, 0, 30, 31), "different runs: 1 and 2")):
        with pytest.raises(Exception, match=text_):
            ranges.merge_range_sets(spark.createDataFrame([("s", *r) for r in [*rows, bad]], "s string, " + schema), ("s",), "part", compact=True).collect()


def test_mixing_and_order_errors(spark):
    with pytest.raises(LookupError, match="no product Int_x"):
        lookup.resolve_products({"Int_m__P": "a"}, ["Int_x_*_*"])
    assert lookup.resolve_products({"Int_m__P": "a", "Int_m__Q": "b"}, ["Int_m__*"]) == {"Int_m__*": "b"}
    with pytest.raises(ValueError):
        scan.unsorted_order(events(spark, COPIES), EventID(1, 0, 1))
    assert sampling.configuration([sampling.DataSet("b", 1.0, "1:2:3"), sampling.DataSet("a", 3.0)]) == [("a", 3.0, 0.75, "(first event)"), ("b", 1.0, 0.25, "1:2:3")]
    assert spark.range(1).select(combine.dummy_product("array<int>").alias("d")).schema["d"].dataType.simpleString() == "array<int>"


def test_begin_time_of_what_follows(spark):
    t = [datetime.datetime(2024, 1, 1, h) for h in range(5)]
    e = spark.createDataFrame([(1, 1, 1, t[1]), (1, 1, 2, t[0]), (3, 0, 1, t[3])], "run int, subrun int, event bigint, ts timestamp")
    c = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, None), (2, 0, None), (3, 0, t[4]), (3, 1, None)], "run int, subrun int, begin_ts timestamp")
    got = {(r["run"], r["subrun"]): r["begin_ts"] for r in select.fill_begin_time(c, e, ("run", "subrun")).collect()}
    assert got == {(1, 0): t[1], (1, 1): t[1], (1, 2): t[3], (2, 0): t[3], (3, 0): t[4], (3, 1): None}
    runs = spark.createDataFrame([(0, None), (1, None), (2, None), (4, None)], "run int, begin_ts timestamp")
    assert {r["run"]: r["begin_ts"] for r in select.fill_begin_time(runs, e, ("run",)).collect()} == {0: t[1], 1: t[1], 2: t[3], 4: None}


def test_switching_names_need_a_number():
    with pytest.raises(ValueError):
        text.check_name_pattern("out.root", switching=True)
    text.check_name_pattern("out.root", switching=True, check=False)
    text.check_name_pattern("out_%#.root", switching=True)


COPIES = [(1, 0, 1, 0, 0), (1, 0, 1, 1, 0), (1, 0, 2, 2, 0), (1, 0, 1, 0, 1), (1, 0, 1, 1, 1), (1, 0, 3, 2, 1)]


@pytest.mark.parametrize("mode, n", [(scan.Duplicates.KEEP, 6), (scan.Duplicates.EACH_FILE, 4), (scan.Duplicates.ALL_FILES, 3), (scan.Duplicates.EACH_REAL_FILE, 5)])
def test_duplicate_modes(spark, mode, n):
    rows = events(spark, COPIES)
    assert scan.drop_duplicates(rows, mode, ("entry",), real=F.col("file_no") == 0, file_order=("entry",)).count() == n
    assert scan.drop_duplicates(rows.limit(0), mode, ("entry",), real=F.lit(True), file_order=("entry",)).count() == 0


def test_first_copy_wins(spark):
    got = scan.drop_duplicates(events(spark, COPIES), scan.Duplicates.ALL_FILES, ("entry",)).filter("event = 1").collect()
    assert [(r["file_no"], r["entry"]) for r in got] == [(0, 0)]


def test_skip_counts_only_first_copies(spark):
    once = scan.drop_duplicates(events(spark, COPIES), scan.Duplicates.ALL_FILES, ("entry",))
    assert [r["event"] for r in scan.skip_and_limit(once, 1, 5).collect()] == [2, 3]


def combined(spark, fragments, **more):
    rows = [("p", i, k, r, v) for i, (k, r, v) in enumerate(fragments)]
    return combine.combine_fragments(spark.createDataFrame(rows, f"product string, entry bigint, kind string, ranges {RANGES}, value double"), ("product",), **more)


A, B = [(0, 1, 5)], [(0, 5, 9)]


def test_combination_depends_on_what_is_accumulated(spark):
    def e(r, v):
        return ("explicit", r, v)

    assert combined(spark, [e(A, 2.0), e(A, 2.0), e(B, 3.0)]).first()["value"] == 5.0
    assert combined(spark, [e(A, 2.0), e(B, 3.0), e(A, 2.0)]).first()["status"] == combine.OVERLAP
    with pytest.raises(Exception, match=combine.OVERLAP):
        combined(spark, [e(A, 2.0), e(B, 3.0), e(A, 2.0)], strict=True).collect()
    none = ("invalid", [], None)
    assert combined(spark, [none, e(B, 3.0)]).first()["value"] == 3.0
    assert combined(spark, [e(B, 3.0), none]).first()["value"] == 3.0
    assert combined(spark, [none, none]).first()["kind"] == "invalid"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(1, 6)), min_size=1, max_size=12))
def test_merged_ranges_cover_the_same_and_merge_once(spark, parts):
    rows = spark.createDataFrame([(1, s, b, b + n) for s, b, n in parts], "run int, subrun int, begin bigint, end bigint")
    merged = ranges.merge_ranges(rows)
    got = merged.collect()
    cover = {(s, x) for s, b, n in parts for x in range(b, b + n)}
    assert {(r["subrun"], x) for r in got for x in range(r["begin"], r["end"])} == cover
    assert sum(r["end"] - r["begin"] for r in got) == len(cover)
    assert sorted(map(tuple, ranges.merge_ranges(merged).collect())) == sorted(map(tuple, got))


def test_full_ranges_give_back_the_events(spark):
    numbers = [1, 2, 3, 7, 8, 20]
    got = ranges.full_ranges(events(spark, [(1, 0, n, n, 0) for n in numbers])).collect()
    assert sorted(x for r in got for x in range(r["begin"], r["end"])) == numbers and len(got) == 3


def test_draws():
    sets = [sampling.DataSet("a", 1.0), sampling.DataSet("b", 0.0), sampling.DataSet("c", 3.0)]
    drawn = sampling.choose(sets, 5, np.arange(1, 2001)).tolist()
    assert "b" not in drawn and 0.2 < drawn.count("a") / 2000 < 0.3
    assert sampling.generator_states(1, np.array([0, 10000])).tolist() == [1, 1043618065]
    for bad in ([], [sampling.DataSet("a", -1.0)], [sampling.DataSet("a", 0.0)]):
        with pytest.raises(ValueError):
            sampling.check(bad)


def test_sampling_stops_where_a_set_runs_out(spark):
    rows = spark.createDataFrame([(1, 0, i, "a") for i in range(3)] + [(1, 0, 100 + i, "b") for i in range(50)], "run int, subrun int, event bigint, dataset string")
    sets = [sampling.DataSet("a", 1.0), sampling.DataSet("b", 1.0)]
    got = sampling.sample(spark, rows, sets, 3, 40).orderBy("event").collect()
    drawn = sampling.choose(sets, 3, np.arange(1, 41)).tolist()
    end = [i for i, d in enumerate(drawn) if d == "a"][3]
    assert [r["dataset"] for r in got] == drawn[:end]
    assert [r["event"] for r in got] == list(range(1, end + 1))


def test_rules_and_lineage(spark):
    names = ["Int_m1_a_P", "Double_m2__P", "Int_m3_b_Q"]
    assert select.selected(names, ["drop *", "keep Int_*_*_*"]) == ["Int_m1_a_P", "Int_m3_b_Q"]
    assert select.selected(names, ["keep *", "drop *_*_*_Q"]) == names[:2]
    for bad in ("keep", "hold *", "keep a_b"):
        with pytest.raises(ValueError):
            select.Rule.parse(bad)
    long = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "parent string, child string")
    chosen = spark.createDataFrame([("n0",), ("n6",)], "product string")
    got = {r[0]: r[1] for r in select.without_descendants(long, chosen, spark.createDataFrame([("n1",)], "product string")).collect()}
    assert got == {"n0": False, "n6": True}


def test_secondaries_are_asked_depth_first():
    assert lookup.flatten_secondaries({"p": ["a", "b"], "a": ["c"], "c": ["p"]}, "p") == ["a", "c", "b"]


def test_files_with_different_columns(spark, tmp_path):
    events(spark, [(1, 0, 1, 0, 0)]).select("run", "subrun", "event").write.parquet(str(tmp_path / "a"))
    events(spark, [(1, 0, 2, 0, 0)]).select("run", "subrun", "event", F.lit(7).alias("x")).write.parquet(str(tmp_path / "b"))
    spark.range(1).write.parquet(str(tmp_path / "c"))
    got = read_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("file_no").collect()
    assert [(r["file_no"], r["entry"], r["x"]) for r in got] == [(0, 0, None), (1, 0, 7)]
    with pytest.raises(ValueError):
        read_files(spark, [str(tmp_path / "c")])
    with pytest.raises(Exception, match="c/.* lacks run, subrun, event"):
        read_files(spark, [str(tmp_path / "c"), str(tmp_path / "a")]).collect()
    assert read_files(spark, [str(tmp_path / "c"), str(tmp_path / "a")], skip_bad=True).count() == 1
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no more")
    bad = [str(tmp_path / "missing"), str(tmp_path / "broken.parquet"), str(tmp_path / "a")]
    assert [r["file_no"] for r in read_files(spark, bad, skip_bad=True).collect()] == [2]
    with pytest.raises(Exception):
        read_files(spark, bad).collect()
    # One read, whatever the number of files.
    assert plan_nodes(read_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])).count("Relation [") == 1


def plan_nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_levels_that_cannot_be_dropped(spark, tmp_path):
    with pytest.raises(ValueError):
        output.write_levels(events(spark, COPIES), str(tmp_path / "x"), drop_subruns=True)


def test_histograms_add_up(spark):
    rows = spark.createDataFrame([(0, -1.0), (0, 0.0), (1, 9.99), (1, 10.0), (1, 5.0)], "part int, x double")
    parts = combine.histogram(rows, {"bin": (F.col("x"), 0.0, 10.0, 10)}, ("part",))
    got = {r["bin"]: r["content"] for r in combine.merge_histograms(parts, ("bin",)).collect()}
    assert got == {0: 1, 1: 1, 6: 1, 10: 1, 11: 1}


def test_stored_sizes(spark, tmp_path):
    events(spark, COPIES).write.parquet(str(tmp_path / "e"))
    sizes = report.stored_sizes(str(tmp_path / "e"))
    assert {n for n, _, _ in sizes} == {"run", "subrun", "event", "entry", "file_no"} and abs(sum(s for _, _, s in sizes) - 1) < 1e-9


def test_stream_drops_duplicates(spark, tmp_path):
    from evstrata import streaming

    t = datetime.datetime(2024, 1, 1)
    rows = [(1, 0, n % 3, t + datetime.timedelta(minutes=n)) for n in range(9)]
    schema = "run int, subrun int, event bigint, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = streaming.drop_duplicates(streaming.stream_events(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 3
