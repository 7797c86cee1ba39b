import duckdb
from oracle import connect, differences

from evstrata.operators import ranges
from evstrata.plans.queries import ORACLES, QUERIES
from evstrata.plans.session import tasks_for


def test_tasks_follow_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [tasks_for(spark, n, 10) for n in (0, 1, 10 * cores, 10 * cores + 1, 10**6)] == [cores, cores, cores, cores + 1, 10**5]


def test_relations_are_counted_in_as_many_tasks_as_events_need(spark, monkeypatch):
    """What one task holds stays the same when there are more events, and nothing is joined."""
    monkeypatch.setattr(ranges, "FRAGMENTS", 100)
    for n in (1000, 3000):
        events = spark.range(n).selectExpr("1 as run", "cast(id div 8 as int) as subrun", "id % 8 * (id % 3 + 1) as event", "cast(id % 5 as int) as file_no")
        out = ranges.event_relation_counts(events)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count(f", {n // 100}), REPARTITION_BY_NUM") >= 2
        assert "partial_min(event" not in plan.split("Exchange")[-1]
        whole = ranges.relation_counts(ranges.compact_ranges(events, ("file_no", "run", "subrun")))
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.select(*out.columns).collect()))


def test_missing_keys_equal_sql(spark, tmp_path):
    """Lines without an order or a supplier: their sub-run is counted, without pairs."""
    lines = """select case when i % 11 > 0 then i // 7 end as l_orderkey, cast(i % 7 * (i % 3 + 1) as int) as l_linenumber, case when i % 13 > 0 then i % 5 end as l_suppkey, 0 as l_partkey,
      0 as l_quantity, 0 as l_extendedprice, 0 as l_discount, 0 as l_tax, 0 as l_shipdate, '' as l_returnflag, '' as l_linestatus from range(700) t(i)"""
    duckdb.sql(lines).write_parquet(f"{tmp_path}/lineitem.parquet")
    assert differences(QUERIES["range_overlap"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["range_overlap"]) == []
