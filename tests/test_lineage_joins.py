import pytest

from evstrata.operators import provenance, select
from evstrata.plans import session


def test_beyond_the_limit_joins_merge(spark):
    """A file of a few bytes may hold many rows; these are counted, not estimated from its bytes."""
    rows = session.cut(spark.range(1000))
    join = lambda limit, how: rows.join(session.small(rows, limit), "id", how)._jdf.queryExecution().executedPlan().toString()
    for how in ("inner", "left", "left_anti", "left_semi"):
        assert "BroadcastHashJoin" in join(1000, how) and "SortMergeJoin" not in join(1000, how)
        assert "SortMergeJoin" in join(999, how) and "Broadcast" not in join(999, how)


@pytest.fixture(params=[0, 60, 10**6])
def asked(request, monkeypatch):
    """Row counts by which the walks size their joins, under limits that none, some and all rounds keep to."""
    rows = []
    sized = lambda df, n: rows.append(n) or session.sized(df, n, request.param)
    for module in (provenance, select):
        monkeypatch.setattr(module, "sized", sized)
    return rows


def test_ancestors_by_rounds(spark, asked):
    edges = [(k, k // 3, k % 5 != 0) for k in range(3, 600)]
    want, front = set(), {(k, k) for k in range(4, 600, 4)}
    up, sizes = {k: p for k, p, made in edges if made}, []
    while front:
        front = {(k, up[at]) for k, at in front if at in up} - want
        want |= front
        sizes += [len(want), len(front)] if front else []
    start = spark.createDataFrame([(k,) for k in range(4, 600, 4)], "product_id bigint")
    got = [tuple(r) for r in provenance.ancestors(spark.createDataFrame(edges, "child bigint, parent bigint, child_produced boolean"), start).collect()]
    assert sorted(got) == sorted(want) and sorted(asked) == sorted(sizes)


def test_descendants_by_rounds(spark, asked):
    lineage = spark.createDataFrame([(k // 2, k) for k in range(2, 400)] + [(50, 50), (399, 7)], "parent bigint, child bigint")
    lost, front = set(), {k for k in range(400) if k % 97 == 5}
    while front:
        lost |= front
        front = {c for p, c in [(k // 2, k) for k in range(2, 400)] + [(399, 7)] if p in front} - lost
    key = spark.range(400).withColumnRenamed("id", "product")
    got = select.without_descendants(lineage, key.filter("product % 3 = 0"), key.filter("product % 97 = 5")).collect()
    assert {r[0] for r in got if r[1]} == {k for k in lost if k % 3 == 0} and len(got) == 134
    assert asked and max(asked) == len(lost)
