import pytest
from oracle import connect, differences

from terrane.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert not differences(df, SQL[name], con)[:3]
    else:
        assert df.count() > 0


def test_connected_components(spark, con):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in con.execute("SELECT DISTINCT l_partkey, 1000000000 + l_suppkey FROM lineitem").fetchall():
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert {tuple(x) for x in QUERIES["connected_components"](spark, SF).select("node", "component").collect()} == {(x, find(x)) for x in list(root)}


def test_connected_has_parts_by_edges(spark, monkeypatch):
    """Shuffles have more parts as edges grow; the result is the same."""
    from terrane.operators import graph
    from terrane.sources import tables

    monkeypatch.setattr(tables, "ROWS", 20)
    seen, whole = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or whole(df))
    edges = spark.range(100).selectExpr("id + id div 10 AS u", "id + id div 10 + 1 AS v")
    got = {r.node: r.component for r in graph.connected(edges.union(edges)).collect()}
    assert got == {n: n // 11 * 11 for n in range(110)} and set(seen) == {20}
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
