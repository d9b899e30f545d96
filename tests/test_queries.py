"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from tests.oracle import connection, differences
from tilewright.plans.queries import ORACLES, QUERIES, around_mismatches, walls
from tilewright.plans.views import view


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    if name in ORACLES:
        assert differences(spark, name, QUERIES[name], ORACLES[name], con=con) is None
    else:
        frame = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert frame.columns and frame.count() > 0


def test_components_of_all_relations(spark):
    data = "/root/testdata/sf0.001"
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    relations = {}
    for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        a, b = sorted((find(r.l_partkey), find(relations.setdefault(r.l_orderkey, r.l_partkey))))
        root[b] = a  # the smaller one leads
    got = {r.node: r.component for r in QUERIES["group_components"](spark, data).collect()}
    assert got == {x: find(x) for x in root}


def test_all_relations_are_grouped(spark):
    data = "/root/testdata/sf0.001"
    assert QUERIES["relation_groups"](spark, data).filter("component % 400 <> 0").count() > 0


def test_every_building_is_a_wall(spark):
    data = "/root/testdata/sf0.001"
    want = {(r.id % 8, (r.ymin * 7 + r.id // 97) % 256, (r.xmin * 3 + r.id // 97 * 5) % 256) for r in view(spark, data, "bld").filter("name = 'osm'").collect()}
    assert {tuple(r) for r in walls(spark, data).collect()} == want


def test_surroundings_of_what_is_unmatched(spark):
    box = "name string, id long, xmin long, ymin long, xmax long, ymax long"
    rows = [("osm", 17, 10, 10, 30, 30), ("osm", 18, 60, 10, 80, 30), ("msbf", 17, 11, 10, 31, 30), ("msbf", 18, 60, 40, 80, 60)]
    got = around_mismatches(spark.createDataFrame(rows, box)).collect()
    assert sorted((r.id, r.near_id) for r in got) == [(18, 17), (18, 18)]


def test_checksums_of_lists_and_claims(spark):
    """Figures measured on sf0.01 from the rules alone."""
    data = "/root/testdata/sf0.01"
    rows = QUERIES["enumerative_explode"](spark, data).collect()
    levels, height = ([r[c] for r in rows if r[c] is not None] for c in ("levels", "height"))
    assert (len(rows), len(levels), sum(levels), len(height), sum(height)) == (2424, 1649, 29_054, 1984, 82_992)
    assert QUERIES["olc_claim"](spark, data).count() == 8806
