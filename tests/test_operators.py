"""Operators on small frames: edges, ties, nulls, empty tables."""

import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import geo, olc, slippy, text
from tilewright.functions.boxes import Box
from tilewright.operators import aggregate, compare, components, footprint, raster, street, tiles
from tilewright.operators.registry import Declared, Source
from tilewright.plans.queries import enumerated

BOX = "name string, id long, xmin long, ymin long, xmax long, ymax long"


def values(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_parent_is_nearest_and_overlap_bounds_hold(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0, 0, 100, 100), ("b", 2, 40, 40, 80, 80), ("c", 3, 54, 54, 64, 64), ("d", 4, 95, 0, 145, 10), ("e", 5, 100, 50, 120, 60), ("f", 6, 96, 20, 146, 30)], BOX
    )
    # d covers exactly a tenth of itself in a; f a little less; e only touches
    assert values(footprint.parents(rows), "id", "parent_id") == [(2, 1), (3, 2), (4, 1)]
    assert values(footprint.clusters(rows), "id", "root_id") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)]
    assert values(footprint.footprints(rows).filter("root_id = 1"), "xmin", "ymax", "n") == [(0, 100, 4)]


def test_assignment_needs_half_of_the_row(spark):
    prints = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 6, 0, 16, 10)], "id long, xmin long, ymin long, xmax long, ymax long")
    rows = spark.createDataFrame([("x", 1, 5, 0, 15, 10), ("x", 2, -5, 0, 5, 10), ("x", 3, -51, 0, 49, 1), ("x", 4, 5, 2, 9, 4)], BOX)
    got = {r["id"]: r["footprint"] for r in footprint.assign(rows, prints).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: 1}


def test_components_match_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    up = {n: n for e in edges for n in e}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    expected = sorted((n, find(n)) for n in {n for a, b in edges if a != b for n in (a, b)})
    assert values(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "component") == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_link_by_key_and_never_by_null(spark):
    rows = spark.createDataFrame([("s", 1, 7, 1), ("s", 2, 7, 2), ("s", 3, None, 2), ("s", 4, None, None), ("t", 5, 7, None)], "name string, id long, grp long, ubid long")
    assert values(components.components(aggregate.links_by(rows, "grp", "ubid")), "node", "component") == [(1, 1), (2, 1), (3, 1)]


def test_poisoned_max_and_carry(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, 7.0, None), (2, 3, 5.0, None), (2, 4, None, None), (3, 5, None, 2.0), (4, 6, None, None), (5, 7, 9.0, 1.0), (5, 8, 9.0, 5.0)], "k long, id long, h double, f double")
    height = aggregate.imputed_height(F.col("h"), F.col("f"))
    got = rows.groupBy("k").agg(aggregate.poisoned_max(height).alias("m"), aggregate.carried("id", F.col("h"), F.col("f"), F.col("id")).alias("c"))
    assert {r.k: (r.m, r.c) for r in got.collect()} == {1: (7.0, 2), 2: (None, 3), 3: (7.2, 5), 4: (None, None), 5: (9.0, 7)}


def test_relations_must_be_complete_or_multipolygons(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 9), (3, 4), (3, 9)], "component long, id long")
    elements = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "id long, multipolygon boolean")
    assert values(aggregate.complete_relations(members, elements), "component", "n") == [(1, 2), (3, 2)]


def test_enumerated_values(spark):
    rows = spark.createDataFrame([(1, "3;4;5", "10"), (2, "3;4;5", "10;12"), (3, "7;x", ""), (4, "x;7", None), (5, None, "1;2")], "id long, levels string, height string")
    got = sorted((r.id, r.pos, r.levels, r.height) for r in enumerated(rows, "levels", "height").collect())
    assert got[:6] == [(1, 0, 3.0, 10.0), (1, 1, 4.0, 10.0), (1, 2, 5.0, 10.0), (2, 0, 3.0, 10.0), (2, 1, 4.0, 12.0), (2, 2, 5.0, None)]
    assert [g for g in got if g[0] == 3] == [(3, 0, None, None)]
    assert [g for g in got if g[0] == 4] == [(4, 0, None, None)]
    assert [g for g in got if g[0] == 5] == [(5, 0, None, 1.0), (5, 1, None, 2.0)]


def data(spark):
    return spark.createDataFrame(
        [(1, "a", 1, 0, 0, 4, 4, 2.0, None), (1, "b", 2, 0, 0, 4, 2, 4.0, None), (2, "a", 3, 0, 0, 1, 1, 4.0, None), (2, "b", 4, 0, 0, 1, 1, 4.0, None), (3, "a", 5, 0, 0, 1, 1, 0.0, 1.0), (3, "b", 6, 5, 5, 6, 6, 0.0, 2.0), (4, "a", 7, 0, 0, 1, 1, None, None), (5, "b", 8, 0, 0, 1, 1, 1.0, None)],
        "ubid long, name string, id long, xmin long, ymin long, xmax long, ymax long, height_m double, floors double",
    )


def test_selection_and_measures(spark):
    c = compare.Compare(data(spark))
    assert values(c.matched("a"), "ubid") == [(1,), (2,), (3,)] and values(c.unmatched("a"), "ubid") == [(4,)]
    assert values(c.matched(["a", "b"]), "ubid") == [] and values(c.matched(), "ubid") == [(1,), (2,), (3,)]
    assert values(c.unmatched(), "ubid") == [(4,), (5,)]
    assert values(c.match_rate("a"), "name", "n", "matched", "rate") == [("a", 4, 3, 0.75)]
    assert {r.ubid: r.containment for r in c.containment("a", "b").collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    assert {r.ubid: r.quality for r in c.quality("a", "b").collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    assert {r.ubid: r.difference for r in c.difference_percent("a", "b").collect()} == {1: 0.5, 2: 0.0, 3: None}
    assert [(r.ubid, r.difference) for r in c.discrepancies("a", "b").collect()] == [(1, 0.5)]
    assert {r.ubid: r.b for r in c.matrix("a", ["a", "b"]).collect()} == {1: 0.5, 2: 0.0, 3: 0.5}
    assert values(c[spark.createDataFrame([(1,)], "ubid long")].aggregate, "ubid", "name") == [(1, "a"), (1, "b")]
    assert values(c.xs("a"), "ubid") == [(1,), (2,), (3,), (4,)] and values(c.xs("5"), "name") == [("b",)]
    assert c.identities("b").filter("ubid = 1").first().ids == "2"


def test_columns_are_inherited_and_ordered(spark):
    class Base(Source):
        x = Declared(None, "double")
        double = Declared(lambda: F.col("x") * 2, depends=("x",))

    class Child(Base):
        name = "child"
        x = Declared(lambda: F.col("raw"))
        one = Declared(1, "long")

    got = Child.standardize(spark.createDataFrame([(3,)], "raw long")).first()
    assert (got.x, got.double, got.one, got.name) == (3.0, 6.0, 1, "child")
    with pytest.raises(ValueError):
        Base.standardize(spark.createDataFrame([(3,)], "raw long"))

    class Loop(Source):
        a = Declared(1, depends=("b",))

    with pytest.raises(ValueError):
        Loop.standardize(spark.range(1))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-180, 179.999), st.floats(-89.999, 89.99)), min_size=1, max_size=20))
def test_code_tiles_hold_their_point(spark, points):
    rows = spark.createDataFrame(points, "lon double, lat double").select("lon", "lat", olc.encode(F.col("lon"), F.col("lat"), 11).alias("code"))
    lx, ly = olc.decode(F.col("code"))
    rows = rows.select("*", lx.alias("lx"), ly.alias("ly")).select("*", *[v.alias(k) for k, v in olc.bounds(F.col("lx"), F.col("ly"), 11).items()])
    for r in rows.collect():
        assert len(r.code) == 12 and r.code[8] == "+"
        assert r.west - 1e-9 <= r.lon <= r.east + 1e-9 and r.south - 1e-9 <= r.lat <= r.north + 1e-9


def test_known_code(spark):
    got = spark.range(1).select(olc.encode(F.lit(8.0), F.lit(47.0), 10).alias("a"), olc.encode(F.lit(-180.0), F.lit(-90.0), 10).alias("b")).first()
    assert got.a == "8FVC2222+22" and got.b == "22222222+22"


def test_slippy_round_trip(spark):
    r = spark.range(1).select(slippy.tile_x(F.lit(-88.0), 0).alias("x0"), slippy.tile_x(F.lit(13.4), 10).alias("x"), slippy.tile_y(F.lit(-33.5), 10).alias("y"), slippy.pack(F.lit(5), F.lit(7)).alias("k")).first()
    assert r.x0 == 0 and r.k == (5 << 32) + 7
    n = spark.range(1).select(slippy.tile_west(F.lit(r.x), 10).alias("w"), slippy.tile_north(F.lit(r.y), 10).alias("n"), slippy.tile_north(F.lit(r.y + 1), 10).alias("s")).first()
    assert n.w <= 13.4 < n.w + 360 / 1024 and n.s <= -33.5 <= n.n


def test_tile_match_excludes_ambiguous_right_sides(spark):
    left = spark.createDataFrame([("l", 1, "A"), ("l", 1, "B"), ("l", 2, "C")], "name string, id long, tile string")
    right = spark.createDataFrame([("r", 7, "A"), ("r", 8, "B"), ("r", 8, "C"), ("r", 9, "B"), ("r", 10, "Z")], "name string, id long, tile string")
    assert values(tiles.tmatch(left, right), "left_id", "right_id") == [(1, 7), (1, 9)]
    assert values(tiles.tconcat(left, right), "name", "id", "left_id") == [("l", 1, 1), ("l", 2, 2), ("r", 7, 1), ("r", 9, 1)]


def test_raster_sums_and_clamps(spark):
    rows = spark.createDataFrame([(0, 0, 4, 4, 64.0), (0, 0, 4, 4, 64.0), (4, 0, 6, 4, 32.0)], "xmin long, ymin long, xmax long, ymax long, height_m double")
    assert values(raster.elevation(rows, 4, 64.0), "cn", "cw", "value") == [(0, 0, 65535), (0, 1, 16383)]
    assert values(raster.elevation(rows, 4, 64.0, wrap=True), "cw", "value") == [(0, 65534), (1, 16383)]
    image = raster.dense(raster.elevation(rows, 4, 64.0)).first().image
    assert len(image) == 65536 and image[:3] == [65535, 16383, 0]


def test_height_above_ground(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 5.0, True), (2, 1.0, 0.0, 9.0, False), (3, 99.0, 0.0, 9.0, False)], "id long, x double, y double, z double, ground boolean")
    assert {r.id: r.hag for r in raster.height_above_ground(points, 10).collect()} == {1: 0.0, 2: 4.0, 3: None}


def brute_ray(heading, row, col, wall):
    import math

    theta = math.radians((450 - heading) % 360)
    slope = abs(math.tan(theta))
    steep = slope > 1
    m = 1 / slope if steep else slope
    dx, dy = (1 if math.cos(theta) >= 0 else -1), (-1 if math.sin(theta) >= 0 else 1)
    r, c, e = row, col, 0.0
    while 0 <= r < 256 and 0 <= c < 256:
        if (r, c) in wall:
            return c - col, r - row
        if e >= 1:
            e -= 1
            r, c = (r, c + dx) if steep else (r + dy, c)
        else:
            e += m
            r, c = (r + dy, c) if steep else (r, c + dx)
    return None, None


def test_ray_casting_matches_a_walk(spark):
    import random

    rng = random.Random(1)
    wall = {(rng.randrange(256), rng.randrange(256)) for _ in range(3000)}
    cams = [(i, 0, rng.randrange(256), rng.randrange(256), float(h)) for i, h in enumerate([0, 45, 90, 180, 270, *range(3, 360, 17)])]
    walls = spark.createDataFrame([(0, r, c) for r, c in wall], "tile long, r long, c long")
    got = street.raycast(spark.createDataFrame(cams, "poid long, tile long, row long, col long, heading double"), walls)
    assert {r.poid: (r.dcol, r.drow) for r in got.collect()} == {p: brute_ray(h, r, c, wall) for p, _, r, c, h in cams}


def test_headings_expand_and_keep_the_first(spark):
    cams = spark.createDataFrame([(1, 0, 0, 350.0), (1, 0, 0, 170.0), (2, 0, 0, None)], "poid long, x long, y long, heading double")
    assert values(street.heading_expand(cams), "poid", "heading") == [(1, 80.0), (1, 260.0)]


def test_lenient_parsing(spark):
    rows = spark.createDataFrame([("1999-04-05", "1999", "3.5", "1", ""), ("05.04.1999", "0", "0", "", "x"), ("soon", "19800", "NaN", None, "x"), (None, None, None, "2", "y")], "d string, y string, s string, h string, t string")
    got = rows.select(text.lenient_date(F.col("d")).cast("string").alias("d"), text.year_date(F.col("y")).cast("string").alias("y"), text.storeys(F.col("s")).alias("s"), text.osm_address(F.col("h"), F.col("t")).alias("a")).collect()
    assert [r.d and r.d[:10] for r in got] == ["1999-04-05", "1999-04-05", None, None]
    assert [r.y for r in got] == ["1999-01-01", None, None, None] and [r.s for r in got] == [3.5, None, None, None] and [r.a for r in got] == [None, None, None, "2 y"]
    assert text.parse_bbox("4,1;2 9") == (2.0, 1.0, 4.0, 9.0)
    with pytest.raises(ValueError):
        text.parse_bbox("1,2,3")


def test_rings(spark):
    row = spark.range(1).select(text.wkt_points(F.lit("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))")).alias("r"), text.wkt_points(F.lit("junk")).alias("j"))
    got = row.select(geo.ring_area(F.col("r")).alias("a"), geo.ring_centroid(F.col("r"), "x").alias("cx"), geo.point_in_ring(F.lit(1.0), F.lit(1.0), F.col("r")).alias("i"), geo.point_in_ring(F.lit(5.0), F.lit(1.0), F.col("r")).alias("o"), F.size("j").alias("n")).first()
    assert (got.a, got.cx, got.i, got.o, got.n) == (8.0, 2.0, True, False, 0)


def test_box_measures(spark):
    a, b = Box.literal(0, 0, 2, 2), Box.literal(2, 0, 4, 2)
    got = spark.range(1).select(a.intersects(b).alias("t"), a.intersection_area(b).alias("i"), a.union_area(b).alias("u"), a.within(Box.literal(0, 0, 9, 9)).alias("w")).first()
    assert (got.t, got.i, got.u, got.w) == (True, 0, 8, True)


def test_no_nested_loops_in_spatial_joins(spark):
    from tilewright.plans.views import view

    rows = view(spark, "/root/testdata/sf0.001", "bld")
    for frame in (footprint.parents(rows), footprint.assign(rows.filter("name <> 'osm'"), rows.filter("name = 'osm'"))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contraction_with_full_buffers(monkeypatch):
    rng = random.Random(5)
    edges = sorted({(max(p), min(p)) for p in ((rng.randrange(400), rng.randrange(400)) for _ in range(500)) if p[0] != p[1]})
    batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b, "moved": False} for a, b in edges[k : k + 33]]) for k in range(0, len(edges), 33)]

    def reached(pairs):
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            up[b] = a
        return {x: find(x) for x in up}

    for held in (1_000_000, 20):
        monkeypatch.setattr(components, "HELD", held)
        out = [r for batch in components._contracted(iter(batches)) for r in batch.to_pylist()]
        assert all(r["a"] > r["b"] for r in out) and any(r["busy"] for r in out)
        assert sorted(r["a"] for r in out if r["own"]) == sorted({a for a, _ in edges})
        assert reached((r["a"], r["b"]) for r in out) == reached(edges)
