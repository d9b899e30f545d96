"""File sources: suffixes, boundaries, logs, tiles, stages."""

import json

import pyarrow as pa
from pyarrow import feather
from pyspark.sql import functions as F

from tilewright.sources import files


def test_feather_and_parquet_by_suffix(spark, tmp_path):
    for i in range(2):
        feather.write_feather(pa.table({"id": [i, i + 10], "h": [1.5, None], "unused": ["a", "b"]}), str(tmp_path / f"{i}.feather"))
    frame = files.read_any(spark, str(tmp_path / "0.feather"), str(tmp_path / "1.feather"), columns=["id", "h"])
    assert sorted(r.id for r in frame.collect()) == [0, 1, 10, 11]
    files.write_any(frame, str(tmp_path / "out.parquet"))
    assert files.read_any(spark, str(tmp_path / "out.parquet")).count() == 4


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Height": 7.0}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    row = files.read_any(spark, str(tmp_path / "a.geojson")).first()
    assert row.Height == 7.0 and len(row.ring) == 4


def test_poly_boundary(spark, tmp_path):
    (tmp_path / "x.poly").write_text("name\n1\n   1.0  2.0\n   3.0E0  4.0\n   1.0  9.0\nEND\n2\n   5.0  5.0\n   6.0  5.0\n   6.0  6.0\nEND\nEND\n")
    row = files.read_poly(spark, str(tmp_path / "x.poly")).first()
    assert [len(r) for r in row.rings] == [3, 3] and (row.xmin, row.ymin, row.xmax, row.ymax) == (1.0, 2.0, 6.0, 9.0)


def test_csv_pair_skips_error_lines_in_both(spark, tmp_path):
    (tmp_path / "a.csv").write_text("p1,1.0\nE bad\np3,3.0\n")
    (tmp_path / "b.csv").write_text("10\n20\n30\n")
    got = files.read_csv_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "poid string, lat double", "heading double")
    assert sorted((r.poid, r.heading) for r in got.collect()) == [("p1", 10.0), ("p3", 30.0)]


def test_tile_paths(spark, tmp_path):
    (tmp_path / "17" / "5").mkdir(parents=True)
    (tmp_path / "17" / "5" / "9.png").write_bytes(b"x")
    row = files.read_tiles(spark, str(tmp_path)).first()
    assert (row.zoom, row.tw, row.tn, bytes(row.content)) == (17, 5, 9, b"x")


def test_manifest_and_stage(spark, tmp_path):
    manifest = spark.createDataFrame([("a", 0, 0, 1, 1), ("b", 5, 5, 6, 6)], "path string, xmin long, ymin long, xmax long, ymax long")
    assert files.prune(manifest, 0.5, 0.5, 2, 2) == ["a"]
    path = files.stage_path(str(tmp_path), ["osm", "msbf"], (0, 0, 1, 1))
    assert path.endswith("msbf_osm/0,0,1,1")
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert files.cached(spark, path, make).count() == 3 and files.cached(spark, path, make).count() == 3 and len(made) == 1
    assert files.cached(spark, path, make, redo=True).count() == 3 and len(made) == 2


def test_split_bbox():
    assert len(files.split_bbox(lambda *b: 100 * (b[3] - b[1]), 0, 0, 1, 4, 100 * 11_000)) == 4


def test_outer_ring(spark):
    geometry = [[[0.0, 0.0], [1.0, 0.0]], [[9.0, 9.0]]]
    rows = spark.createDataFrame([(1, "Polygon", geometry), (2, "LineString", geometry)], "id long, kind string, geometry array<array<array<double>>>")
    got = {r.id: r.n for r in rows.select("id", F.size(files.outer_ring("kind")).alias("n")).collect()}
    assert got == {1: 2, 2: None}


def test_png_round_trip(spark):
    import numpy as np

    from tilewright.operators import raster
    from tilewright.sources import images

    rng = np.random.default_rng(0)
    for dtype, top in ((np.uint8, 256), (np.uint16, 65536)):
        image = rng.integers(0, top, (256, 256)).astype(dtype)
        assert (images.decode_png(images.encode_png(image))[:, :, 0] == image).all()
    cells = spark.createDataFrame([(3, 4, 0, 1, 500), (3, 4, 255, 255, 65535)], "tn long, tw long, cn long, cw long, value long")
    back = images.pixels(images.png_tiles(raster.dense(cells)), "tn", "tw").collect()
    assert sorted((r.tn, r.tw, r.r, r.c, r.value) for r in back) == [(3, 4, 0, 1, 500), (3, 4, 255, 255, 65535)]


def test_catalogue(spark):
    from tilewright.sources import catalog

    rows = [("continent", "C", None, "c", 0, 0, 9, 9), ("region", "R", "C", "r", 0, 0, 4, 4), ("region", "Q", "X", "q", 0, 0, 4, 4), ("city", "T", "R", "t", 8, 8, 9, 9)]
    m = spark.createDataFrame(rows, "level string, name string, parent string, path string, xmin long, ymin long, xmax long, ymax long")
    assert [r.name for r in catalog.suggest(m, (1, 1, 2, 2), "region").collect()] == ["R"]
    assert sorted(r.name for r in catalog.finest(m, (1, 1, 2, 2)).collect()) == ["Q", "R"] and [r.name for r in catalog.finest(m, (8, 8, 8, 8)).collect()] == ["T"]
    pages = spark.createDataFrame([('<table><tr><td class="x"><a href="http://a/b">Place One</a></td><td>no</td></tr></table>',)], "value string")
    assert [(r.place, r.url) for r in catalog.page_links(pages).collect()] == [("Place One", "http://a/b")]
    assert [r.path for r in catalog.stale(m, m.filter("name <> 'T'"), ["R"]).orderBy("path").collect()] == ["r", "t"]


def test_building_sources_and_conflation(spark):
    from pyspark.sql import functions as F

    from tilewright.plans import lifecycle
    from tilewright.plans.views import view
    from tilewright.sources import buildings

    elements = spark.createDataFrame(
        [("way", 1, 0, 0, 20, 20, None, {"building": "yes", "building:levels": "3;4", "addr:housenumber": "5", "addr:street": "S"}), ("way", 2, 0, 0, 2, 2, None, {"building": "yes", "bridge": "yes"}), ("relation", 3, 0, 0, 2, 2, None, {"type": "building"}), ("way", 4, 0, 0, 2, 2, None, {"building": "yes", "location": "underground"})],
        "type string, id long, xmin long, ymin long, xmax long, ymax long, timestamp string, tags map<string,string>",
    )
    osm = buildings.MapEntries.standardize(buildings.MapEntries.wanted(elements))
    got = {r.id: (r.floors, r.address, r.cx) for r in osm.collect()}
    assert got == {"w1": (3.0, "5 S", 10.0), "r3": (None, None, 1.0)}
    rows = view(spark, "/root/testdata/sf0.001", "bld").filter("id < 400")
    both = lifecycle.conflate(*[rows.filter(F.col("name") == n) for n in ("osm", "msbf", "ocm")])
    rates = {r.name: r.rate for r in both.match_rate().collect()}
    assert set(rates) == {"osm", "msbf", "ocm"} and all(0 < v <= 1 for v in rates.values())
