"""Tessellation into location-code tiles, and matching of sources through shared tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import olc
from tilewright.operators.compare import running

ORIGIN_LON, ORIGIN_LAT = -88.0, 41.0
UNIT = 100_000.0


def lon_of(x: Column) -> Column:
    """Degrees of the integer lattice of the box views."""
    return F.lit(ORIGIN_LON) + x / UNIT


def lat_of(y: Column) -> Column:
    return F.lit(ORIGIN_LAT) + y / UNIT


def units(rows: DataFrame) -> DataFrame:
    """The rows with their box in code units: w, s, e, n."""
    return rows.select(
        "*", olc.lon_units(lon_of(F.col("xmin"))).alias("w"), olc.lat_units(lat_of(F.col("ymin"))).alias("s"),
        olc.lon_units(lon_of(F.col("xmax"))).alias("e"), olc.lat_units(lat_of(F.col("ymax"))).alias("n"),
    )


def tiles_of_box(rows: DataFrame, length: int = 10) -> DataFrame:
    """(name, id, i, j): candidate tiles whose four corners lie in the box."""
    dx, dy = olc.STEPS[length]
    boxed = units(rows).select("name", "id", "w", "s", "e", "n", F.explode(olc.tiles(F.col("w"), F.col("s"), F.col("e"), F.col("n"), length)).alias("t"))
    i, j = F.col("t.i"), F.col("t.j")
    inside = (i * dx >= F.col("w")) & ((i + 1) * dx <= F.col("e")) & (j * dy >= F.col("s")) & ((j + 1) * dy <= F.col("n"))
    return boxed.filter(inside).select("name", "id", i.alias("i"), j.alias("j"))


def tile_keys(rows: DataFrame, lengths: tuple[int, int] = (10, 11)) -> DataFrame:
    """(name, id, length, i, j): the tiles within each box, at the first length that gives any.  How many tiles
    a length gives follows from the box, so each box is expanded once."""
    boxed = units(rows).select("name", "id", "w", "s", "e", "n")

    def span(low: str, high: str, step: int) -> tuple[Column, Column]:
        return F.floor(F.col(low) / step) + 1, F.floor(F.col(high) / step) - 1

    spans = {n: (*span("w", "e", olc.STEPS[n][0]), *span("s", "n", olc.STEPS[n][1])) for n in lengths}
    some = {n: (a <= b) & (c <= d) for n, (a, b, c, d) in spans.items()}
    fits = F.lit(None)
    for n in reversed(lengths):
        fits = F.when(some[n], F.struct(F.lit(n).alias("length"), *[x.alias(k) for x, k in zip(spans[n], ("i0", "i1", "j0", "j1"))])).otherwise(fits)
    found = boxed.select("name", "id", fits.alias("t")).filter("t is not null")
    wide = found.select("name", "id", "t", F.explode(F.sequence("t.i0", "t.i1")).alias("i"))
    return wide.select("name", "id", F.col("t.length").alias("length"), "i", F.explode(F.sequence("t.j0", "t.j1")).alias("j"))


def tile_code(length: Column, i: Column, j: Column) -> Column:
    """Codes of ten or eleven digits."""
    at = lambda v, k: v * F.when(length == 10, olc.STEPS[10][k]).otherwise(olc.STEPS[11][k])
    whole = olc.encode_units(at(i, 0), at(j, 1), 11)
    return F.when(length == 10, F.substring(whole, 1, 11)).otherwise(whole)


def tessellate(rows: DataFrame, lengths: tuple[int, int] = (10, 11)) -> DataFrame:
    """(name, id, tile): codes of the tiles within each box, at the first length that gives any."""
    return tile_keys(rows, lengths).select("name", "id", tile_code(F.col("length"), F.col("i"), F.col("j")).alias("tile"))


def tile_offsets(tiles: DataFrame) -> DataFrame:
    """(name, id, n, start): tiles of each box and how many tiles boxes of its source before it have."""
    counts = tiles.groupBy("name", "id").agg(F.count("*").alias("n"))
    return running(counts, F.col("n"), ("name",), ("id",), "start")


def duplicate_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles that more than one box of a source owns."""
    return tiles.groupBy("name", "tile").agg(F.count("*").alias("n")).filter("n > 1")


def checked(tiles: DataFrame) -> DataFrame:
    """``tiles``; an error where more than one box of a source owns one."""
    twice = duplicate_tiles(tiles).head(1)
    if twice:
        raise ValueError(f"tile {twice[0].tile} of {twice[0]['name']} has several owners")
    return tiles


def tmatch(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("tile",)) -> DataFrame:
    """(left_id, right_id): right boxes that share a tile with one left box and with no other."""
    shared = left.select(*on, F.col("id").alias("left_id")).join(right.select(*on, F.col("id").alias("right_id")), list(on))
    return shared.groupBy("right_id").agg(F.min("left_id").alias("left_id"), F.max("left_id").alias("last")).filter("left_id = last").select("left_id", "right_id")


def tconcat(left: DataFrame, *others: DataFrame, on: tuple[str, ...] = ("tile",)) -> DataFrame:
    """(name, id, left_id): the left boxes, and those of other sources under the left box they match."""
    out = left.select("name", "id").distinct().select("name", "id", F.col("id").alias("left_id"))
    for right in others:
        names = right.select("name", "id").distinct()
        out = out.union(tmatch(left, right, on).join(names, F.col("right_id") == F.col("id")).select("name", "id", "left_id"))
    return out


def spaces(tiles: DataFrame) -> DataFrame:
    """One row per box that has tiles, with their number."""
    return tiles.groupBy("name", "id").agg(F.count("*").alias("tiles"))
