"""Web-map tiles: numbers of a place at a zoom, corners of a tile, packed keys, cells within tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 256


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * 2**zoom).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * 2**zoom).cast("long")


def tile_west(x: Column, zoom: int) -> Column:
    return x / 2**zoom * 360 - 180


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / 2**zoom))))


def pack(tn: Column, tw: Column) -> Column:
    return F.shiftleft(tn.cast("long"), 32).bitwiseOR(tw.cast("long"))


def unpack(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def tiles_of(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """All tiles (tw, tn) that a box of degrees touches."""
    xs = F.sequence(tile_x(west, zoom), tile_x(east, zoom))
    ys = F.sequence(tile_y(north, zoom), tile_y(south, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("tw"), y.alias("tn")))))
