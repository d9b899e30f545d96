"""Open Location Codes as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the code: its digits, and the finest steps to a degree (20^3 * 4^5 and 20^3 * 5^5).
ALPHABET = "23456789CFGHJMPQRVWX"
LON_UNITS = 8192000
LAT_UNITS = 25000000
#: Units of longitude and latitude that a tile of a code length spans.
STEPS = {10 + k: (4 ** (5 - k), 5 ** (5 - k)) for k in range(6)}


def lon_units(lon: Column) -> Column:
    return F.floor((lon + 180) * LON_UNITS).cast("long")


def lat_units(lat: Column) -> Column:
    return F.floor((lat + 90) * LAT_UNITS).cast("long")


def _digit(i: Column) -> Column:
    return F.substring(F.lit(ALPHABET), (i + 1).cast("int"), F.lit(1))


def encode_units(lx: Column, ly: Column, length: int = 11) -> Column:
    """The code of a place in whole units."""
    digits: list[Column] = []
    for k in range(4, -1, -1):  # pairs, the coarsest first
        digits.append(_digit(F.floor(ly / (3125 * 20**k)) % 20))
        digits.append(_digit(F.floor(lx / (1024 * 20**k)) % 20))
    for k in range(4, -1, -1):  # then rows and columns of the grid
        digits.append(_digit(F.floor(ly / 5**k) % 5 * 4 + F.floor(lx / 4**k) % 4))
    return F.concat(*digits[:8], F.lit("+"), *digits[8:length])


def encode(lon: Column, lat: Column, length: int = 11) -> Column:
    return encode_units(lon_units(lon), lat_units(lat), length)


def bounds(lx: Column, ly: Column, length: int = 11) -> dict[str, Column]:
    """West, south, east and north of a tile, in degrees, from units within it."""
    dx, dy = STEPS[length]
    west, south = F.floor(lx / dx) * dx, F.floor(ly / dy) * dy
    return {
        "west": west / LON_UNITS - 180, "south": south / LAT_UNITS - 90,
        "east": (west + dx) / LON_UNITS - 180, "north": (south + dy) / LAT_UNITS - 90,
    }


def decode(code: Column) -> tuple[Column, Column]:
    """Units of the south-west corner of a full code of ten digits or more."""
    bare = F.replace(code, F.lit("+"), F.lit(""))
    at = lambda i: F.position(F.substring(bare, i + 1, 1), F.lit(ALPHABET)).cast("long") - 1
    ly = sum((at(2 * k) * F.lit(3125 * 20 ** (4 - k)) for k in range(5)), F.lit(0).cast("long"))
    lx = sum((at(2 * k + 1) * F.lit(1024 * 20 ** (4 - k)) for k in range(5)), F.lit(0).cast("long"))
    for k in range(5):
        digit = F.when(F.length(bare) > 10 + k, at(10 + k)).otherwise(0)
        ly, lx = ly + F.floor(digit / 4) * 5 ** (4 - k), lx + digit % 4 * 4 ** (4 - k)
    return lx, ly


def length_for(width: Column, height: Column) -> Column:
    """Code length for an extent in degrees, from 10 on: one more digit while the tile is wider or higher than
    the extent's share of 2.5; null beyond 15."""
    out = F.lit(None).cast("int")
    for n in range(15, 9, -1):
        dx, dy = STEPS[n]
        out = F.when((F.lit(dx / LON_UNITS) <= width / 2.5) & (F.lit(dy / LAT_UNITS) <= height / 2.5), n).otherwise(out)
    return out


def claim(west: Column, south: Column, east: Column, north: Column, length: int = 11) -> Column:
    """Places (x, y) in units, one in each tile strictly between the tiles of a box's corners: whole steps from
    the south-west corner, which keep its offset within its tile."""
    dx, dy = STEPS[length]
    steps = lambda a, b, d: F.when(F.floor(b / d) - F.floor(a / d) > 1, F.sequence(F.lit(1).cast("long"), F.floor(b / d) - F.floor(a / d) - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(steps(west, east, dx), lambda i: F.transform(steps(south, north, dy), lambda j: F.struct((west + i * dx).alias("x"), (south + j * dy).alias("y")))))


def south_west(lx: Column, ly: Column, length: int = 11) -> dict[str, Column]:
    """Longitude and latitude of the lower left corner of the tile that units lie in."""
    at = bounds(lx, ly, length)
    return {"lon": at["west"], "lat": at["south"]}


def tiles(west: Column, south: Column, east: Column, north: Column, length: int) -> Column:
    """Candidate tiles of a box in units: indices right of the west and south edge's own tile, up to the east
    and north edge's."""
    dx, dy = STEPS[length]
    span = lambda a, b, d: F.when(F.floor(b / d) > F.floor(a / d), F.sequence(F.floor(a / d) + 1, F.floor(b / d))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(span(west, east, dx), lambda i: F.transform(span(south, north, dy), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def metres_per_tile(lat: float, length: int = 11) -> tuple[float, float]:
    dx, dy = STEPS[length]
    return dx / LON_UNITS * 111320 * math.cos(math.radians(lat)), dy / LAT_UNITS * 110540
