"""Declared columns of the building sources.

Raw tables carry the sources' own columns next to a box (xmin, ymin, xmax, ymax).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.operators.aggregate import poisoned_max
from tilewright.operators.registry import Declared, Source


class Footprint(Source):
    """What every source has; a column that a source doesn't know is null."""

    id = Declared(lambda: F.col("id"), "string")
    grp = Declared(lambda: F.lit(None), "string")
    xmin = Declared(lambda: F.col("xmin"), "double", aggregate=F.min)
    ymin = Declared(lambda: F.col("ymin"), "double", aggregate=F.min)
    xmax = Declared(lambda: F.col("xmax"), "double", aggregate=F.max)
    ymax = Declared(lambda: F.col("ymax"), "double", aggregate=F.max)
    timestamp = Declared(lambda: F.lit(None), "timestamp_ntz")
    cx = Declared(lambda: (F.col("xmin") + F.col("xmax")) / 2, "double", depends=("xmin", "xmax"))
    cy = Declared(lambda: (F.col("ymin") + F.col("ymax")) / 2, "double", depends=("ymin", "ymax"))


class Building(Footprint):
    address = Declared(lambda: F.lit(None), "string")
    start_date = Declared(lambda: F.lit(None), "date")
    floors = Declared(lambda: F.lit(None), "double", aggregate=poisoned_max)
    height_m = Declared(lambda: F.lit(None), "double", aggregate=poisoned_max)


class UsFootprints(Building):
    name = "msbf"
    timestamp = Declared(lambda: F.lit("2020-06-10"))


class UsFootprintsWithHeights(Building):
    name = "msbf2017"
    height_m = Declared(lambda: F.col("Height"))


class CityModel(Building):
    name = "ocm"
    grp = Declared(lambda: F.col("ubid"))
    height_m = Declared(lambda: F.col("height"))


class MapEntries(Building):
    """Elements with a tag map and members; several values of a tag give several rows beforehand."""

    name = "osm"
    id = Declared(lambda: F.concat(F.substring("type", 1, 1), F.col("id").cast("string")))
    timestamp = Declared(lambda: F.try_to_timestamp(F.col("timestamp")))
    address = Declared(lambda: text.osm_address(F.col("tags")["addr:housenumber"], F.col("tags")["addr:street"]))
    start_date = Declared(lambda: text.lenient_date(F.col("tags")["start_date"]))
    floors = Declared(lambda: text.listed(F.col("tags")["building:levels"])[0])
    height_m = Declared(lambda: text.listed(F.col("tags")["height"])[0])

    @staticmethod
    def wanted(elements: DataFrame) -> DataFrame:
        """Buildings and parts of buildings above ground; of ways no bridges, of relations also those typed so."""
        tag = lambda k: F.col("tags")[k]
        above = F.coalesce(tag("location"), F.lit("")) != "underground"
        way = (F.col("type") == "way") & (tag("building").isNotNull() & tag("bridge").isNull() | tag("building:part").isNotNull())
        relation = (F.col("type") == "relation") & (tag("building").isNotNull() | tag("building:part").isNotNull() | (F.coalesce(tag("type"), F.lit("")) == "building"))
        return elements.filter((way | relation) & above)


class CityFootprints(Building):
    name = "cbf"
    id = Declared(lambda: F.col("bldg_id"))
    address = Declared(lambda: text.city_address(F.col("t_add1"), F.col("pre_dir1"), F.col("st_name1"), F.col("st_type1")))
    start_date = Declared(lambda: text.year_date(F.col("year_built")))
    floors = Declared(lambda: text.storeys(F.col("stories")))
