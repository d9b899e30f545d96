"""The conflation of several sources, end to end: standardized rows, footprints, identities, groups,
aggregates, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import olc
from tilewright.functions.boxes import Box
from tilewright.operators import aggregate, footprint, tiles
from tilewright.operators.compare import Compare
from tilewright.operators.components import components
from tilewright.sources.scratch import stage


def union(*sources: DataFrame) -> DataFrame:
    """All rows; keys that a source lacks are null.  Rows without a box go."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return rows.filter("xmin is not null and ymin is not null and xmax is not null and ymax is not null")


def identified(rows: DataFrame, share: float = 0.1) -> DataFrame:
    """Footprints of clustered rows: id, the location code of their centre, and box.  Of footprints with the
    same code the first by root stays alone."""
    prints = footprint.footprints(rows, share)
    b = Box.of()
    coded = prints.withColumn("ubid", olc.encode(tiles.lon_of(b.cx), tiles.lat_of(b.cy), 11))
    return coded.groupBy("ubid").agg(F.min_by(F.struct("xmin", "ymin", "xmax", "ymax"), F.struct("root_name", "root_id")).alias("b")).select(F.col("ubid").alias("id"), "b.*")


def conflate(*sources: DataFrame) -> Compare:
    """``sources``: tables with name, id, grp, box, height_m, floors."""
    rows = stage(union(*sources), "union")
    prints = stage(identified(rows), "footprints")
    found = footprint.assign(rows, prints).withColumnRenamed("footprint", "ubid")
    data = stage(rows.join(found, ["name", "id"]), "data")
    return Compare(data, grouped(data))


def grouped(data: DataFrame) -> DataFrame:
    """One row per source and group: rows that share a group key or an identity belong together, through any
    number of steps; the group's identity is its smallest.  Rows without an identity stay apart from others."""
    numbered = data.withColumn("key", F.xxhash64("name", "id"))
    links = aggregate.links_by(numbered.select("name", F.col("key").alias("id"), "grp", "ubid"), "grp", "ubid")
    labels = components(links).withColumnRenamed("node", "key")
    held = numbered.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    height = aggregate.imputed_height(F.col("height_m"), F.col("floors"))
    return held.groupBy("name", "component").agg(
        F.min("ubid").alias("ubid"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        aggregate.poisoned_max(height).alias("height_m"), aggregate.poisoned_max(F.col("floors")).alias("floors"), F.count("*").alias("n"),
    ).filter("ubid is not null").drop("component")
