"""Selection by space, position and membership, nearest rows, bounds, and wide exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.boxes import Box

from .compare import ordinals


def meeting(rows: DataFrame, box: Box) -> DataFrame:
    """Rows whose box meets another one."""
    return rows.filter(Box.of().intersects(box))


def any_meets(rows: DataFrame, box: Box) -> bool:
    """Whether any row meets a box; looks no further than the first."""
    return bool(meeting(rows, box).head(1))


def meets_by(rows: DataFrame, box: Box, *groups: str) -> DataFrame:
    """For each group whether any of its rows meets a box."""
    return rows.groupBy(*groups).agg(F.bool_or(Box.of().intersects(box)).alias("meets"))


def total_bounds(rows: DataFrame, *groups: str) -> DataFrame:
    """Least and greatest corners, and the greatest height."""
    return rows.groupBy(*groups).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.max("height_m").alias("height_m"))


def slice_of(rows: DataFrame, x: tuple[float | None, float | None], y: tuple[float | None, float | None]) -> DataFrame:
    """Rows that meet a slice of coordinates; an open end is None."""
    bounds = ((x[0], F.col("xmax").__ge__), (x[1], F.col("xmin").__le__), (y[0], F.col("ymax").__ge__), (y[1], F.col("ymin").__le__))
    for value, holds in bounds:
        rows = rows if value is None else rows.filter(holds(value))
    return rows


def at_positions(rows: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows whose key has a place from ``low`` to before ``high`` among all keys in order."""
    keys = ordinals(rows.select(key).distinct(), key)
    return rows.join(keys.filter((F.col("ordinal") >= low) & (F.col("ordinal") < high)).select(key), key, "left_semi")


def split_by(rows: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key a table has, and the others."""
    keys = held.select(key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def nearest(rows: DataFrame, others: DataFrame, k: int, radius: int) -> DataFrame:
    """(name, id, near_id, rank): the k nearest of ``others`` by their centres, none further than ``radius``;
    equal distances by id.  Centres meet in cells as wide as the radius, a row in the nine around its own."""
    cell = lambda v: F.floor(v / radius)
    b = Box.of()
    own = rows.select("name", "id", b.cx.alias("x"), b.cy.alias("y"))
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    around = own.select("*", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy")).withColumns({"gx": cell(F.col("x")) + F.col("dx"), "gy": cell(F.col("y")) + F.col("dy")})
    near = others.select(F.col("id").alias("near_id"), b.cx.alias("u"), b.cy.alias("v")).withColumns({"gx": cell(F.col("u")), "gy": cell(F.col("v"))})
    d2 = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    found = around.join(near, ["gx", "gy"]).select("name", "id", "near_id", d2.alias("d2")).filter(F.col("d2") <= radius * radius)
    rank = F.row_number().over(W.partitionBy("name", "id").orderBy("d2", "near_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("name", "id", "near_id", F.col("rank").cast("long").alias("rank"))


def wide(rows: DataFrame, key: str, names: Sequence[str], value: Column) -> DataFrame:
    """One row per key with a column for each source: ``value`` (an aggregate takes it) of the source's rows."""
    return rows.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in names])


def as_json(frame: DataFrame, key: str) -> DataFrame:
    """(key, json): a wide table's other columns as one object; nulls are left out."""
    return frame.select(key, F.to_json(F.struct(*[c for c in frame.columns if c != key])).alias("json"))
