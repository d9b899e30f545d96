"""Grouping of many-to-one entries and their aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR_M = 3.6


def imputed_height(height: Column, floors: Column) -> Column:
    return F.coalesce(height, floors * FLOOR_M)


def poisoned_max(value: Column) -> Column:
    """The greatest value, but null as soon as one is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.max(value))


def carried(column: str, height: Column, floors: Column, order: Column) -> Column:
    """``column`` of the row of greatest height, else of most floors, else null; the first of ties."""
    return F.coalesce(
        F.max_by(F.when(height.isNotNull(), F.struct(column)), F.when(height.isNotNull(), F.struct(height, -order))),
        F.max_by(F.when(floors.isNotNull(), F.struct(column)), F.when(floors.isNotNull(), F.struct(floors, -order))),
    )[column]


def merged(rows: DataFrame, key: str = "ubid", carry: Sequence[str] = ()) -> DataFrame:
    """One row per (name, key): envelope, poisoned height and floors, and the columns to carry as the row of
    greatest height has them, else that of most floors, else null."""
    height = imputed_height(F.col("height_m"), F.col("floors"))
    more = [carried(c, F.col("height_m"), F.col("floors"), F.col("id")).alias("cardinal" if c == "id" else c) for c in carry]
    return rows.groupBy("name", key).agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        poisoned_max(height).alias("height_m"), poisoned_max(F.col("floors")).alias("floors"), F.count("*").alias("n"), *more,
    )


def links_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Edges (a, b) of ids of a source's rows that share a non-null value of any of the keys: each row is
    linked to the smallest id of its value, which connects what all pairs would."""
    out = None
    for key in keys:
        held = rows.filter(F.col(key).isNotNull()).select("name", "id", F.col(key).alias("v"))
        low = held.groupBy("name", "v").agg(F.min("id").alias("b"))
        part = held.join(low, ["name", "v"]).filter("id <> b").select(F.col("id").alias("a"), "b")
        out = part if out is None else out.union(part)
    return out


def complete_relations(members: DataFrame, elements: DataFrame) -> DataFrame:
    """Groups whose members are all present, or one of whose members is a multipolygon.

    members (component, id), elements (id, multipolygon) -> component, n."""
    found = members.join(elements.select("id", "multipolygon", F.lit(True).alias("here")), "id", "left")
    return found.groupBy("component").agg(F.bool_and(F.coalesce("here", F.lit(False))).alias("all_here"), F.bool_or(F.coalesce("multipolygon", F.lit(False))).alias("multi"), F.count("*").alias("n")).filter("all_here or multi").select("component", "n")
