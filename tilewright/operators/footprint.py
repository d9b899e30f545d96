"""Footprints: overlap clustering and assignment by a grid join.

Rows are boxes with a key (name, id).  Candidates meet in the grid cells that both touch, so no pair is
looked at that has no cell in common; a pair that meets in several cells counts once in the minimum taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.boxes import Box
from tilewright.sources.scratch import stage

CELL = 100
CORNERS = ("xmin", "ymin", "xmax", "ymax")


def _celled(rows: DataFrame, prefix: str, cell: int) -> DataFrame:
    named = rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("name", "id", *CORNERS)])
    return named.select("*", F.explode(Box.of(prefix).cells(cell)).alias("cell"))


def parents(rows: DataFrame, share: float = 0.1, cell: int = CELL) -> DataFrame:
    """For each row the nearest row of larger area that covers ``share`` of it: name, id, parent_name,
    parent_id; rows without one are absent.  Of equal areas the smaller (name, id) ranks as larger."""
    a, b = Box.of("a_"), Box.of("b_")
    larger = (b.area > a.area) | ((b.area == a.area) & (F.struct("b_name", "b_id") < F.struct("a_name", "a_id")))
    overlap = a.intersection_area(b)
    pairs = _celled(rows, "a_", cell).join(_celled(rows, "b_", cell), "cell").filter(larger & (overlap > 0) & (overlap >= share * a.area))
    best = pairs.groupBy("a_name", "a_id").agg(F.min(F.struct(a.distance2(b).alias("d"), "b_name", "b_id")).alias("p"))
    return best.select(F.col("a_name").alias("name"), F.col("a_id").alias("id"), F.col("p.b_name").alias("parent_name"), F.col("p.b_id").alias("parent_id"))


def clusters(rows: DataFrame, share: float = 0.1, cell: int = CELL) -> DataFrame:
    """name, id, root_name, root_id: parents form a forest, and a cluster is a tree of it.  Roots are found
    by doubling: each round every row takes its pointer's pointer."""
    up = parents(rows, share, cell)
    now = rows.select("name", "id").join(up, ["name", "id"], "left").select(
        F.struct("name", "id").alias("k"), F.when(F.col("parent_name").isNotNull(), F.struct(F.col("parent_name").alias("name"), F.col("parent_id").alias("id"))).otherwise(F.struct("name", "id")).alias("p")
    )
    now = stage(now, "pointers")
    while True:
        far = now.select(F.col("k").alias("p"), F.col("p").alias("q"))
        after = stage(now.join(far, "p").select("k", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
        now = after.select("k", "p")
        if not after.filter("moved").limit(1).count():
            return now.select("k.name", "k.id", F.col("p.name").alias("root_name"), F.col("p.id").alias("root_id"))


def footprints(rows: DataFrame, share: float = 0.1, cell: int = CELL) -> DataFrame:
    """One row per cluster, named by its root: the envelope and the number of rows."""
    roots = clusters(rows, share, cell)
    return rows.join(roots, ["name", "id"]).groupBy("root_name", "root_id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count("*").alias("n"))


def assign(rows: DataFrame, prints: DataFrame, share: float = 0.5, cell: int = CELL) -> DataFrame:
    """For each row (name, id, box) the nearest footprint (id, box) that covers ``share`` of it, else null:
    name, id, footprint."""
    a, b = Box.of("a_"), Box.of("b_")
    overlap = a.intersection_area(b)
    prints = prints.select(F.lit("").alias("name"), "id", *CORNERS)
    pairs = _celled(rows, "a_", cell).join(_celled(prints, "b_", cell), "cell").filter((overlap > 0) & (overlap >= share * a.area))
    best = pairs.groupBy("a_name", "a_id").agg(F.min(F.struct(a.distance2(b).alias("d"), F.col("b_id"))).alias("p"))
    best = best.select(F.col("a_name").alias("name"), F.col("a_id").alias("id"), F.col("p.b_id").alias("footprint"))
    return rows.select("name", "id").join(best, ["name", "id"], "left")
