"""Rasters in long form: buildings onto cells of map tiles, points onto squares, mosaics and overlays.

A box goes to the cells it touches by ``sequence`` and ``explode``, so empty cells never exist, and sums
combine before the shuffle.  A box that spans very many cells is cut into rows first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 256
FULL = 65535
MIN_HAG = 7.0


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """(tn, tw): planar tiles of ``size`` units that any box touches."""
    spread = rows.select(F.explode(F.sequence(F.floor(F.col("ymin") / size), F.floor((F.col("ymax") - 1) / size))).alias("tn"), "xmin", "xmax")
    return spread.select("tn", F.explode(F.sequence(F.floor(F.col("xmin") / size), F.floor((F.col("xmax") - 1) / size))).alias("tw")).distinct()


def cell_weights(rows: DataFrame, cell: int, max_height: Column | float) -> DataFrame:
    """(tn, tw, cn, cw, weight): for each box and cell the share of the cell it covers, times its height as a
    share of the greatest, times FULL.  Cells are ``cell`` units wide, CELLS of them to a tile."""
    tall = rows.filter("height_m is not null and xmax > xmin and ymax > ymin")
    strips = tall.select("xmin", "xmax", "ymin", "ymax", "height_m", F.explode(F.sequence(F.floor(F.col("ymin") / cell), F.floor((F.col("ymax") - 1) / cell))).alias("gy"))
    cells = strips.select("*", F.explode(F.sequence(F.floor(F.col("xmin") / cell), F.floor((F.col("xmax") - 1) / cell))).alias("gx"))
    w = F.least("xmax", (F.col("gx") + 1) * cell) - F.greatest("xmin", F.col("gx") * cell)
    h = F.least("ymax", (F.col("gy") + 1) * cell) - F.greatest("ymin", F.col("gy") * cell)
    weight = w * h / float(cell * cell) * F.col("height_m") / max_height * FULL
    return cells.select(
        F.floor(F.col("gy") / CELLS).alias("tn"), F.floor(F.col("gx") / CELLS).alias("tw"), F.pmod("gy", F.lit(CELLS)).alias("cn"), F.pmod("gx", F.lit(CELLS)).alias("cw"), weight.alias("weight")
    )


def elevation(rows: DataFrame, cell: int, max_height: Column | float, wrap: bool = False) -> DataFrame:
    """(tn, tw, cn, cw, value): summed weights as whole numbers up to FULL; ``wrap`` takes them modulo 65536."""
    total = cell_weights(rows, cell, max_height).groupBy("tn", "tw", "cn", "cw").agg(F.sum("weight").alias("s"))
    value = F.pmod(F.floor("s"), F.lit(FULL + 1)) if wrap else F.least(F.floor("s"), F.lit(FULL))
    return total.select("tn", "tw", "cn", "cw", value.cast("long").alias("value"))


def dense(cells: DataFrame) -> DataFrame:
    """(tn, tw, image): one array of CELLS * CELLS values for each tile, row by row; absent cells are 0."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = batch.column("at"), batch.column("v")
            for i in range(batch.num_rows):
                image = np.zeros(CELLS * CELLS, dtype=np.int64)
                image[places[i].values.to_numpy()] = values[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("tn").slice(i, 1), batch.column("tw").slice(i, 1), pa.array([image], pa.list_(pa.int64()))], ["tn", "tw", "image"])

    # at most CELLS * CELLS entries to a tile
    held = cells.groupBy(F.col("tn").cast("long").alias("tn"), F.col("tw").cast("long").alias("tw")).agg(F.collect_list(F.struct((F.col("cn") * CELLS + F.col("cw")).cast("long").alias("at"), F.col("value").cast("long").alias("v"))).alias("e"))
    return held.select("tn", "tw", "e.at", "e.v").mapInArrow(scatter, "tn long, tw long, image array<long>")


def hag_value(hag: Column, max_height: float) -> Column:
    """Height above ground as a value up to FULL; what is lower than MIN_HAG is ground."""
    return F.least(F.lit(float(FULL)), F.when(hag < MIN_HAG, 0.0).otherwise(hag / max_height * FULL))


def point_mean(points: DataFrame, size: int) -> DataFrame:
    """(px, py, mean): mean of hag in squares of ``size``."""
    return points.groupBy(F.floor(F.col("x") / size).alias("px"), F.floor(F.col("y") / size).alias("py")).agg(F.avg("hag").alias("mean"))


def mosaic(cells: DataFrame, tn0: int, tw0: int, tn1: int, tw1: int) -> DataFrame:
    """(row, col, value): the cells of a range of tiles as one image."""
    held = cells.filter(F.col("tn").between(tn0, tn1) & F.col("tw").between(tw0, tw1))
    return held.select(((F.col("tn") - tn0) * CELLS + F.col("cn")).alias("row"), ((F.col("tw") - tw0) * CELLS + F.col("cw")).alias("col"), "value")


def overlay(cells: DataFrame, cell: int) -> DataFrame:
    """Boxes of the cells that are not 0."""
    x, y = F.col("tw") * CELLS + F.col("cw"), F.col("tn") * CELLS + F.col("cn")
    return cells.filter("value > 0").select((x * cell).alias("xmin"), (y * cell).alias("ymin"), ((x + 1) * cell).alias("xmax"), ((y + 1) * cell).alias("ymax"), "value")


def threshold(cells: DataFrame, share: float) -> DataFrame:
    """Values below ceil(share * 255) become 0."""
    return cells.withColumn("value", F.when(F.col("value") < F.ceil(F.lit(share * 255)), 0).otherwise(F.col("value")))


def height_above_ground(points: DataFrame, size: int) -> DataFrame:
    """Points (id, x, y, z, ground) with hag, z minus that of the nearest ground point in the neighbouring
    squares of ``size``; null where there is none."""
    ground = points.filter("ground").select(F.col("id").alias("g_id"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    ground = ground.select("*", F.explode(near).alias("dx")).select("*", F.explode(near).alias("dy"))
    ground = ground.select("g_id", "gx", "gy", "gz", (F.floor(F.col("gx") / size) + F.col("dx")).alias("cx"), (F.floor(F.col("gy") / size) + F.col("dy")).alias("cy"))
    held = points.select("id", "x", "y", "z", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    d2 = (F.col("x") - F.col("gx")) * (F.col("x") - F.col("gx")) + (F.col("y") - F.col("gy")) * (F.col("y") - F.col("gy"))
    found = held.join(ground, ["cx", "cy"]).groupBy("id").agg(F.min(F.struct(d2.alias("d"), "g_id", "gz")).alias("g"))
    return points.join(found, "id", "left").select("id", "x", "y", "z", (F.col("z") - F.col("g.gz")).alias("hag"))
