"""Camera headings, ray casting on tile masks, and distances to walls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIDE = 256


def heading_expand(cameras: DataFrame) -> DataFrame:
    """(poid, x, y, heading): two rows for each camera, a right angle to either side; of rows with the same
    rounded heading the first stays (the clockwise ones come first).  Null headings are left out."""
    h = F.col("heading")
    both = F.array(F.struct(F.lit(0).alias("k"), F.pmod(h + 90, F.lit(360.0)).alias("h")), F.struct(F.lit(1).alias("k"), F.pmod(h - 90, F.lit(360.0)).alias("h")))
    rows = cameras.filter("heading is not null").select("poid", "x", "y", F.explode(both).alias("e")).select("poid", "x", "y", F.col("e.k").alias("k"), F.col("e.h").alias("heading"))
    first = W.partitionBy("poid", F.round("heading")).orderBy("k", "heading")
    return rows.withColumn("r", F.row_number().over(first)).filter("r = 1").select("poid", "x", "y", "heading")


def raycast(cameras: DataFrame, walls: DataFrame) -> DataFrame:
    """First wall pixel on each camera's ray: (poid, heading, dcol, drow), null where there is none.

    cameras (poid, tile, row, col, heading), walls (tile, r, c).  The pixels passed meet the walls in an
    equi-join; the least step wins.  On a ray the flatter axis accumulates the slope: when it has reached 1 the
    ray takes a step along the minor axis and gives 1 back, else it adds the slope and takes a step along the
    major one, never both."""

    def cast(batches):
        for batch in batches:
            tile, row, col, heading, poid = (batch.column(c) for c in ("tile", "row", "col", "heading", "poid"))
            h = heading.to_numpy(zero_copy_only=False).astype(float)
            theta = np.radians((450.0 - h) % 360.0)
            slope = np.abs(np.tan(theta))
            steep = slope > 1
            m = np.where(steep, 1 / np.maximum(slope, 1e-300), slope)
            dx, dy = np.where(np.cos(theta) >= 0, 1, -1), np.where(np.sin(theta) >= 0, -1, 1)
            r, c = row.to_numpy().astype(np.int64), col.to_numpy().astype(np.int64)
            e, live = np.zeros(len(h)), np.arange(len(h))
            for k in range(2 * SIDE + 1):
                live = live[(r[live] >= 0) & (r[live] < SIDE) & (c[live] >= 0) & (c[live] < SIDE)]
                if not len(live):
                    break
                at = pa.array(live)
                yield pa.RecordBatch.from_arrays([poid.take(at), heading.take(at), tile.take(at), pa.array(np.full(len(live), k)), pa.array(r[live]), pa.array(c[live])], ["poid", "heading", "tile", "k", "r", "c"])
                minor = e[live] >= 1
                along_row = minor != steep[live]
                r[live] += np.where(along_row, dy[live], 0)
                c[live] += np.where(along_row, 0, dx[live])
                e[live] += np.where(minor, -1.0, m[live])

    rays = cameras.select("poid", "tile", "row", "col", "heading")
    passed = rays.mapInArrow(cast, "poid long, heading double, tile long, k long, r long, c long")
    hits = passed.join(walls.select("tile", "r", "c").distinct(), ["tile", "r", "c"]).groupBy("poid", "heading").agg(F.min(F.struct("k", "r", "c")).alias("hit"))
    found = cameras.select("poid", "row", "col", "heading").join(hits, ["poid", "heading"], "left")
    return found.select("poid", "heading", (F.col("hit.c") - F.col("col")).cast("long").alias("dcol"), (F.col("hit.r") - F.col("row")).cast("long").alias("drow"))
