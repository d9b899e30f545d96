"""Axis-parallel boxes as columns xmin, ymin, xmax, ymax: measures and predicates on whole-stage code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("xmin", "ymin", "xmax", "ymax")))

    @staticmethod
    def literal(xmin: float, ymin: float, xmax: float, ymax: float) -> Box:
        return Box(*map(F.lit, (xmin, ymin, xmax, ymax)))

    @property
    def area(self) -> Column:
        return (self.xmax - self.xmin) * (self.ymax - self.ymin)

    @property
    def cx(self) -> Column:
        return (self.xmin + self.xmax) / 2

    @property
    def cy(self) -> Column:
        return (self.ymin + self.ymax) / 2

    def intersects(self, other: Box) -> Column:
        """Whether the closed boxes meet; touching counts."""
        return (self.xmin <= other.xmax) & (other.xmin <= self.xmax) & (self.ymin <= other.ymax) & (other.ymin <= self.ymax)

    def within(self, other: Box) -> Column:
        return (self.xmin >= other.xmin) & (self.xmax <= other.xmax) & (self.ymin >= other.ymin) & (self.ymax <= other.ymax)

    def contains_point(self, x: Column, y: Column) -> Column:
        return x.between(self.xmin, self.xmax) & y.between(self.ymin, self.ymax)

    def intersection_area(self, other: Box) -> Column:
        """0 for boxes that are apart or only touch."""
        w = F.least(self.xmax, other.xmax) - F.greatest(self.xmin, other.xmin)
        h = F.least(self.ymax, other.ymax) - F.greatest(self.ymin, other.ymin)
        return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))

    def union_area(self, other: Box) -> Column:
        return self.area + other.area - self.intersection_area(other)

    def distance2(self, other: Box) -> Column:
        """Squared distance of the centres."""
        return (self.cx - other.cx) * (self.cx - other.cx) + (self.cy - other.cy) * (self.cy - other.cy)

    def cells(self, size: int) -> Column:
        """Keys of the grid cells that the box touches."""
        xs = F.sequence(F.floor(self.xmin / size), F.floor(self.xmax / size))
        ys = F.sequence(F.floor(self.ymin / size), F.floor(self.ymax / size))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
