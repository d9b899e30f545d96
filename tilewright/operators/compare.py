"""Comparison of sources that share identities: selection, match rates, measures, matrices, reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.boxes import Box

from .aggregate import merged


def percent_error(a: Column, b: Column) -> Column:
    """(max - min) / max; null where it is 0 / 0."""
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def _names(name: str | Iterable[str]) -> list[str]:
    return [name] if isinstance(name, str) else sorted(name)


class Compare:
    """``data``: rows with ubid, name, id, box corners, height_m, floors."""

    def __init__(self, data: DataFrame, aggregate: DataFrame | None = None):
        self.data = data
        self.aggregate = merged(data) if aggregate is None else aggregate

    def of(self, name: str | Iterable[str]) -> DataFrame:
        return self.aggregate.filter(F.col("name").isin(_names(name)))

    def __getitem__(self, ubids: DataFrame) -> Compare:
        """Only the identities in the column ubid of a table."""
        held = ubids.select("ubid").distinct()
        return Compare(self.data.join(held, "ubid", "left_semi"), self.aggregate.join(held, "ubid", "left_semi"))

    def xs(self, key: str, stage: str = "aggregate") -> DataFrame:
        """A source's rows if the key is a source's name, else an identity's."""
        frame = self.data if stage == "data" else self.aggregate
        return frame.filter((F.col("name") == key) | (F.col("ubid").cast("string") == key))

    def _others(self, name: str | Iterable[str]) -> DataFrame:
        return self.aggregate.filter(~F.col("name").isin(_names(name))).select("ubid")

    def matched(self, name: str | Iterable[str] | None = None) -> DataFrame:
        """Rows of a source whose identity other sources have too; of all sources, identities of two or more."""
        if name is None:
            return self.aggregate.groupBy("ubid").agg(F.count_distinct("name").alias("n")).filter("n > 1").select("ubid")
        return self.of(name).join(self._others(name), "ubid", "left_semi")

    def unmatched(self, name: str | Iterable[str] | None = None) -> DataFrame:
        if name is None:
            return self.singles()
        return self.of(name).join(self._others(name), "ubid", "left_anti")

    def singles(self) -> DataFrame:
        """Identities with one row."""
        return self.aggregate.groupBy("ubid").agg(F.count("*").alias("n")).filter("n = 1").select("ubid")

    def match_rate(self, *names: str) -> DataFrame:
        """name, n, matched, rate; of each source or of those named.  One aggregation finds the identities
        that more than one source has."""
        per = self.aggregate.select("ubid", "name").distinct()
        shared = per.groupBy("ubid").agg(F.count("*").alias("sources"))
        rows = self.aggregate.join(shared, "ubid", "left").groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("sources") > 1).alias("matched"))
        rows = rows.filter(F.col("name").isin(list(names))) if names else rows
        return rows.withColumn("rate", F.col("matched") / F.col("n"))

    def pairs(self, of: str, other: str) -> DataFrame:
        """Rows of two sources side by side, as a_ and b_."""
        side = lambda name, p: self.of(name).select("ubid", *[F.col(c).alias(p + c) for c in ("xmin", "ymin", "xmax", "ymax", "height_m", "floors")])
        return side(of, "a_").join(side(other, "b_"), "ubid")

    def containment(self, of: str, within: str) -> DataFrame:
        a, b = Box.of("a_"), Box.of("b_")
        return self.pairs(of, within).select("ubid", F.try_divide(a.intersection_area(b), a.area).alias("containment"))

    def quality(self, of: str, other: str) -> DataFrame:
        """Intersection over union."""
        a, b = Box.of("a_"), Box.of("b_")
        return self.pairs(of, other).select("ubid", F.try_divide(a.intersection_area(b), a.union_area(b)).alias("quality"))

    def intersection(self, of: str, other: str) -> DataFrame:
        return self.pairs(of, other).select("ubid", Box.of("a_").intersection_area(Box.of("b_")).alias("area"))

    def union(self, of: str, other: str) -> DataFrame:
        return self.pairs(of, other).select("ubid", Box.of("a_").union_area(Box.of("b_")).alias("area"))

    def _values(self, of: str, other: str, value: str) -> DataFrame:
        return self.pairs(of, other).filter(F.col(f"a_{value}").isNotNull() & F.col(f"b_{value}").isNotNull())

    def difference_percent(self, of: str, other: str, value: str = "height_m") -> DataFrame:
        return self._values(of, other, value).select("ubid", percent_error(F.col(f"a_{value}"), F.col(f"b_{value}")).alias("difference"))

    def difference_absolute(self, of: str, other: str, value: str = "height_m") -> DataFrame:
        return self._values(of, other, value).select("ubid", F.abs(F.col(f"a_{value}") - F.col(f"b_{value}")).alias("difference"))

    def difference_scaled(self, of: str, other: str, value: str = "height_m") -> DataFrame:
        """Percent difference times containment."""
        a, b = Box.of("a_"), Box.of("b_")
        scaled = percent_error(F.col(f"a_{value}"), F.col(f"b_{value}")) * F.try_divide(a.intersection_area(b), a.area)
        return self._values(of, other, value).select("ubid", scaled.alias("difference")).filter("difference is not null")

    def matrix(self, rows: Sequence[str] | str, columns: Sequence[str] | str, values: Sequence[str] = ("height_m", "floors")) -> DataFrame:
        """(ubid, name) of row sources, and a percent difference for each column source from the first of the
        values that both have."""
        columns = _names(columns)
        wide = self.of(columns).groupBy("ubid").agg(*[F.max(F.when(F.col("name") == c, F.struct(*values))).alias(f"_{c}") for c in columns])
        differ = lambda c: F.coalesce(*[percent_error(F.col(v), F.col(f"_{c}")[v]) for v in values])
        joined = self.of(rows).join(wide, "ubid", "left")
        out = joined.select("ubid", "name", *[F.when(F.col("name") != c, differ(c)).alias(c) for c in columns])
        return out.filter(F.coalesce(*[F.col(c) for c in columns]).isNotNull())

    def discrepancies(self, of: str, other: str, value: str = "height_m", least: float = 0.2) -> DataFrame:
        """Identities that differ by more than ``least``, with both values, the greatest difference first."""
        both = self._values(of, other, value).withColumn("difference", percent_error(F.col(f"a_{value}"), F.col(f"b_{value}")))
        return both.filter(F.col("difference") > least).select("ubid", "difference", F.col(f"a_{value}").alias("left_value"), F.col(f"b_{value}").alias("right_value")).orderBy(F.desc("difference"), "ubid")

    def report(self, of: str, other: str, value: str = "height_m", least: float = 0.2, *columns: str) -> DataFrame:
        """The discrepancies with further columns of the first source's aggregate rows, such as the cardinal id."""
        return self.discrepancies(of, other, value, least).join(self.of(of).select("ubid", *columns), "ubid")

    def identities(self, name: str = "osm") -> DataFrame:
        """Identity -> the sorted ids of a source's rows, joined by commas."""
        rows = self.data.filter(F.col("name") == name)
        return rows.groupBy("ubid").agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("ids"))

    def bottom(self, frame: DataFrame, value: str, share: float = 0.05) -> DataFrame:
        """The rows of lowest value, ``share`` of all; ties by ubid."""
        known = frame.filter(F.col(value).isNotNull())
        return ordinals(known, value, "ubid").filter(F.col("ordinal") < int(known.count() * share)).drop("ordinal")

    def median_error(self, of: str, other: str, value: str = "height_m") -> DataFrame:
        return self.difference_percent(of, other, value).agg(F.median("difference").alias("median_error"))


def cyclic_rank(rows: DataFrame, key: str, n: int) -> DataFrame:
    """An ordinal modulo ``n`` for keys with several rows, null for the others.  The ordinal counts keys in
    order; it comes from one row for each key, range-partitioned."""
    keys = rows.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").select(key)
    return rows.join(ordinals(keys, key), key, "left").withColumn("hue", F.col("ordinal") % n)


def running(rows: DataFrame, value: Column, groups: Sequence[str], by: Sequence[str], name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``value`` over those before them, by ``by`` within ``groups``.  No task sees all:
    sums within range partitions, plus those of the group's partitions before, which are joined to them."""
    from tilewright.sources.scratch import fresh, stage

    start = fresh("start", rows.withColumn(name, value))
    parts = stage(rows.withColumn(name, value).repartitionByRange(*groups, *by).withColumn("part", F.spark_partition_id()), "running")
    earlier = W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.groupBy(*groups, "part").agg(F.sum(name).alias("sum"))
    starts = starts.select(*groups, "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias(start))  # a row for each partition of a group
    within = W.partitionBy(*groups, "part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    summed = parts.withColumn(name, F.coalesce(F.sum(name).over(within), F.lit(0)))
    return summed.join(starts, [*groups, "part"]).withColumn(name, F.col(start) + F.col(name)).drop("part", start)


def ordinals(keys: DataFrame, *by: str) -> DataFrame:
    """``keys`` with column ordinal, their place in order from 0 on."""
    return running(keys, F.lit(1).cast("long"), (), by, "ordinal")
