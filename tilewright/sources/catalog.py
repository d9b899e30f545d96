"""Catalogues of extracts: manifests with boxes, levels that refine each other, links in pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.boxes import Box
from tilewright.functions.text import share_link

#: From the finest level on.
LEVELS = ("city", "subregion", "region", "continent")


def from_template(spark: SparkSession, boxes: dict[str, tuple[float, float, float, float]], template: str, level: str = "region") -> DataFrame:
    """A manifest (level, name, parent, path, box) of places whose files follow a template of ``{name}``."""
    rows = [(level, name, None, template.format(name=name.replace(" ", "")), *box) for name, box in boxes.items()]
    return spark.createDataFrame(rows, "level string, name string, parent string, path string, xmin double, ymin double, xmax double, ymax double")


def suggest(manifest: DataFrame, bbox: Sequence[float], level: str) -> DataFrame:
    """A level's extracts that meet the box and whose parents do, where they have any."""
    met = manifest.filter(Box.of().intersects(Box.literal(*bbox)))
    held = met.filter(F.col("level") == level)
    parents = met.select(F.col("name").alias("parent")).distinct()
    return held.join(parents, "parent", "left_semi").unionByName(held.filter("parent is null"))


def finest(manifest: DataFrame, bbox: Sequence[float], levels: Sequence[str] = LEVELS) -> DataFrame:
    """The extracts of the finest level that has any for the box."""
    met = manifest.filter(Box.of().intersects(Box.literal(*bbox)))
    rank = F.coalesce(*[F.when(F.col("level") == v, F.lit(i)) for i, v in enumerate(levels)])
    ranked = met.withColumn("rank", rank).filter("rank is not null")
    best = ranked.agg(F.min("rank").alias("best"))
    return ranked.join(F.broadcast(best), F.col("rank") == F.col("best")).drop("rank", "best")


def page_links(pages: DataFrame, text: str = "value") -> DataFrame:
    """(place, url): the cells of tables in pages that hold a link."""
    cells = F.regexp_extract_all(F.col(text), F.lit(r'(?is)<td[^>]*>\s*<a[^>]*href="[^"]+"[^>]*>[^<]+</a>'), F.lit(0))
    cell = F.explode(cells).alias("cell")
    return pages.select(cell).select(F.trim(F.regexp_extract("cell", r"(?is)>([^<>]+)</a>$", 1)).alias("place"), F.regexp_extract("cell", r'(?i)href="([^"]+)"', 1).alias("url"))


def shared(links: DataFrame) -> DataFrame:
    """Links with the token that a share service knows them by."""
    return links.withColumn("token", share_link(F.col("url")))


def stale(manifest: DataFrame, present: DataFrame, redo: Sequence[str] = ()) -> DataFrame:
    """Files that are absent, or are to be made again."""
    return manifest.join(present.select("path"), "path", "left_anti").unionByName(manifest.filter(F.col("name").isin(list(redo)))).dropDuplicates(["path"])
