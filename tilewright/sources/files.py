"""File sources and sinks of the engine: by suffix, by manifest, by stage."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tilewright.functions import text


class FeatherSource(DataSource):
    """``spark.read.format("feather").load(path)``: one partition for each file; columns are pruned by name."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> StructType:
        from pyarrow import feather
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(feather.read_table(_local(self.options["path"].split(",")[0]), memory_map=True).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeatherReader(self.options["path"].split(","), schema.names)


class _FeatherReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str]):
        self.paths, self.columns = paths, columns

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import feather

        yield from feather.read_table(_local(partition.value), columns=self.columns).to_batches()


def _local(path: str) -> str:
    return path.removeprefix("file://")


def read_any(spark: SparkSession, *paths: str, columns: Sequence[str] = ()) -> DataFrame:
    """Files by their suffix: feather, parquet, csv, geojson or json (features); several are united."""
    kind = paths[0].rsplit(".", 1)[-1].lower() if "." in paths[0].rsplit("/", 1)[-1] else "parquet"
    if kind in ("feather", "arrow"):
        spark.dataSource.register(FeatherSource)
        frame = spark.read.format("feather").load(",".join(paths))
    elif kind in ("geojson", "json"):
        frame = read_geojson(spark, *paths)
    elif kind == "csv":
        frame = spark.read.option("header", True).option("inferSchema", True).csv(list(paths))
    else:
        frame = spark.read.parquet(*paths)
    return frame.select(*columns) if columns else frame


def read_geojson(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per feature: its properties and the outer ring of its geometry."""
    raw = spark.read.option("multiLine", True).json(list(paths)).select(F.explode("features").alias("f"))
    rings = F.col("f.geometry.coordinates")
    return raw.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.transform(rings[0], lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))).alias("ring"))


def outer_ring(kind: str, geometry: str = "geometry"):
    """Points of a polygon's outer ring, null for anything else: holes go, lines are no areas."""
    return F.when(F.col(kind) == "Polygon", F.get(F.col(geometry), 0))


def read_poly(spark: SparkSession, *paths: str) -> DataFrame:
    """.poly boundaries: path, rings, and their box."""
    raw = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), text.poly_points(F.col("value")).alias("rings"))
    flat = F.flatten("rings")
    side = lambda f, a: f(F.transform(flat, lambda p: p[a]))
    return raw.select("path", "rings", side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax"))


def parse_lines(lines: DataFrame, schema: str, skip: str = "E") -> DataFrame:
    """Text lines (value) as rows; those that begin with ``skip`` are errors and go."""
    good = lines.filter(~F.col("value").startswith(skip))
    return good.select(F.from_csv("value", schema).alias("r")).select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file with their numbers from 0 on.  A task numbers the lines of one
    block of the file; the blocks before it, one row each, give the rest."""
    from tilewright.sources.scratch import stage

    block = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = stage(spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("place"), "value"), "lines")
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("file", "block").orderBy("place")) - 1
    return lines.withColumn("rank", rank).join(starts, ["file", "block"]).select((F.col("start") + F.col("rank")).alias("line"), "value")


def read_csv_pair(spark: SparkSession, inputs: str, metadata: str, schema: str, more: str) -> DataFrame:
    """Two files whose lines belong together by number; error lines of the first are left out of both."""
    good = numbered_lines(spark, inputs).filter(~F.col("value").startswith("E") & (F.col("value") != ""))
    both = good.join(numbered_lines(spark, metadata).withColumnRenamed("value", "other"), "line")
    return both.select("line", F.from_csv("value", schema).alias("a"), F.from_csv("other", more).alias("b")).select("line", "a.*", "b.*")


def read_tiles(spark: SparkSession, path: str, pattern: str = r"(\d+)/(\d+)/(\d+)\.\w+$", names: Sequence[str] = ("zoom", "tw", "tn")) -> DataFrame:
    """Image files with the numbers in their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(*[F.regexp_extract("path", pattern, i + 1).cast("long").alias(n) for i, n in enumerate(names)], "content")


def prune(manifest: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> list[str]:
    """Files of a manifest (path, box) whose box meets the request: a row for each file, so small."""
    from tilewright.functions.boxes import Box

    return [r.path for r in manifest.filter(Box.of().intersects(Box.literal(xmin, ymin, xmax, ymax))).select("path").orderBy("path").collect()]


def stage_path(root: str, names: Sequence[str], bbox: Sequence[float]) -> str:
    """Folder of a stage: the sources' names in order, then the box."""
    return f"{root.rstrip('/')}/{'_'.join(sorted(names))}/{','.join(f'{v:g}' for v in bbox)}"


def cached(spark: SparkSession, path: str, make, redo: bool = False) -> DataFrame:
    """The table at a path, made first where it is absent or is to be made again."""
    if not redo:
        try:
            return spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_any(frame: DataFrame, path: str, kind: str | None = None) -> None:
    """Parquet, csv, json or orc by suffix."""
    kind = kind or path.rsplit(".", 1)[-1]
    frame.write.mode("overwrite").format(kind if re.fullmatch("parquet|csv|json|orc", kind) else "parquet").save(path)


def split_bbox(count, xmin: float, ymin: float, xmax: float, ymax: float, free: float, row_bytes: int = 11_000, depth: int = 20) -> list[tuple[float, float, float, float]]:
    """Boxes whose estimated rows (``count`` of a box) fit into ``free`` bytes, split at the middle latitude."""
    if depth == 0 or count(xmin, ymin, xmax, ymax) * row_bytes <= free:
        return [(xmin, ymin, xmax, ymax)]
    y = (ymin + ymax) / 2
    return split_bbox(count, xmin, ymin, xmax, y, free, row_bytes, depth - 1) + split_bbox(count, xmin, y, xmax, ymax, free, row_bytes, depth - 1)
