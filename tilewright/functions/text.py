"""Lenient parsing of attributes: addresses, dates, years, storeys, links, boxes, well-known text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM", "yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "MMMM d, yyyy", "d MMMM yyyy")


def filled(c: Column) -> Column:
    """Null for null and the empty string."""
    return F.nullif(c, F.lit(""))


def osm_address(housenumber: Column, street: Column) -> Column:
    """Both parts or nothing."""
    hn, st = filled(housenumber), filled(street)
    return F.when(hn.isNotNull() & st.isNotNull(), F.concat_ws(" ", hn, st))


def city_address(number: Column, direction: Column, name: Column, kind: Column) -> Column:
    """Null without a name or a kind of street; absent parts are left out."""
    return F.when(filled(name).isNotNull() & filled(kind).isNotNull(), F.concat_ws(" ", filled(number), filled(direction), filled(name), filled(kind)))


def lenient_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats]).cast("timestamp_ntz")


def year_date(text: Column) -> Column:
    """January 1st of a year from 1 to 9999; else null."""
    year = F.when(F.trim(text).rlike("^[+-]?[0-9]{1,9}$"), F.trim(text).try_cast("int"))
    return F.when(year.between(1, 9999), F.make_date(F.when(year.between(1, 9999), year), F.lit(1), F.lit(1)))


def storeys(text: Column) -> Column:
    """A number other than 0; else null."""
    n = F.trim(text).try_cast("double")
    return F.when((n != 0) & ~F.isnan(n), n)


def share_link(url: Column) -> Column:
    """The share token of a link: base64 with web-safe letters and no padding."""
    return F.concat(F.lit("u!"), F.rtrim(F.translate(F.base64(url.cast("binary")), "/+\n\r", "_-"), F.lit("=")))


def suffix(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1))


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """Four numbers split by commas, semicolons or blanks, as two corners in any order."""
    parts = [p for p in text.replace(";", " ").replace(",", " ").split() if p]
    if len(parts) != 4:
        raise ValueError(f"a box has 4 numbers, not {len(parts)}: {text!r}")
    a, b, c, d = map(float, parts)
    return min(a, c), min(b, d), max(a, c), max(b, d)


def wkt_points(wkt: Column) -> Column:
    """Points (x, y) of the outer ring of a POLYGON, or of the first of a MULTIPOLYGON; empty if unreadable."""
    ring = F.regexp_extract(wkt, r"^\s*(?:MULTI)?POLYGON\s*(?:Z\s*)?\(+([^()]*)\)", 1)
    pairs = F.transform(F.split(ring, ","), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(pairs, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("x"), F.get(p, 1).try_cast("double").alias("y")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def poly_points(text: Column) -> Column:
    """Rings of a .poly boundary file: an array of arrays of points."""
    rings = F.filter(F.split(text, r"(?m)^\s*END\s*$"), lambda r: r.rlike(r"[0-9]\s+[-+]?[0-9.]"))
    numbers = lambda r: F.regexp_extract_all(r, F.lit(r"(?m)^\s+([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*$"), F.lit(1))
    point = lambda s: F.struct(F.get(F.split(s, r"\s+"), 0).try_cast("double").alias("x"), F.get(F.split(s, r"\s+"), 1).try_cast("double").alias("y"))
    return F.filter(F.transform(rings, lambda r: F.transform(numbers(r), point)), lambda r: F.size(r) > 0)


def listed(value: Column) -> Column:
    """The numbers of a semicolon list; null if any of them is no number."""
    numbers = F.transform(F.split(value, ";"), lambda x: F.trim(x).try_cast("double"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)
